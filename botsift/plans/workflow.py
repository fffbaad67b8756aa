"""End-to-end flows built from the operators: prepare -> split -> fit -> score -> evaluate.

Each function returns a lazy DataFrame except where a model must be fitted (a fitted model is
materialised once in the shared folder and then reused by every plan that applies it).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.config import DEFAULT_PROFILE, Profile
from botsift.functions.labels import encode_label
from botsift.functions.text import clean
from botsift.operators.filters import drop_incomplete
from botsift.operators.metrics import compare_models
from botsift.operators.predict import ENSEMBLE, ensemble_mean, to_long
from botsift.operators.registry import DEFAULT_REGISTRY, fit_all_models
from botsift.operators.split import split_stratified_exact
from botsift.operators.textmodels import TextModel, score_models
from botsift.sources import tables
from botsift.sources.columns import select_text_label
from botsift.sources.rows import ROW


def prepare_posts(raw: DataFrame, profile: Profile = DEFAULT_PROFILE, case_sensitive: bool = False,
                  key: str = "post_id") -> DataFrame:
    """Detect + rename columns, encode the label, drop incomplete rows, clean the text; the rows' identity stays.
    The null filter runs before the cleaning regexes (Catalyst keeps it there)."""
    df = select_text_label(raw, keep=(key, ROW))
    df = df.withColumn("label", encode_label("label", case_sensitive))
    df = drop_incomplete(df)
    return df.withColumn("text", clean("text", profile.clean))


def labelled_posts(spark: SparkSession, sf_dir: str, profile: Profile = DEFAULT_PROFILE,
                   case_sensitive: bool = False) -> DataFrame:
    return prepare_posts(tables.posts(spark, sf_dir, row_id=True), profile, case_sensitive)


def split(df: DataFrame, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    return split_stratified_exact(df, seed=profile.seed, test_share=profile.test_share)


@dataclass
class Evaluation:
    models: list[TextModel]
    split: DataFrame = field(repr=False)
    wide: DataFrame = field(repr=False)


def fit_and_score(df_split: DataFrame, specs=DEFAULT_REGISTRY, profile: Profile = DEFAULT_PROFILE,
                  score_on: DataFrame | None = None) -> Evaluation:
    """Fit every registry entry on the training part, score the test part (or ``score_on``)."""
    train = df_split.filter(F.col("split") == "train")
    models = fit_all_models(train, specs, profile)
    target = score_on if score_on is not None else df_split.filter(F.col("split") == "test")
    wide = score_models(target, models, profile=profile)
    return Evaluation(models, df_split, wide)


def predictions_long(ev: Evaluation, threshold: float = 0.5, with_ensemble: bool = False) -> DataFrame:
    names = [m.name for m in ev.models]
    wide = ev.wide
    if with_ensemble:
        wide = ensemble_mean(wide, names)
        names = names + [ENSEMBLE]
    return to_long(wide, names, threshold=threshold)


def compare(ev: Evaluation, threshold: float = 0.5, with_ensemble: bool = True) -> DataFrame:
    return compare_models(predictions_long(ev, threshold, with_ensemble))
