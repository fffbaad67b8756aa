"""Row filters (P7, P9, P10). Each is a predicate that Catalyst can push towards the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.functions.text import is_blank


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    """Drop a row with any null (missing text, unmapped label)."""
    return df.na.drop(how="any", subset=subset)


def reject_blank(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a post that is empty after stripping Unicode whitespace is refused."""
    blank = is_blank(text_col)
    return df.filter(~blank), df.filter(blank)


def choose_model(df: DataFrame, name: str, model_col: str = "model") -> DataFrame:
    """Keep one model's rows; apply to the registry before scoring, never to the scores after."""
    return df.filter(F.col(model_col) == F.lit(name))
