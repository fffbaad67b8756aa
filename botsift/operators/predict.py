"""From scores to predictions.

Scores arrive wide (one row per post, one ``p_<model>`` column per model). The ensemble is an
array aggregate on that row (no shuffle, no positional alignment); the long table (post, model)
comes from one ``inline`` afterwards, so the posts are scanned once for all models.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.functions.labels import decode_label
from botsift.functions.numeric import predict_threshold
from botsift.operators.textmodels import prob_col

# Fixed value: name of the averaged model in every report.
ENSEMBLE = "ENSEMBLE"


def ensemble_mean(wide: DataFrame, names: list[str], out: str = ENSEMBLE) -> DataFrame:
    """Unweighted mean of the available models' probabilities (a confident minority can win)."""
    if not names:
        raise ValueError("ensemble of zero models: no model was available")
    total = reduce(lambda a, b: a + b, [F.col(prob_col(n)) for n in names])   # left to right, as a fold
    mean = total / F.lit(float(len(names)))
    return wide.withColumn(prob_col(out), mean)


def to_long(wide: DataFrame, names: list[str], key: str = "post_id", carry=("label",),
            threshold: float = 0.5) -> DataFrame:
    """(post, model) rows with the probability and the thresholded class."""
    carry = [c for c in carry if c in wide.columns]
    arr = F.array(*[F.struct(F.lit(n).alias("model"), F.col(prob_col(n)).alias("p")) for n in names])
    return (wide.select(key, *carry, F.inline(arr))
            .withColumn("predicted", predict_threshold("p", threshold)))


def with_display(long: DataFrame, digits: int = 3) -> DataFrame:
    """Adds the class name and the confidence rounded for display (the unrounded ``p`` stays)."""
    return (long.withColumn("prediction", decode_label("predicted"))
            .withColumn("confidence", F.round(F.col("p"), digits)))
