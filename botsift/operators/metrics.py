"""Evaluation aggregates.

All models are evaluated by ONE grouped aggregate over the long prediction table: each task
emits four counters per model (partial aggregation), so the shuffle is tiny however many posts
there are. Undefined precision / recall / F1 are 0, not null. Positive class = 1 (machine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botsift.functions.labels import DISPLAY

METRICS = ("accuracy", "precision", "recall", "f1")


def _ratio(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(pred: DataFrame, by=("model",), label_col: str = "label",
                     pred_col: str = "predicted") -> DataFrame:
    y, yhat = F.col(label_col), F.col(pred_col)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    return pred.groupBy(*by).agg(
        cnt((y == 1) & (yhat == 1)).alias("tp"), cnt((y == 0) & (yhat == 1)).alias("fp"),
        cnt((y == 1) & (yhat == 0)).alias("fn"), cnt((y == 0) & (yhat == 0)).alias("tn"),
    )


def metrics_from_counts(counts: DataFrame, by=("model",)) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def compare_models(pred: DataFrame, by=("model",), label_col: str = "label", pred_col: str = "predicted") -> DataFrame:
    """One row per model: accuracy, precision, recall, F1."""
    return metrics_from_counts(confusion_counts(pred, by, label_col, pred_col), by)


def in_order(table: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``position``: the place (from 1) of each row's model in ``names``."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model")).cast("int")
    return table.withColumn("position", place)


def accuracy(pred: DataFrame, **kw) -> DataFrame:
    return compare_models(pred, **kw).select(*kw.get("by", ("model",)), "accuracy")


def confusion_matrix(pred: DataFrame, by=("model",), label_col: str = "label", pred_col: str = "predicted") -> DataFrame:
    """(by..., actual, predicted, n): always all four cells, zero-filled."""
    counts = confusion_counts(pred, by, label_col, pred_col)
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )
    return counts.select(*by, F.inline(cells))


def confusion_labeled(pred: DataFrame, by=("model",), **kw) -> DataFrame:
    """The matrix with class names (the data behind the picture)."""
    names = F.create_map(F.lit(0), F.lit(DISPLAY[0]), F.lit(1), F.lit(DISPLAY[1]))
    cm = confusion_matrix(pred, by, **kw)
    return cm.select(*by, names[F.col("actual")].alias("actual"), names[F.col("predicted")].alias("predicted"), "n")


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label_col)


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Share per class; the total comes from a window over the (few-row) aggregate."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def metrics_report(metrics: DataFrame, by=("model",), digits: int = 4) -> DataFrame:
    """Every metric as text with fixed decimals (no thousands separators)."""
    fmt = f"%.{digits}f"
    return metrics.select(*by, *[F.format_string(fmt, F.col(m)).alias(m) for m in METRICS])


def rank_models(metrics: DataFrame, by: str = "f1") -> DataFrame:
    """Rank of each model by a metric (ties share a rank); the input has one row per model."""
    w = Window.partitionBy().orderBy(F.desc(by))
    return metrics.withColumn("rank", F.rank().over(w))
