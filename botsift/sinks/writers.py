"""Sinks (K1-K3): results table as CSV, model tables as parquet, predictions partitioned by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.operators.head import read_head, write_head
from botsift.operators.registry import save_models
from botsift.sources.csv import write_csv

RESULTS_SCHEMA = T.StructType([T.StructField(c, t, True) for c, t in (
    ("model", T.StringType()), ("accuracy", T.DoubleType()), ("precision", T.DoubleType()),
    ("recall", T.DoubleType()), ("f1", T.DoubleType()))])


def write_results_csv(results: DataFrame, path: str) -> None:
    """The comparison table (one row per model, a handful of rows) as one CSV file with a header;
    with a ``position`` column the rows are written in its order (the column itself isn't)."""
    if "position" in results.columns:
        results = results.coalesce(1).sortWithinPartitions("position").drop("position")
    write_csv(results, path, sep=",", single_file=True)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their ``position`` in the one file (from 1)."""
    rows = spark.read.option("header", True).option("escape", '"').schema(RESULTS_SCHEMA).csv(path)
    return rows.withColumn("position", (F.monotonically_increasing_id() + 1).cast("int"))


def save_model(spark: SparkSession, models, path: str) -> None:
    save_models(spark, models, path)


def write_predictions(pred: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long prediction table, one folder per model (readers pick a model by partition pruning)."""
    pred.write.mode(mode).partitionBy("model").parquet(path)


save_head, load_head = write_head, read_head
