"""Bounded samples of labelled texts for the trained operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.common import id_and_text, remainder
from botsift.session import materialize, small_batches

#: labelled texts that a model is fitted on at most (those of the lowest hashes of id and text)
MAX_LABELLED = 12_000


def _lowest(keys: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows of the lowest ``rank``. Of a large table only the lowest share, twice as much as is wanted, is ordered."""
    n = keys.count()
    if n > 4 * bound:
        below = keys.where(F.col("rank") < F.lit(-(1 << 63) + int((1 << 64) * (2 * bound / n))))
        if below.limit(bound).count() == bound:
            keys = below
    return keys.orderBy("rank", "doc_id", "text_hash").limit(bound)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled texts outside the held-out share, as a table in the shared folder. A row
    that repeats counts once; ids with a null label, and labels without a document, take no part; the greatest label of an id
    counts. Only ids and hashes are joined with the labels; the chosen ones (``bound`` rows) are broadcast to fetch their texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder("doc_id", modulus) != 0))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    keys = rows.select("doc_id", "text_hash").join(known, "doc_id").groupBy("doc_id", "text_hash", "y").count()
    keys = materialize(keys.select("doc_id", "text_hash", "y", F.xxhash64("doc_id", "text_hash").alias("rank")), f"labelled-keys-{label}")
    chosen = materialize(_lowest(keys, bound).drop("rank"), f"labelled-chosen-{label}")
    found = rows.join(F.broadcast(chosen), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return materialize(found.select("doc_id", "text", "y"), f"labelled-{label}")


def evaluated(rows: DataFrame, name: str) -> DataFrame:
    """A few numbers for each of many texts, as a table in the shared folder: evaluated here, in small batches, and written by as many
    tasks as there are cores rather than by each task that reads texts."""
    spark = rows.sparkSession
    with small_batches(spark):
        return materialize(rows.repartition(spark.sparkContext.defaultParallelism), name)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float, weight: np.ndarray | None = None,
                 steps: int = 60) -> np.ndarray:
    """Coefficients of a logistic loss with a ridge towards ``prior``, by damped Newton steps."""
    w = prior.astype(np.float64).copy()
    s = np.ones(len(y)) if weight is None else weight

    def loss(v):
        z = x @ v
        return float((s * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * ((v - prior) ** 2).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (s * (p - y)) + ridge * (w - prior)
        curve = (x * (s * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        then = loss(w - rate * step)
        if now - then < 1e-9 * (1 + abs(now)):
            break
        w, now = w - rate * step, then
    return w
