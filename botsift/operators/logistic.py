"""Logistic regression over the whole vocabulary (G7): a weight for every training word, none shared.

    z = bias + sum of weight over the post's words,  p = sigmoid(z),  mean log-loss + reg/2 * weights^2

is minimised by a fixed number of full-batch Adam steps from zero. The parameters are a table of terms, as large as the vocabulary
is, and never on the driver. Posts are encoded once (ids of their words; the start id, which each post has once, stands for
the bias) and kept in blocks, one row each. A step

* joins the parameters to the distinct ids of the blocks: a block gets its slice, a word costs a block one row however often it
  stands in it, so no word is a hot key,
* computes the residuals and the gradient of a block in numpy (one block in memory),
* adds the blocks' gradients by id and writes the new parameters.

What moves in a step are the blocks' distinct ids; the blocks themselves are a bucketed table, which the join reads in place.
A post's row decides its block, so copies of a post spread. Every step's parameters are written in the shared folder: a lost
executor repeats one step at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.config import DEFAULT_PROFILE, START_ID, Profile
from botsift.operators.encode import build_vocab, encode_ids
from botsift.operators.rank import with_row_id
from botsift.operators.textmodels import TextModel
from botsift.session import discard, materialize, scratch_path
from botsift.sources.rows import ROW

STEPS = 20
RATE = 0.05
REG = 1e-4
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8
#: words of one block of posts
BLOCK_WORDS = 500_000
BUCKETS = 64


def _gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (posts, slice) to (id, g): summed gradient of the log-loss for each distinct id of a block."""
    from botsift.operators.head import np_sigmoid

    for batch in batches:
        for i in range(batch.num_rows):
            posts, weights = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
            y, words = posts.field("y").to_numpy(zero_copy_only=False).astype(np.float64), posts.field("ids")
            ids, w = (weights.field(c).to_numpy(zero_copy_only=False) for c in ("id", "w"))
            order = np.argsort(ids)
            ids, w = ids[order], w[order]
            at = np.searchsorted(ids, words.flatten().to_numpy(zero_copy_only=False))
            length = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            z = np.add.reduceat(w[at], np.cumsum(length) - length)       # every post has its start id
            rest = np.repeat(np_sigmoid(z) - y, length)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.bincount(at, rest, len(ids)))], names=["id", "g"])


def _adam(state: DataFrame, g, t: int, rate: float, reg: float) -> DataFrame:
    """One step on the rows of the parameter table (id, w, m, v); the bias isn't regularised."""
    full = state.withColumn("g", g + F.when(F.col("id") == START_ID, F.lit(0.0)).otherwise(F.lit(reg) * F.col("w")))
    m = F.lit(BETA1) * F.col("m") + F.lit(1 - BETA1) * F.col("g")
    v = F.lit(BETA2) * F.col("v") + F.lit(1 - BETA2) * F.col("g") * F.col("g")
    moved = full.select("id", "w", m.alias("m"), v.alias("v"))
    step = F.lit(rate / (1 - BETA1 ** t)) * F.col("m") / (F.sqrt("v") / F.lit((1 - BETA2 ** t) ** 0.5) + F.lit(EPS))
    return moved.select("id", (F.col("w") - step).alias("w"), "m", "v")


def fit_text_lr(train: DataFrame, name: str = "lr", steps: int = STEPS, rate: float = RATE, reg: float = REG, text_col: str = "text",
                label_col: str = "label", key: str = "post_id", block_words: int = BLOCK_WORDS, profile: Profile = DEFAULT_PROFILE) -> TextModel:
    """The fitted model; it is scored, stored and loaded like the other models of terms."""
    spark = train.sparkSession
    rows = train.select(key, F.col(label_col).cast("double").alias("y"), F.col(text_col).alias("text"), *[c for c in (ROW,) if c in train.columns])
    if ROW not in rows.columns:
        rows = with_row_id(rows, ROW)
    vocab = build_vocab(rows)
    encoded = encode_ids(rows, vocab, key=key, carry=("y", ROW)).select("y", ROW, F.expr("slice(input_ids, 1, size(input_ids) - 1)").alias("ids"))
    encoded = materialize(encoded, "lr-posts")
    n, words = encoded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0))).first()
    if not n:
        raise ValueError("no posts to fit on")
    blocks = max(spark.sparkContext.defaultParallelism, -(-words // block_words))
    placed = encoded.withColumn("block", F.pmod(F.xxhash64(ROW), F.lit(blocks)).cast("int"))
    table = f"lr_blocks_{uuid.uuid4().hex}"
    path = scratch_path(spark, "lr-blocks")
    (placed.groupBy("block").agg(F.collect_list(F.struct("y", "ids")).alias("posts"))
     .write.bucketBy(min(blocks, BUCKETS), "block").option("path", path).saveAsTable(table))
    asked = materialize(placed.select("block", F.explode(F.array_distinct("ids")).alias("id")).distinct(), "lr-asked")
    zero = [F.lit(0.0).alias(c) for c in ("w", "m", "v")]
    ids = vocab.select("id").unionByName(spark.range(1).select(F.lit(START_ID).cast("int").alias("id")))
    state = materialize(ids.select("id", *zero), "lr-state")
    try:
        for t in range(1, steps + 1):
            slices = asked.join(state.select("id", "w"), "id").groupBy("block").agg(F.collect_list(F.struct("id", "w")).alias("weights"))
            parts = spark.table(table).join(slices, "block").select("posts", "weights").mapInArrow(_gradients, "id int, g double")
            total = parts.groupBy("id").agg((F.sum("g") / F.lit(float(n))).alias("sum"))
            before = state
            state = materialize(_adam(before.join(total, "id", "left"), F.coalesce("sum", F.lit(0.0)), t, rate, reg), "lr-state")
            discard(spark, before)
    finally:
        spark.sql(f"DROP TABLE {table}")
    bias = state.where(F.col("id") == START_ID).first()["w"]
    weights = materialize(vocab.join(state, "id").select(F.col("token").alias("term"), F.col("w").alias("weight"), "n"), "lr-weights")
    for written in (path, encoded, asked, state, vocab):
        discard(spark, written)
    size = weights.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return TextModel(name, "lr", "word", float(bias), weights, int(size[0]), int(size[1]), profile)
