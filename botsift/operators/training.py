"""Training the head (G1-G5): log-loss, epoch loss, closed-form gradient, AdamW, fit loop.

The gradient of the mean log-loss of the two-layer head is summed per partition in numpy
(``mapInArrow``): one dense vector per task, added up in a tree of at most ``TREE_PARTS`` tasks, whose vectors
reach the driver for the AdamW step (the size of the model, not of the data).
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.config import DROPOUT, LEARNING_RATE, SEED
from botsift.functions.numeric import bce, hash_key
from botsift.operators.head import HeadWeights, np_keep, np_sigmoid, row_seed
from botsift.session import discard, scratch_path
from botsift.sinks.publish import get, names, put, remove

# AdamW defaults (published formulas): betas, eps, weight decay.
BETA1, BETA2, EPS, WEIGHT_DECAY = 0.9, 0.999, 1e-8, 0.01

# Tasks that add up the vectors of the gradient tasks, and vectors that reach the driver.
TREE_PARTS = 32


def bce_loss(p, y) -> Column:
    return bce(p, y)


def epoch_loss(df: DataFrame, loss_col: str = "loss", batch_col: str = "batch") -> DataFrame:
    """Mean of the batch means (a short last batch weighs as much as a full one)."""
    per_batch = df.groupBy(batch_col).agg(F.avg(loss_col).alias("_m"))
    return per_batch.agg(F.avg("_m").alias("epoch_loss"), F.count(F.lit(1)).alias("n_batches"))


def _vector_sum(batches):
    """Sum of the vectors of a task (bytes of doubles) as one vector."""
    total = None
    for batch in batches:
        for v in batch.column("v"):
            x = np.frombuffer(v.as_py(), np.float64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])


def gradient_sums(df: DataFrame, w: HeadWeights, emb_col: str = "embedding", label_col: str = "label",
                  seed_col: str | None = None, rate: float = DROPOUT) -> np.ndarray:
    """Summed gradient of the log-loss in the order of ``HeadWeights.flat``, then the number of rows and
    the summed loss. With ``seed_col`` (see :func:`row_seed`) the forward pass is in train mode, with dropout."""
    n_params = w.flat().size

    def part(batches):
        g = np.zeros(n_params + 2)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(n, w.d_in).astype(np.float64)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            z1 = x @ w.W1 + w.b1
            keep = np_keep(batch.column(2).to_numpy(zero_copy_only=False), w.width, rate) if seed_col else 1.0
            h = np.maximum(z1, 0.0) * keep
            p = np_sigmoid(h @ w.w2 + w.b2)
            d2 = p - y                                   # d loss / d z2 per row
            dh = np.outer(d2, w.w2) * (z1 > 0) * keep    # d loss / d z1
            n1 = w.W1.size
            g[:n1] += (x.T @ dh).ravel()
            g[n1:n1 + w.width] += dh.sum(axis=0)
            g[n1 + w.width:n1 + 2 * w.width] += h.T @ d2
            g[n1 + 2 * w.width] += d2.sum()
            g[n_params] += n
            pc = np.clip(p, 1e-300, 1.0)
            qc = np.clip(1.0 - p, 1e-300, 1.0)
            g[n_params + 1] += float(-(y * np.maximum(np.log(pc), -100.0)
                                       + (1 - y) * np.maximum(np.log(qc), -100.0)).sum())
        if g[n_params]:
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["v"])

    rows = df.select(emb_col, label_col, *([seed_col] if seed_col else []))
    sums = rows.mapInArrow(part, "v binary").repartition(TREE_PARTS).mapInArrow(_vector_sum, "v binary").collect()
    return sum((np.frombuffer(r["v"], np.float64) for r in sums), np.zeros(n_params + 2))


def head_gradient(df: DataFrame, w: HeadWeights, **kw) -> DataFrame:
    """(param, idx, grad): gradient of the MEAN log-loss over ``df``."""
    sums = gradient_sums(df, w, **kw)
    n = sums[-2]
    if not n:
        raise ValueError("gradient over zero rows")
    rows = HeadWeights.from_flat(sums[:-2] / n, w.d_in, w.width).long_rows()
    return df.sparkSession.createDataFrame(rows, "param string, idx int, grad double")


def adamw_columns(theta: Column, g: Column, m: Column, v: Column, t: int, lr: float = LEARNING_RATE,
                  wd: float = WEIGHT_DECAY, b1: float = BETA1, b2: float = BETA2, eps: float = EPS):
    """One AdamW step as Column expressions: (theta', m', v'). Decay first, then the Adam update."""
    m1 = F.lit(b1) * m + F.lit(1 - b1) * g
    v1 = F.lit(b2) * v + F.lit(1 - b2) * g * g
    bc1, bc2 = 1 - b1 ** t, 1 - b2 ** t
    denom = F.sqrt(v1) / F.lit(float(np.sqrt(bc2))) + F.lit(eps)
    theta1 = theta * F.lit(1 - lr * wd) - F.lit(lr / bc1) * m1 / denom
    return theta1, m1, v1


@dataclass
class AdamState:
    m: np.ndarray
    v: np.ndarray
    t: int = 0


def adamw_step(theta: np.ndarray, g: np.ndarray, state: AdamState, lr: float = LEARNING_RATE,
               wd: float = WEIGHT_DECAY, b1: float = BETA1, b2: float = BETA2, eps: float = EPS) -> np.ndarray:
    """Same step on the driver's parameter vector (size of the model, not of the data)."""
    state.t += 1
    state.m = b1 * state.m + (1 - b1) * g
    state.v = b2 * state.v + (1 - b2) * g * g
    bc1, bc2 = 1 - b1 ** state.t, 1 - b2 ** state.t
    denom = np.sqrt(state.v) / np.sqrt(bc2) + eps
    return theta * (1 - lr * wd) - (lr / bc1) * state.m / denom


class StepLog:
    """Finished steps of a training run in the shared folder: after each step one small file with the weights, both moments, the
    step number and the losses so far, which appears as a whole. ``settings``: what the run depends on; a log of other settings is an
    error. The two newest files stay."""

    def __init__(self, spark, path: str, settings: dict):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), json.loads(json.dumps(settings))

    def last(self) -> tuple[int, np.ndarray, AdamState, list] | None:
        """(steps done, parameters, state, history) of the newest finished step."""
        found = names(self.spark, self.path, "*.json")
        if not found:
            return None
        entry = json.loads(get(self.spark, f"{self.path}/{found[-1]}"))
        if entry["settings"] != self.settings:
            raise ValueError(f"{self.path}: the log is of a run with other settings: {entry['settings']}")
        theta, m, v = (np.frombuffer(base64.b64decode(entry[c]), "<f8").copy() for c in ("theta", "m", "v"))
        return entry["steps"], theta, AdamState(m, v, entry["t"]), [tuple(h) for h in entry["history"]]

    def add(self, steps: int, theta: np.ndarray, state: AdamState, history: list) -> None:
        vectors = {c: base64.b64encode(np.ascontiguousarray(x, "<f8").tobytes()).decode() for c, x in (("theta", theta), ("m", state.m), ("v", state.v))}
        put(self.spark, f"{self.path}/{steps:09d}.json", json.dumps({"settings": self.settings, "steps": steps, "t": state.t, "history": history, **vectors}))
        for name in names(self.spark, self.path, "*.json")[:-2]:
            remove(self.spark, f"{self.path}/{name}")


def fit_head(df: DataFrame, w0: HeadWeights, epochs: int = 1, steps_per_epoch: int = 16, lr: float = LEARNING_RATE,
             emb_col: str = "embedding", label_col: str = "label", key: str = "post_id", seed: int = SEED,
             rate: float = DROPOUT, log_path: str | None = None):
    """Mini-batch AdamW in train mode. Every epoch deals the rows anew into ``steps_per_epoch`` batches by a
    hash of (seed, epoch, key), so the number of steps, and of jobs, doesn't grow with the table: a larger table has
    larger batches, which all executors work on. An epoch's rows are written once, in a folder for each batch, so
    that a step opens its own files only; a step returns only the gradient. Without ``rate`` there is no
    dropout. Returns (weights, history rows (epoch, step, batch_loss)). With ``log_path`` every finished step is logged
    there (:class:`StepLog`), and a run that finds a log goes on behind its last step, with the batches and the dropout that the
    step would have had."""
    spark = df.sparkSession
    theta = w0.flat()
    state = AdamState(np.zeros_like(theta), np.zeros_like(theta))
    history, done = [], 0
    log = None
    if log_path:
        log = StepLog(spark, log_path, {"steps_per_epoch": steps_per_epoch, "lr": lr, "seed": seed, "rate": rate, "key": key, "embedding": emb_col,
                                        "label": label_col, "start": hashlib.sha256(np.ascontiguousarray(theta, "<f8").tobytes()).hexdigest()})
        done, theta, state, history = log.last() or (0, theta, state, history)
    shape = f"{emb_col} array<float>, {label_col} int, _seed bigint, _batch int"
    for ep in range(done // steps_per_epoch, epochs):
        order = F.conv(F.substring(hash_key(f"{seed}:{ep}", key), 1, 8), 16, 10).cast("bigint")
        batch = F.pmod(order, F.lit(steps_per_epoch)).cast("int")
        rows = df.select(key, F.col(emb_col).cast("array<float>"), F.col(label_col).cast("int"), batch.alias("_batch"))
        rows = rows.withColumn("_seed", row_seed(key, seed, F.col("_batch") + ep * steps_per_epoch)).drop(key)
        path = scratch_path(spark, "head-batches")
        rows.hint("rebalance", F.col("_batch")).write.partitionBy("_batch").parquet(path)
        data = spark.read.schema(shape).parquet(path)
        for b in range(max(0, done - ep * steps_per_epoch), steps_per_epoch):
            w = HeadWeights.from_flat(theta, w0.d_in, w0.width)
            sums = gradient_sums(data.filter(F.col("_batch") == b), w, emb_col, label_col, "_seed" if rate else None, rate)
            n = sums[-2]
            if n:
                history.append((ep, b, float(sums[-1] / n)))
                theta = adamw_step(theta, sums[:-2] / n, state, lr=lr)
            if log:
                log.add(ep * steps_per_epoch + b + 1, theta, state, history)
        discard(spark, path)
    return HeadWeights.from_flat(theta, w0.d_in, w0.width), history
