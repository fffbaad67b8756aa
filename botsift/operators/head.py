"""Feed-forward head over embeddings (M1-M5, M7): CLS pooling -> dense+ReLU -> (dropout) ->
dense+sigmoid.

Maths runs in numpy on Arrow batches through ``predict_batch_udf`` (one Python call per batch,
weights shipped once per task in the closure: they are ~8.4k numbers, independent of the data).
Dropout draws its mask in the same batches from md5(seed:step:key), so a retried task repeats it exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.config import DROPOUT, HEAD_WIDTH, SEED

PARAMS = ("W1", "b1", "w2", "b2")


@dataclass
class HeadWeights:
    W1: np.ndarray   # [d_in, width]
    b1: np.ndarray   # [width]
    w2: np.ndarray   # [width]
    b2: float

    @property
    def d_in(self) -> int:
        return self.W1.shape[0]

    @property
    def width(self) -> int:
        return self.W1.shape[1]

    def flat(self) -> np.ndarray:
        """Parameter vector in (W1 row-major, b1, w2, b2) order: index = the ``idx`` of the long form."""
        return np.concatenate([self.W1.ravel(), self.b1, self.w2, [self.b2]])

    @staticmethod
    def from_flat(v: np.ndarray, d_in: int, width: int) -> "HeadWeights":
        n1 = d_in * width
        return HeadWeights(v[:n1].reshape(d_in, width).copy(), v[n1:n1 + width].copy(),
                           v[n1 + width:n1 + 2 * width].copy(), float(v[n1 + 2 * width]))

    def long_rows(self):
        """(param, idx, value) rows, the layout used by gradients and stored weights."""
        rows = [("W1", int(i), float(x)) for i, x in enumerate(self.W1.ravel())]
        rows += [("b1", int(i), float(x)) for i, x in enumerate(self.b1)]
        rows += [("w2", int(i), float(x)) for i, x in enumerate(self.w2)]
        rows.append(("b2", 0, float(self.b2)))
        return rows


def fixture_weights(d_in: int = 64, width: int = HEAD_WIDTH) -> HeadWeights:
    """Deterministic test weights, zero biases:
    W1[i][j] = ((i*31 + j*17) % 101 - 50) / 250, w2[j] = ((j*13) % 29 - 14) / 50."""
    i = np.arange(d_in)[:, None]
    j = np.arange(width)[None, :]
    W1 = ((i * 31 + j * 17) % 101 - 50) / 250.0
    w2 = ((np.arange(width) * 13) % 29 - 14) / 50.0
    return HeadWeights(W1.astype(np.float64), np.zeros(width), w2.astype(np.float64), 0.0)


def fixture_param_value(param: Column, idx: Column, width: int = HEAD_WIDTH) -> Column:
    """The fixture weights as a Column of (param, idx): lets Spark build the parameter table."""
    i, j = F.floor(idx / width), idx % width
    w1 = ((i * 31 + j * 17) % 101 - 50) / 250.0
    w2 = ((idx * 13) % 29 - 14) / 50.0
    return F.when(param == "W1", w1).when(param == "w2", w2).otherwise(F.lit(0.0)).cast("double")


# ------------------------------------------------------------------ numpy kernels (per Arrow batch)

def np_sigmoid(z: np.ndarray) -> np.ndarray:
    out = np.empty_like(z, dtype=np.float64)
    pos = z >= 0
    out[pos] = 1.0 / (1.0 + np.exp(-z[pos]))
    ez = np.exp(z[~pos])
    out[~pos] = ez / (1.0 + ez)
    return out


def np_hidden(x: np.ndarray, w: HeadWeights) -> np.ndarray:
    return np.maximum(x.astype(np.float64) @ w.W1 + w.b1, 0.0)


def np_head(x: np.ndarray, w: HeadWeights) -> np.ndarray:
    return np_sigmoid(np_hidden(x, w) @ w.w2 + w.b2)


# ------------------------------------------------------------------ Spark columns

def chunk_states(emb, n_seq: int = 4, hidden: int = 16) -> Column:
    """[seq x hidden] token states from a flat vector (the fixture's stand-in for encoder output)."""
    e = F.col(emb) if isinstance(emb, str) else emb
    return F.transform(F.sequence(F.lit(0), F.lit(n_seq - 1)), lambda k: F.slice(e, k * hidden + 1, hidden))


def cls_pool(states) -> Column:
    """State of position 0."""
    s = F.col(states) if isinstance(states, str) else states
    return F.element_at(s, 1)


def _batch_udf(make_fn, return_type, d: int, batch_size: int):
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_fn, return_type=return_type, batch_size=batch_size, input_tensor_shapes=[[d]])


def dense_relu(emb, w: HeadWeights, batch_size: int = 4096) -> Column:
    """max(0, x W1 + b1) per post, as array<double>."""
    def make():
        return lambda x: np_hidden(x, w)
    return _batch_udf(make, T.ArrayType(T.DoubleType()), w.d_in, batch_size)(emb)


def dense_sigmoid(hidden, w: HeadWeights, batch_size: int = 4096) -> Column:
    """sigmoid(w2 . h + b2) from the hidden layer."""
    def make():
        return lambda h: np_sigmoid(h.astype(np.float64) @ w.w2 + w.b2)
    return _batch_udf(make, T.DoubleType(), w.width, batch_size)(hidden)


def score_head(emb, w: HeadWeights, batch_size: int = 4096) -> Column:
    """Embedding -> probability (CLS vector -> dense+ReLU -> dense+sigmoid); eval mode, no dropout."""
    def make():
        return lambda x: np_head(x, w)
    return _batch_udf(make, T.DoubleType(), w.d_in, batch_size)(emb)


def row_seed(key, seed, step) -> Column:
    """The number that a row's mask is drawn from: the first 8 hex digits of md5(seed:step:key)."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    step = step if isinstance(step, Column) else F.lit(step)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), step.cast("string"), F.lit(":"), k))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


# Fixed values of the mask's generator: a spread of the units, then two multiplicative steps modulo 2^31 - 1.
UNIT_STRIDE, MODULUS, STEP_1, STEP_2 = 2654435761, 2147483647, 48271, 69621


def np_keep(seeds: np.ndarray, width: int, rate: float) -> np.ndarray:
    """Factor of each unit: 0 where its draw is under ``rate``, else 1 / (1 - rate)."""
    x = (seeds.astype(np.int64)[:, None] + (np.arange(width, dtype=np.int64) + 1) * UNIT_STRIDE) % (1 << 32)
    draw = (x * STEP_1 % MODULUS) * STEP_2 % MODULUS / float(MODULUS)
    return np.where(draw < rate, 0.0, 1.0 / (1.0 - rate))


def dropout_mask(hidden, key, seed: int = SEED, step: int = 0, rate: float = DROPOUT, width: int = HEAD_WIDTH,
                 batch_size: int = 4096) -> Column:
    """Training-time dropout on a hidden layer: the mask is drawn in the numpy batch from one number per row
    (:func:`row_seed`), so task retries repeat it; survivors are scaled by 1/(1-rate)."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        return lambda h, s: h * np_keep(s, width, rate)
    fn = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes={0: [width]})
    return fn(F.col(hidden) if isinstance(hidden, str) else hidden, row_seed(key, seed, step))


def score_external(cols, make_predict_fn, return_type=T.DoubleType(), batch_size: int = 4096,
                   input_tensor_shapes=None) -> Column:
    """Any user-supplied batch model (e.g. a pretrained encoder + head where one is installed).
    ``make_predict_fn()`` is called once per Python worker and returns ``f(*numpy arrays)``."""
    from pyspark.ml.functions import predict_batch_udf

    cols = cols if isinstance(cols, (list, tuple)) else [cols]
    fn = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                           input_tensor_shapes=input_tensor_shapes)
    return fn(*cols)


def write_head(spark, w: HeadWeights, path: str) -> None:
    """Head weights in long form (param, idx, value) with the two sizes; ~8.4k rows whatever the data size."""
    rows = [(*r, w.d_in, w.width) for r in w.long_rows()]
    spark.createDataFrame(rows, "param string, idx int, value double, d_in int, width int").coalesce(1) \
        .write.mode("overwrite").parquet(path)


def read_head(spark, path: str) -> HeadWeights:
    """Read the stored head back (model-sized, collected once, then shipped with the scoring UDF)."""
    rows = spark.read.parquet(path).collect()
    d_in, width = rows[0]["d_in"], rows[0]["width"]
    first = {"W1": 0, "b1": d_in * width, "w2": d_in * width + width, "b2": d_in * width + 2 * width}
    v = np.zeros(d_in * width + 2 * width + 1)
    for r in rows:
        v[first[r["param"]] + r["idx"]] = r["value"]
    return HeadWeights.from_flat(v, d_in, width)
