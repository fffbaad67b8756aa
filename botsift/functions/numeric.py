"""Numeric expressions: overflow-safe sigmoid, log-loss, threshold, hash-derived uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the log-loss clamps each log term at -100 so that p in {0, 1} stays finite.
LOG_FLOOR = -100.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_sigmoid(z) -> Column:
    """1/(1+e^-z) without overflow for large |z| (naive-Bayes logits reach thousands)."""
    z = _c(z)
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def bce(p, y) -> Column:
    """-(y ln p + (1-y) ln(1-p)) with each log clamped from below."""
    p, y = _c(p), _c(y)
    lp = F.greatest(F.log(p), F.lit(LOG_FLOOR))
    lq = F.greatest(F.log(1.0 - p), F.lit(LOG_FLOOR))
    # log(0) is null in Spark; the clamp keeps it finite
    lp = F.coalesce(lp, F.lit(LOG_FLOOR))
    lq = F.coalesce(lq, F.lit(LOG_FLOOR))
    return -(y * lp + (1 - y) * lq)


def predict_threshold(p, threshold: float = 0.5) -> Column:
    """1 iff p > threshold strictly (0.5 -> 0)."""
    return (_c(p) > F.lit(threshold)).cast("int")


def hash_key(seed, *parts) -> Column:
    """md5 of 'seed:part1:part2...' as lower-case hex (same value in DuckDB's md5)."""
    pieces = [F.lit(f"{seed}")]
    for p in parts:
        pieces += [F.lit(":"), _c(p).cast("string")]
    return F.md5(F.concat(*pieces))


def hex_uniform(h) -> Column:
    """A uniform number in [0, 1) from the first 8 hex digits of a hash."""
    return F.conv(F.substring(_c(h), 1, 8), 16, 10).cast("bigint") / F.lit(float(16 ** 8))


def round6(c) -> Column:
    return F.round(_c(c), 6)
