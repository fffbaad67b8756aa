"""Global rank without a single-partition window (used by N6 batches).

Rows are range-partitioned on the order key and sorted inside each partition; each row gets
(partition, position) from ``monotonically_increasing_id``. The per-partition counts (one row
per partition) give each partition's offset, so rank = offset + position + 1. The ranged data is
written once as parquet in the shared folder so that the ids cannot change between the two passes
(range bounds come from sampling).

Hot keys: the range is taken over (order key, input row id), so rows that share an order key --
even exact copies holding a third of the table -- are cut across several range partitions
instead of landing in one task. The input row id is written with the rows before they are ranged,
so a re-executed task sees the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botsift.session import materialize
from botsift.sources.rows import ROW

_MID, _PID, _TIE = "_rank_mid", "_rank_pid", "_rank_tie"
_LOW_BITS = 33


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """``df`` with a number for each row that stays the same in every later job and attempt: the numbered
    rows are written to the shared folder once (a number given in the middle of a plan would change
    when a task behind a shuffle is run again, or in a second branch of the plan)."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def by_row(df: DataFrame, columns: list[str], name: str = "_rid") -> DataFrame:
    """The columns with a number for each row: the one from the scan where ``df`` carries it, else a written one."""
    if ROW in df.columns:
        return df.select(F.col(ROW).alias(name), *columns)
    return with_row_id(df.select(*columns), name)


def ranged_layout(df: DataFrame, order_cols, n_parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted on (order_cols, input row id), with ``_rank_mid`` =
    (range partition << 33) + position, written once to the shared folder."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keyed = with_row_id(df, _TIE)
    ranged = (keyed.repartitionByRange(n_parts, *cols, F.col(_TIE)).sortWithinPartitions(*cols, _TIE)
              .withColumn(_MID, F.monotonically_increasing_id()).drop(_TIE))
    return materialize(ranged, "ranked")


def global_rank(df: DataFrame, order_cols, rank_col: str = "rank", n_parts: int | None = None) -> DataFrame:
    ranged = ranged_layout(df, order_cols, n_parts)
    pid = F.shiftright(F.col(_MID), _LOW_BITS)
    counts = ranged.groupBy(pid.alias(_PID)).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: a bounded broadcast
    joined = ranged.join(F.broadcast(offsets), pid == F.col(_PID))
    pos = F.col(_MID).bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return joined.withColumn(rank_col, (F.col("_off") + pos + 1).cast("bigint")).drop(_MID, _PID, "_off")


def assign_batches(df: DataFrame, batch_size: int = 16, shuffled: bool = False, key: str = "post_id",
                   seed: int = 42, batch_col: str = "batch") -> DataFrame:
    """Consecutive batches of ``batch_size`` in a global order (the last one may be short):
    by key for evaluation, by md5(seed:key) for a repeatable training shuffle."""
    from botsift.functions.numeric import hash_key

    order = [hash_key(seed, key), F.col(key)] if shuffled else [F.col(key)]
    ranked = global_rank(df.withColumn("_ord", order[0]) if shuffled else df,
                         ["_ord", key] if shuffled else [key])
    out = ranked.withColumn(batch_col, F.floor((F.col("rank") - 1) / batch_size).cast("bigint"))
    return out.drop("_ord") if shuffled else out
