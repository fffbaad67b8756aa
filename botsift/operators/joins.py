"""Joins against a side whose size is known: broadcast only below a checked bound.

The bound is on rows AND on bytes: term and token strings have no length limit (a junk document
can hold one 100k-character "word"), so a row count alone does not bound the size of what every
executor receives. The byte figure is the summed string length plus a per-row overhead for the
hashed relation.

Beyond the bound a table of terms is cut by frequency: the most frequent terms, as many as the bound
allows (exactly: from a histogram of the frequencies), are broadcast, and the rest is joined by shuffle.
Both joins follow each other in ONE branch, so the posts are read once, and occurrences that the
broadcast has settled (or that have no term) have no key in the second join: they are spread
evenly by their rows' hash and match nothing.

Occurrences are looked up by a 64-bit hash of their key (Spark's hashed relations are fastest with one long, and so is its sort for the
join by shuffle), and the key itself is compared too, so two keys of one hash stay two. Most occurrences the broadcast leaves over are in no table at all (word pairs nobody
has written before): a bitmap over the hashes of the tail, some bits for each term, is broadcast too and says of most of them that the tail
can't hold them. They are settled then, and no longer shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a model / vocabulary table that may be shipped to every executor.
MAX_BROADCAST_ROWS = 1_000_000
# Bytes of such a table (string bytes + per-row overhead) that may be shipped to every executor.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64
# Steps of the frequency histogram for each doubling of the frequency.
STEPS_PER_DOUBLING = 8
# Keys that settled occurrences are spread over.
SPREAD = 1 << 20
# Bits of the tail's bitmap for each term, if MAX_BITMAP_BYTES allow, and bits in each of its blocks (as a power of two).
BITS_PER_TERM = 16
MAX_BITMAP_BYTES = MAX_BROADCAST_BYTES // 4
BLOCK_LOG2 = 15


def size_of(df: DataFrame, str_cols) -> tuple[int, int]:
    """(rows, estimated bytes) of ``df`` in one aggregate."""
    lens = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in str_cols]
    total = sum(lens[1:], lens[0]) if lens else F.lit(0)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0) + int(r["n"]) * ROW_OVERHEAD_BYTES


def fits(rows: int, nbytes: int | None, max_rows: int = MAX_BROADCAST_ROWS,
         max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return rows <= max_rows and (nbytes is None or nbytes <= max_bytes)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", small_rows: int | None = None,
               max_rows: int = MAX_BROADCAST_ROWS, str_cols=(), max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``small`` when its rows (known, or counted here) and, for string columns
    ``str_cols``, its bytes are within the bounds; otherwise a shuffle join, left to AQE (which
    also splits skewed keys)."""
    nbytes = None
    if str_cols:
        small_rows, nbytes = size_of(small, str_cols)
    elif small_rows is None:
        small_rows = small.count()
    if fits(small_rows, nbytes, max_rows, max_bytes):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def hot_and_tail(table: DataFrame, str_col: str, freq_col: str, max_rows: int, max_bytes: int,
                 total_rows: int | None = None, total_bytes: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(hot, tail): the most frequent terms that fit into the bounds, and the rest (None where empty).
    The cut lies between two steps of a histogram of log2(frequency) with rows and bytes per step,
    so the hot side never exceeds the bounds; a few hundred rows reach the driver."""
    if total_rows is None or (total_rows <= max_rows and total_bytes is None):
        total_rows, total_bytes = size_of(table, [str_col])
    if fits(total_rows, total_bytes, max_rows, max_bytes):
        return table, None
    freq = F.greatest(F.col(freq_col), F.lit(1))
    step = F.floor(F.log2(freq) * STEPS_PER_DOUBLING).cast("int")
    steps = table.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(str_col)).alias("b"), F.min(freq).alias("least")).orderBy(F.desc("step")).collect()
    rows = nbytes = 0
    cut = None
    for s in steps:
        rows, nbytes = rows + s["n"], nbytes + (s["b"] or 0) + s["n"] * ROW_OVERHEAD_BYTES
        if not fits(rows, nbytes, max_rows, max_bytes):
            break
        cut = s["least"]
    if cut is None:
        return None, table
    return table.filter(freq >= cut), table.filter(freq < cut)


def key_hash(columns) -> Column:
    """The long that a key is looked up by."""
    return F.xxhash64(*columns)


def bitmap_blocks(rows: int, max_bytes: int = MAX_BITMAP_BYTES) -> int:
    """Blocks of a bitmap for so many keys."""
    return max(1, min(-(-rows * BITS_PER_TERM >> BLOCK_LOG2), max_bytes * 8 >> BLOCK_LOG2))


def _bit_of(hashed: Column, blocks: int) -> Column:
    return F.pmod(hashed, F.lit(blocks << BLOCK_LOG2))


def key_bitmap(table: DataFrame, on: list[str], blocks: int) -> DataFrame:
    """(block, words): the bits of the keys of ``table``, as longs, in each of the blocks."""
    bit = _bit_of(key_hash(F.col(c) for c in on), blocks).alias("_bit")
    none = table.sparkSession.range(blocks << BLOCK_LOG2 - 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    some = table.select(bit).select(F.shiftright("_bit", 6).alias("word"), F.expr("shiftleft(1L, cast(_bit & 63 as int))").alias("bits"))
    words = some.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = words.groupBy(F.shiftright("word", BLOCK_LOG2 - 6).alias("block")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("listed"))
    return listed.select("block", F.col("listed.bits").alias("words"))


def _may_be_in(words: str, bit: Column) -> Column:
    word = F.get(F.col(words), F.shiftright(bit, 6).bitwiseAND(F.lit((1 << BLOCK_LOG2 - 6) - 1)).cast("int"))
    return F.coalesce(F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))


def _looked_up(big: DataFrame, table: DataFrame, on: list[str], keys: list[str], hashed: Column, value_col: str, name: str, broadcast: bool) -> DataFrame:
    """Left join to a table of terms by ``hashed``; adds its value as ``name``. ``keys``: the columns of ``big`` that hold the key ``on``; they
    are compared as ranges, which leaves the hash the only join key. The table's hash is an expression of the join, not a column to shuffle."""
    types = dict(big.dtypes)
    table = table.select(*[F.col(c).cast(types[k]).alias(f"{name}_{c}") for c, k in zip(on, keys)], F.col(value_col).alias(name))
    found = hashed == key_hash(F.col(f"{name}_{c}") for c in on)
    for c, k in zip(on, keys):
        found = found & (F.col(k) >= F.col(f"{name}_{c}")) & (F.col(k) <= F.col(f"{name}_{c}"))
    return big.join(F.broadcast(table) if broadcast else table, found, "left").drop(*[f"{name}_{c}" for c in on])


def join_terms(big: DataFrame, hot: DataFrame | None, tail: DataFrame | None, on: list[str], value_col: str,
               spread_cols: list[str], sum_by: list[str] | None = None, bitmap: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Left join of term occurrences to a term table cut by :func:`hot_and_tail`; adds ``value_col``.

    ``on``: key columns, the last one the term. With ``sum_by`` occurrences are added up: one row for each
    ``sum_by`` + ``on`` group comes out, all settled occurrences of a ``sum_by`` row in one, and the value is the
    group's sum; only these sums are shuffled to the tail. ``bitmap``: :func:`key_bitmap` of the tail and its blocks, so that
    occurrences the tail can't hold count as settled."""
    term = on[-1]
    settled = F.col(term).isNull()
    big = big.withColumn("_hash", key_hash(F.col(c) for c in on))
    if hot is not None:
        big = _looked_up(big, hot, on, on, F.col("_hash"), value_col, "_hot", broadcast=True)
        settled = settled | F.col("_hot").isNotNull()
    else:
        big = big.withColumn("_hot", F.lit(None).cast(dict(tail.dtypes)[value_col]))
    if tail is None:
        return big.drop("_hash").withColumnRenamed("_hot", value_col)
    if bitmap is not None:
        bit = _bit_of(F.col("_hash"), bitmap[1])
        big = big.withColumn("_block", F.when(~settled, F.shiftright(bit, BLOCK_LOG2)))
        big = big.join(F.broadcast(bitmap[0].select(F.col("block").alias("_block"), F.col("words").alias("_words"))), "_block", "left")
        settled = settled | ~_may_be_in("_words", bit)
    big = big.withColumn("_key", F.when(~settled, F.col(term)))
    big = big.drop("_hash", "_block", "_words")
    if sum_by is not None:
        big = big.groupBy(*sum_by, *on[:-1], "_key").agg(F.sum("_hot").alias("_hot"), F.count(F.lit(1)).alias("_times"))
    keys = [*on[:-1], "_key"]
    hashed = F.when(F.col("_key").isNull(), F.pmod(F.xxhash64(*spread_cols), F.lit(SPREAD))).otherwise(key_hash(F.col(c) for c in keys))
    joined = _looked_up(big, tail, on, keys, hashed, value_col, "_tail", broadcast=False)
    value = F.col("_tail") * F.col("_times") if sum_by is not None else F.col("_tail")
    joined = joined.withColumn(value_col, F.coalesce("_hot", value))
    return joined.drop("_key", "_hot", "_tail", "_times")
