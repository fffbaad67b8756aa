"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.session import materialize

#: bytes of text that one Python step holds at a time (a single longer text is a step of its own)
STEP_BYTES = 2 << 20
#: rows of one key that a join leaves together
HOT_ROWS = 100_000


def remainder(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(modulus)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Only the id and the text (null: empty) under fixed names, whatever else the table holds; the columns
    ``carry`` behind them, as carried_0, carried_1, ..."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)],
    )


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it differ from all of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_dealt(many: DataFrame, one: DataFrame, key: str | list[str], limit: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Inner join of ``many``, a table read from files, to ``one`` (a row per key at most). A key with more than ``limit`` rows is
    dealt into parts of about that size by the rows' places in the table, and its row of ``one`` is copied to each part; other
    keys stay as they are. The list of such keys, no longer than the rows of ``many`` by ``limit``, is broadcast. ``rows``: how many
    rows ``many`` has at most, where that is known; no key can have more."""
    key = [key] if isinstance(key, str) else list(key)
    parts, part = unused([*many.columns, *one.columns], "parts", "part")
    if rows is not None and rows <= limit:
        return many.join(one, key)
    counts = many.groupBy(*key).agg(F.count(F.lit(1)).alias(parts))
    if (counts.agg(F.max(parts)).first()[0] or 0) <= limit:
        return many.join(one, key)
    hot = counts.where(F.col(parts) > limit)
    hot = materialize(hot.select(*key, F.ceil(F.col(parts) / F.lit(limit)).cast("int").alias(parts)), "hot-keys")
    n = F.coalesce(F.col(parts), F.lit(1))
    left = many.join(F.broadcast(hot), key, "left").withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), n).cast("int")).drop(parts)
    right = one.join(F.broadcast(hot), key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return left.join(right, [*key, part]).drop(part)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose texts sum to about ``limit`` bytes."""
    n = batch.num_rows
    if not n:
        return
    offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))[1]
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give freed memory back to the system: a worker that goes on with another operator keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls (no copy)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row's list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class Slots:
    """Open-address table of distinct codes (64-bit, not all ones): ``index`` gives the place of a slot's code, -1
    for an empty slot."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes) * 3).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.codes = np.full(1 << self.bits, self.EMPTY)
        self.index = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._home(codes), np.arange(len(codes))
        while len(left):
            free = self.index[slot[left]] < 0
            self.index[slot[left[free]]] = left[free]  # of several for one slot the last stays
            left = left[self.index[slot[left]] != left]
            slot[left] = slot[left] + np.uint64(1) & self.mask
        used = self.index >= 0
        self.codes[used] = codes[self.index[used]]

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each code, or the empty slot where the search for it ends."""
        slot = self._home(codes)
        there = self.codes[slot]
        left = np.flatnonzero((there != codes) & (there != self.EMPTY))
        while len(left):
            slot[left] = slot[left] + np.uint64(1) & self.mask
            there = self.codes[slot[left]]
            left = left[(there != codes[left]) & (there != self.EMPTY)]
        return slot
