"""Blocks: runs of whole texts of bounded size that travel as one compressed row.

Operators that gather keys from all texts and send an answer back to each text work on blocks: what a
block asks is deduplicated inside it, so a key that is in a third of all texts costs a block one entry,
and rows are dealt out by shard (a hash of the key) and by block, never by the key alone. A block has at most one message for a
shard, and none where it has no key for it, so there are no more messages than keys, of a few bytes each where they are short. The blocks
are written once; their numbers stay valid for all later jobs, also when a task is run again.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.common import buffer_of, id_and_text, release, steps
from botsift.session import scratch_path

#: text bytes of a block; a longer text is a block of its own
BLOCK_BYTES = 6 << 20
#: level of the compression of what travels
LEVEL = 6
#: text bytes of one row of a block
PART_BYTES = 1 << 19
SCHEMA = "kind string, block long, shard int, payload binary"


#: types of columns that a short message holds; its bytes, up to which it isn't worth compressing
_KINDS = [pa.int8(), pa.uint8(), pa.int16(), pa.uint16(), pa.int32(), pa.uint32(), pa.int64(), pa.uint64(), pa.float32(), pa.float64(),
          pa.bool_(), pa.string(), pa.binary(), pa.large_string(), pa.large_binary()]
_WIDE = 10
SHORT = 1024
_MARK = b"S"


def _short(batch: pa.RecordBatch) -> bytes | None:
    """A few values with a frame of a few bytes: an Arrow stream's own frame is some hundred, which counts where most blocks have
    little to say to a shard. None where the batch is longer, or of other types."""
    if batch.nbytes > SHORT or any(c.type not in _KINDS or c.null_count for c in batch.columns):
        return None
    out = [_MARK, struct.pack("<BH", batch.num_columns, batch.num_rows)]
    for name, col in zip(batch.schema.names, batch.columns):
        kind = _KINDS.index(col.type)
        out.append(struct.pack("<BB", kind, len(name.encode())) + name.encode())
        if kind < _WIDE:
            out.append(col.to_numpy(zero_copy_only=False).tobytes())
        elif kind == _WIDE:
            out.append(bytes(col.to_pylist()))
        else:
            values = [v.encode() if isinstance(v, str) else v for v in col.to_pylist()]
            out.append(np.array([len(v) for v in values], "<u2").tobytes() + b"".join(values))
    return b"".join(out)


def _from_short(payload: bytes) -> pa.RecordBatch:
    columns, n = struct.unpack_from("<BH", payload, 1)
    at, names, arrays = 4, [], []
    for _ in range(columns):
        kind, size = struct.unpack_from("<BB", payload, at)
        names.append(payload[at + 2 : at + 2 + size].decode())
        at += 2 + size
        if kind < _WIDE:
            values = np.frombuffer(payload, _KINDS[kind].to_pandas_dtype(), n, at)
            at += values.nbytes
        elif kind == _WIDE:
            values = np.frombuffer(payload, np.bool_, n, at)
            at += n
        else:
            ends = at + 2 * n + np.concatenate([[0], np.cumsum(np.frombuffer(payload, "<u2", n, at), dtype=np.int64)])
            values = [payload[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            values = [v.decode() for v in values] if pa.types.is_string(_KINDS[kind]) or pa.types.is_large_string(_KINDS[kind]) else values
            at = int(ends[-1])
        arrays.append(pa.array(values, _KINDS[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(**columns) -> bytes:
    """Arrays of one length as bytes: compressed Arrow, or a short message of their values."""
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    short = _short(batch)
    if short is not None:
        return short
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    if payload[:1] == _MARK:
        return _from_short(payload)
    return pa.ipc.open_stream(payload).read_next_batch()


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def rising(values: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, which compress better."""
    return np.diff(values, prepend=values[:1] * 0)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A block's text rows as one batch."""
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def texts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a block's texts, counted from its first."""
    raw, offsets = buffer_of(batch.column(1))
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows(kind: str, block: list[int], shard: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(block), pa.string()), pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(payload, pa.binary())],
        names=["kind", "block", "shard", "payload"])


def write_blocks(docs: DataFrame, ask: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]], name: str,
                 block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Write the texts in blocks, with what ``ask`` (block number, rows) yields for each of them, and
    read all of it back. Texts are rows of kind ``text``: id, text and the columns ``carry``, in this order; a block's
    texts come in several rows, numbered by ``shard``, which stay small for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def close():
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            block = table.to_batches()[0]
            for i, part in enumerate(steps(block, block.schema.names[1], PART_BYTES)):
                yield rows("text", [number], [i], [pack(**{str(k): c for k, c in enumerate(part.columns)})])
            yield from ask(number, block)
            number, held, size = number + 1, [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = buffer_of(batch.column(1))[1]
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[start] + block_bytes - size, side="right")) - 1
                if stop <= start and held:
                    yield from close()
                    continue
                stop = min(max(stop, start + 1), batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size += int(offsets[stop] - offsets[start])
                start = stop
                if size >= block_bytes:
                    yield from close()
        if held:
            yield from close()
        release()

    spark = docs.sparkSession
    path = scratch_path(spark, name)
    texts = id_and_text(docs, id_col, text_col, carry)
    texts.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").partitionBy("kind").parquet(path)
    return spark.read.schema("block long, shard int, payload binary, kind string").parquet(path)


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Runs of rows of equal key in a sorted stream, each as an iterator of row dicts that has to be
    used up before the next; only one Arrow batch is held."""
    names = None
    pending: list = [None]

    def source():
        nonlocal names
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                yield {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}

    it = source()
    pending[0] = next(it, None)

    def group(value):
        while pending[0] is not None and pending[0][key] == value:
            row, pending[0] = pending[0], next(it, None)
            yield row

    while pending[0] is not None:
        value = pending[0][key]
        part = group(value)
        yield value, part
        for _ in part:
            pass
    release()


def by_shard(df: DataFrame, *more: str) -> DataFrame:
    """Rows brought together by shard, in the order of ``more`` inside it."""
    return df.repartition("shard").sortWithinPartitions("shard", *more)


def by_block(df: DataFrame) -> DataFrame:
    """Rows brought together by block, in the order of their kinds and numbers."""
    return df.repartition("block").sortWithinPartitions("block", "kind", "shard")


def shard_count(docs: DataFrame, text_col: str, bytes_each: int) -> int:
    """Shards in proportion to the text, and enough to use the cluster."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // bytes_each))
