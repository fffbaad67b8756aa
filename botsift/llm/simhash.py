"""SimHash near-dedup with pigeonhole blocks.

Fingerprints: every word shingle's XXH64 votes on 64 bits. Linking: each distinct fingerprint is
cut into ``max_distance + 2`` blocks; two fingerprints within ``max_distance`` bits differ in at
most that many blocks, so they agree in two blocks at least, and each pair of blocks with its
bits is a join key (10 keys of 25 or 26 bits for distance 3). Members of a key are compared on
all 64 bits. A key with more than ``KEY_LIMIT`` members is split once more: the bits outside its
two blocks are cut into twice as many pieces as may differ, and any half of these pieces with
its bits is a key of its own, which leaves a group no more than the free bits allow, whatever the
size of the corpus. A group yields the edges of a spanning forest, never its pairs.

Defined results: a null text is the empty text; a text without words has fingerprint 0 and links
like any other; texts of fewer words than the shingle length are one shingle. Repeated rows give a
row each. A null id takes part, but is never the smallest id of a component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from botsift.llm.common import HOT_ROWS, id_and_text, join_dealt, steps, unused
from botsift.llm.components import connected_components
from botsift.session import materialize

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: members of a key that are compared with each other without a further split
KEY_LIMIT = 1024
#: parts that counts of one fingerprint or key are combined in first
SALTS = 16


def fingerprint(text: bytes, words: int) -> int:
    """Fingerprint of one text: ASCII lower case, words between ASCII white space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        line = b" ".join(w)
        lengths = np.fromiter(map(len, w), np.int64, len(w))
        stops = np.cumsum(lengths + 1) - 1
        starts = (stops - lengths)[: len(w) - words + 1].tolist()
        shingles = [line[a:b] for a, b in zip(starts, stops[words - 1 :].tolist())]
    n, votes = len(shingles), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(s, 42) for s in shingles[i : i + (1 << 16)]], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): the 64-bit fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fps = [fingerprint(t, words) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _cut(bits: list[int], pieces: int) -> list[list[int]]:
    """Bit places dealt into so many runs of nearly equal length."""
    edges = [len(bits) * i // pieces for i in range(pieces + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _keys(masks: list[int]) -> Column:
    """Array of (mask number, kept bits) of the fingerprint column."""
    return F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])


def _forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the values within ``distance`` bits of each other: a
    breadth-first walk in which every step compares one value with those not reached yet."""
    left, heads, tails = values, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                hit = left[near]
                left = left[~near]
                heads.append(np.full(len(hit), x))
                tails.append(hit)
                front.extend(hit)
    if not heads:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(heads).view(np.int64), np.concatenate(tails).view(np.int64)


def _linked(members: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """(a, b): forest edges inside each key. Rows are brought together by key and read as a sorted
    stream; only one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def flush():
            a, b = _forest(np.concatenate(held).view(np.uint64), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], 1)
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(fps)]):
                here = cols[a].tolist()
                if here != last and held:
                    if sum(map(len, held)) > 1:
                        yield from flush()
                    held = []
                last = here
                held.append(fps[a:b])
        if sum(map(len, held)) > 1:
            yield from flush()

    return members.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(run, "a long, b long")


def link(distinct: DataFrame, distance: int = MAX_DISTANCE, key_limit: int = KEY_LIMIT) -> DataFrame:
    """(a, b): edges that join all distinct fingerprints (column fp) within ``distance`` bits into
    the same components as all pairs would."""
    blocks = _cut(list(range(64)), distance + 2)
    chosen = list(combinations(range(distance + 2), 2))
    members = distinct.select("fp", F.explode(_keys([_mask(blocks[i] + blocks[j]) for i, j in chosen])).alias("k")).select("k.m", "k.bits", "fp")
    sizes = members.groupBy("m", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    sizes = sizes.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    members = materialize(salted.join(sizes, ["m", "bits", "salt"]).drop("salt"), "block-members")
    edges = _linked(members.where(F.col("n") <= key_limit), ["m", "bits"], distance)
    finer = []
    for number, (i, j) in enumerate(chosen):
        free = [b for k, block in enumerate(blocks) if k not in (i, j) for b in block]
        pieces = _cut(free, 2 * distance)
        masks = [_mask(sum(some, [])) for some in combinations(pieces, distance)]
        finer.append(F.when(F.col("m") == number, _keys(masks)))
    hot = members.where(F.col("n") > key_limit).select("m", "bits", "fp", F.explode(F.coalesce(*finer)).alias("k"))
    hot = hot.select("m", "bits", F.col("k.m").alias("m2"), F.col("k.bits").alias("bits2"), "fp")
    return edges.unionByName(_linked(hot, ["m", "bits", "m2", "bits2"], distance))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row: fingerprints within ``distance`` bits are
    linked; component is the smallest fingerprint and component_id the smallest id that can be reached."""
    rows = fingerprints(docs, words, id_col, text_col)
    rows = materialize(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "fingerprints")
    shares = materialize(rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "fingerprint-shares")
    distinct = shares.groupBy("fp").agg(F.min("least").alias("least"))
    nodes = connected_components(link(distinct.select("fp"), distance), hot_rows=hot_rows)
    placed = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = materialize(placed, "fingerprint-placed")
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(join_dealt(placed, heads, "component", hot_rows).select("fp", "component", "component_id"), "fingerprint-components")
    return join_dealt(rows.drop("salt"), named, "fp", hot_rows).select("doc_id", "text_hash", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) of which one stays in each component: the smallest id
    (null last), then the smallest hash of the text; of wholly equal rows one."""
    found = near_duplicates(docs, words, distance)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    *keys, number = unused(docs.columns, "none", "id", "hash", "number")
    first = first.select(F.col("k.none").alias(keys[0]), F.coalesce("k.doc_id", F.lit(0)).alias(keys[1]), F.col("k.text_hash").alias(keys[2]))
    rows = docs.select(
        "*", F.col("doc_id").isNull().alias(keys[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[1]),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(keys[2]))
    kept = rows.join(first, keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return kept.withColumn(number, place).where(F.col(number) == 1).drop(*keys, number)
