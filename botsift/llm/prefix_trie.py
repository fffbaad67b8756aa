"""Prefix trie of conversations from sorted neighbours and range minima.

A conversation is a path: the 128-bit digests of its turns, one after another (texts aren't carried along). Paths are cut into
ranges of (path, conv_id), so that a first turn, or a group of copies, that holds most conversations is cut as well, and each
range is sorted by one task. There the longest common prefixes of neighbours are put into a sparse table of
range minima. Every candidate prefix (a conversation's first d turns, where its left neighbour doesn't share them) finds the left and
the right end of its members by two binary searches over that table, independently of all other prefixes and without a
stack; sums over a subtree are differences of running sums over the interval.

A range also gets the last path before it and the first path behind it, so it knows which of its nodes go on
in other ranges. These open nodes lie on its two outer paths, so there are at most twice as many as a path has turns; their
partial sums are added by node, all other nodes are complete in their range.

Defined results: a null role or text is empty; turns go by number (null first), equal numbers by digest; rows without a
conv_id belong to no conversation and are left out; an empty table has no node, not even a root; extra columns are left
out. A conversation is one row of 24 bytes a turn, whatever its texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botsift.llm.common import buffer_of, release
from botsift.session import materialize

#: turns (and conversations) of one range
RANGE_TURNS = 100_000
#: conversations of one group share the first turns of the group's first
GROUP = 20
#: as many numbers of shared first turns: 0 to HEADS - 1
HEADS = 4
DIGEST = 16
NODES = ("range int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, n_ends long, ends string, ends_sha256 string")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (digest in hex, words) in the order of the turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    listed = F.array_sort(F.collect_list(F.struct("numbered", "turn", "digest", "words")))
    return rows.groupBy("conv_id").agg(listed.alias("turns")).select("conv_id", F.arrays_zip(
        F.col("turns.digest").alias("digest"), F.col("turns.words").alias("words")).alias("turns"))


def share_heads(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Each conversation with its first h turns taken from the first of its group (h: crc32 of its number modulo
    ``heads``): all if that has fewer, none if it is absent."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    first = conversations.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, max(heads - 1, 1)).alias("head"))
    both = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of conversations as :func:`conversations_of` gives them."""
    return conversations.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words"))


def _ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each length n."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def neighbour_prefixes(digests: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common leading digests of each path and the one before it; from the second path on."""
    shorter = np.minimum(lengths[1:], lengths[:-1])
    if not shorter.sum():
        return shorter
    step = _ragged(shorter)
    same = (digests[np.repeat(starts[:-1], shorter) + step] == digests[np.repeat(starts[1:], shorter) + step]).all(1)
    reach = np.where(same, np.repeat(shorter, shorter), step)  # a place that differs ends the prefix there
    some = shorter > 0
    out = np.zeros(len(shorter), np.int64)
    out[some] = np.minimum.reduceat(reach, (np.cumsum(shorter) - shorter)[some])
    return out


class RangeMinimum:
    """Sparse table: level k holds the minimum of the 2^k values from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of the places first..last."""
        width = last - first + 1
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out

    def left_end(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The leftmost place from which all values up to ``place`` (from the next one on) reach ``bound``."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            first = at - (1 << k) + 1
            can = np.flatnonzero(first >= 1)
            can = can[self.levels[k][first[can]] >= bound[can]]
            at[can] -= 1 << k
        return at

    def right_end(self, place: np.ndarray, bound: np.ndarray, last: int) -> np.ndarray:
        """The rightmost place, ``last`` at most, up to which all values behind ``place`` reach ``bound``."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            can = np.flatnonzero(at + (1 << k) <= last)
            can = can[self.levels[k][at[can] + 1] >= bound[can]]
            at[can] += 1 << k
        return at


def range_nodes(number: int, paths: list[bytes] | pa.Array, words: np.ndarray, ids: np.ndarray, before: bytes | None,
                behind: bytes | None) -> pa.RecordBatch:
    """The nodes of one sorted range as rows of ``NODES``. ``words``: of all turns, one path after another; ``before`` and
    ``behind``: the neighbouring paths outside the range."""
    n = len(ids)
    fenced = pa.array([*([before] if before is not None else []), *paths, *([behind] if behind is not None else [])], pa.large_binary())
    raw, offsets = buffer_of(fenced)
    digests = np.ascontiguousarray(raw[offsets[0] : offsets[-1]]).view(np.uint64).reshape(-1, 2)
    starts, lengths = (offsets[:-1] - offsets[0]) // DIGEST, np.diff(offsets) // DIGEST
    common = neighbour_prefixes(digests, starts, lengths)
    # lcp[i]: turns that conversation i shares with the one before it; -1 where there is none, so that the root starts there
    lcp = np.concatenate([[-1] if before is None else [], common, [-1] if behind is None else []]).astype(np.int64)
    inner = slice(0 if before is None else 1, None if behind is None else -1)
    lengths = lengths[inner]
    turn_at = np.cumsum(lengths) - lengths
    said = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)

    def words_to(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Words of the first d turns of conversation i."""
        return said[turn_at[i] + np.maximum(d, 0)] - said[turn_at[i]]

    whole = words_to(np.arange(n), lengths)
    # candidates: prefixes that the conversation before doesn't share, and those that go on from the range before
    fresh = lengths - lcp[:n]
    at = np.concatenate([np.zeros(lcp[0] + 1, np.int64), np.repeat(np.arange(n), fresh)])
    depth = np.concatenate([np.arange(lcp[0] + 1), _ragged(fresh) + np.repeat(lcp[:n] + 1, fresh)])
    table = RangeMinimum(lcp[:n])
    left, right = table.left_end(at, depth), table.right_end(at, depth, n - 1)
    least_id = RangeMinimum(ids)
    up = np.maximum(depth - 1, 0)
    parent = least_id.least(table.left_end(at, up), table.right_end(at, up, n - 1))

    def total(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[last + 1] - sums[first]

    leaf = lcp[1:] < lengths
    # children: one that starts with the interval, and one for each later conversation that parts from its left neighbour here
    place = np.arange(n)
    parts = np.sort((lcp[:n] * (n + 1) + place)[lengths > lcp[:n]])
    children = ((lengths[left] > depth) & (lcp[left] <= depth)).astype(np.int64)
    children += np.searchsorted(parts, depth * (n + 1) + right, "right") - np.searchsorted(parts, depth * (n + 1) + left, "right")
    # words of all members' turns from the node's own on, less those of each distinct node once
    told = total(whole, left, right) - (right - left + 1) * words_to(left, depth - 1)
    once = whole - words_to(place, lcp[:n])
    own = total(once, left, right) - once[left] + whole[left] - words_to(left, np.maximum(lcp[left], depth - 1))
    # open: shared with the outermost conversation of a side and beyond it
    to_left = np.minimum.accumulate(lcp[:n])
    to_right = np.minimum.accumulate(lcp[:0:-1])[::-1]
    outer = [hashlib.md5(paths[0][: d * DIGEST]).digest() for d in range(lcp[0] + 1)], \
        [hashlib.md5(paths[n - 1][: d * DIGEST]).digest() for d in range(lcp[n] + 1)]

    def keys(d: np.ndarray) -> list[bytes | None]:
        found = np.where(to_left[at] >= d, 0, np.where(to_right[at] >= d, 1, 2))
        return [outer[side][k] if side < 2 and k >= 0 else None for side, k in zip(found.tolist(), d.tolist())]

    key, parent_key = keys(depth), keys(np.where(depth > 0, depth - 1, -1))
    # members that end at a node are the first of its interval
    equal = np.concatenate([[False], (lcp[1:n] == lengths[1:]) & (lengths[1:] == lengths[:-1])])
    run_ends = np.concatenate([np.flatnonzero(~equal)[1:], [n]])
    run_of = np.cumsum(~equal) - 1
    ends_here = lengths[left] == depth
    n_ends = np.where(ends_here, run_ends[run_of[left]] - left, 0)
    listed, digest = [None] * len(at), [None] * len(at)
    for c in np.flatnonzero(ends_here):
        text = ",".join(map(str, ids[left[c] : left[c] + n_ends[c]].tolist()))
        if key[c] is None:
            digest[c] = hashlib.sha256(text.encode()).hexdigest()
        else:
            listed[c] = text
    known = [k is None for k in parent_key]
    columns = {
        "range": pa.array(np.full(len(at), number, np.int32)), "key": pa.array(key, pa.binary()), "parent_key": pa.array(parent_key, pa.binary()),
        "conv_id": pa.array(least_id.least(left, right)), "depth": pa.array(depth),
        "parent_conv_id": pa.array(parent, mask=(depth == 0) | ~np.array(known, bool)),
        "n_convs": pa.array(right - left + 1), "n_children": pa.array(children), "n_leaves": pa.array(total(leaf, left, right)),
        "saved_tokens": pa.array(told - own), "n_ends": pa.array(n_ends), "ends": pa.array(listed, pa.string()),
        "ends_sha256": pa.array(digest, pa.string())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (range, side, path, words, conv_id) to nodes, one range after another."""
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        side = table.column("side").to_numpy()
        first, last = int(np.searchsorted(side, 1)), int(np.searchsorted(side, 2))
        rows = table.slice(first, last - first)
        fences = table.column("path")
        paths = rows.column("path").to_pylist()
        words = rows.column("words").combine_chunks()
        words = words.flatten() if isinstance(words, (pa.ListArray, pa.LargeListArray)) else pa.concat_arrays([c.flatten() for c in words.chunks])
        return range_nodes(rows.column("range")[0].as_py(), paths, words.to_numpy(zero_copy_only=False), rows.column("conv_id").to_numpy(),
                           fences[0].as_py() if first else None, fences[last].as_py() if last < table.num_rows else None)

    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("range").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column("range")[0].as_py() != number[a]:
                yield close()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield close()
    release()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, range, ends) to (key, ends_sha256), the lists of a node one after another; only one is held."""
    last, running = None, None
    for batch in batches:
        keys, done = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != last:
                if last is not None:
                    keys.append(last)
                    done.append(running.hexdigest())
                last, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(done, pa.string())], names=["key", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def trie(paths: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of paths (conv_id long and unique, path, words): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, n_ends and ends_sha256 (members that end here)."""
    paths = materialize(paths, "paths")
    turns = paths.agg(F.coalesce(F.sum(F.size("words").cast("long") + 1), F.lit(0))).first()[0]
    n = max(2 * paths.sparkSession.sparkContext.defaultParallelism, -(-turns // range_turns))
    ranged = materialize(paths.repartitionByRange(n, "path", "conv_id").withColumn("range", F.spark_partition_id()), "path-ranges")
    outer = materialize(ranged.groupBy("range").agg(F.min("path").alias("first"), F.max("path").alias("last")), "range-edges")
    order = Window.orderBy("range")  # one number for each range that has rows
    near = outer.select("range", F.lag("range").over(order).alias("before"), F.lead("range").over(order).alias("behind"))

    def fence(side: int, other: str, path: str) -> DataFrame:
        edge = outer.select(F.col("range").alias(other), F.col(path).alias("path"))
        return near.select("range", other).join(edge, other).select(
            "range", F.lit(side).alias("side"), "path", F.array().cast("array<int>").alias("words"), F.lit(0).cast("long").alias("conv_id"))

    rows = ranged.select("range", F.lit(1).alias("side"), "path", "words", "conv_id")
    rows = rows.unionByName(fence(0, "before", "last")).unionByName(fence(2, "behind", "first"))
    rows = rows.repartition("range").sortWithinPartitions("range", "side", "path", "conv_id")
    nodes = materialize(rows.mapInArrow(_of_ranges, NODES), "range-nodes")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends_sha256"]
    shared = nodes.where(F.col("key").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")]
    merged = materialize(shared.groupBy("key", "depth", "parent_key").agg(F.min("conv_id").alias("conv_id"), *sums), "open-nodes")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    lists = shared.where(F.col("n_ends") > 0).select("key", "range", "ends").repartition("key").sortWithinPartitions("key", "range")
    ends = lists.mapInArrow(_digests, "key binary, ends_sha256 string")
    opened = merged.join(parents, "parent_key", "left").join(ends, "key", "left")
    # a node with an open parent asks for it under its range, so a parent of many children is no hot key
    asked = shared.select("range", F.col("key").alias("parent_key")).distinct().join(parents, "parent_key")
    closed = nodes.where(F.col("key").isNull())
    below = closed.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(asked, ["range", "parent_key"])
    found = opened.select(out).unionByName(below.select(out)).unionByName(closed.where(F.col("parent_key").isNull()).select(out))
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def conversation_trie(turns: DataFrame, group: int = GROUP, heads: int = HEADS, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The trie of rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(paths_of(share_heads(conversations_of(turns), group, heads)), range_turns)


ORACLE = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
turns AS (
  SELECT conv_id, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list(struct_pack(digest := digest, words := words) ORDER BY turn NULLS FIRST, digest) AS t,
         xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii((conv_id::VARCHAR)[k])::BIGINT)),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM turns, crc GROUP BY conv_id, tab),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN c.h = 0 THEN [] ELSE coalesce(b.t, [])[1:c.h] END, c.t[c.h + 1:]) AS t
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (
  SELECT conv_id, len(t) AS n, d, md5(array_to_string(list_transform(t[1:d], lambda x: x.digest), '')) AS k,
         CASE WHEN d > 0 THEN t[d].words ELSE 0 END AS words
  FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, count(*) FILTER (n > d) = 0 AS leaf,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends
  FROM prefixes GROUP BY d, k),
above AS (
  SELECT a.d AS ad, a.k AS ak, x.d, x.k, x.words, x.n_convs, x.leaf, x.conv_id
  FROM nodes x JOIN prefixes a ON a.conv_id = x.conv_id AND a.d <= x.d),
sums AS (
  SELECT ad AS d, ak AS k, count(*) FILTER (d = ad + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM above GROUP BY ad, ak)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, s.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens,
       sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x JOIN sums s ON s.d = x.d AND s.k = x.k
LEFT JOIN (SELECT a.d, a.k, n.conv_id, a.ad, a.ak FROM above a JOIN nodes n ON n.d = a.ad AND n.k = a.ak) p ON p.d = x.d AND p.k = x.k AND p.ad = x.d - 1
"""
