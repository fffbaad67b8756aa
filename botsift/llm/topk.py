"""Exact top-k search by norm-bucketed retrieval.

Vectors are dealt into groups by length (a range over length and id, so that equal lengths are cut
by id), and inside a group into buckets of at most ``BUCKET_ROWS`` vectors in order of length.
The queries first meet the group of longest vectors, which gives each a lower bound of its k-th
score. Then a query goes to those groups only whose greatest length can still reach its bound.
For each bucket the bound becomes a local cosine threshold: above one the bucket is left out; a low one
prunes by length (only the vectors long enough are multiplied); a high one prunes by coordinate
(only the vectors whose value at the query's strongest coordinate lies in the feasible region
are). Every product that is left is computed in whole numbers, so the result is exact.

A group is bounded by ``GROUP_BYTES``. Where many queries go to a group (all of them open in that of the longest vectors), they are
dealt into parts of about ``PART_QUERIES``, and the group is copied to each: no task answers more. Nothing is broadcast but one
row of bounds per group.

Defined results: vectors that are null or hold null or non-finite components, and rows without
id, take no part. Vectors of unequal dimension aren't compared. Repeated query rows are one query;
repeated candidate rows are candidates each. All rows of the query's own id are left out. Products are
64-bit whole numbers (wrapping beyond). Extra columns are left out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from botsift.session import materialize

TOP = 5
BUCKET_ROWS = 4096
GROUP_BYTES = 48 << 20
QUERY_BATCH = 256
#: queries that one task answers from one group
PART_QUERIES = 256
#: local cosine threshold from which a bucket is pruned by coordinate instead of length
COORDINATE_FROM = 0.6
SCALE = 256.0


def whole_vectors(table: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, dim, norm, v): components floor(scale * x) as 64-bit numbers in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column("vec_id"), batch.column("v")
            keep, dims, norms, blobs = [], [], [], []
            for i in range(batch.num_rows):
                x = col[i].values if col[i].is_valid else None
                if x is None or x.null_count:
                    continue
                x = np.floor(scale * x.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(x).all() or (np.abs(x) >= 2.0**63).any():
                    continue
                keep.append(i)
                dims.append(len(x))
                norms.append(float(np.sqrt((x * x).sum())))
                blobs.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep, pa.int32())), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(blobs, pa.binary())],
                names=["vec_id", "dim", "norm", "v"])

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.mapInArrow(run, "vec_id long, dim int, norm double, v binary")


def _product(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole-number products of rows of m with rows of q (int64 both): by floats where these are exact."""
    big = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(m.shape[1], 1)
    if big < 2.0**52:
        return (m.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return m @ q.T


class Bucket:
    """Vectors of similar length, longest first, with what the two prunings need."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.rows, self.norms = ids[order], rows[order], norms[order]
        self.longest = float(self.norms[0]) if len(ids) else 0.0
        unit = self.rows / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        self.by_coordinate = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
        self.sorted_unit = np.take_along_axis(unit, self.by_coordinate.T, 0).T.copy()

    def candidates(self, q: np.ndarray, length: float, bound: float) -> np.ndarray | None:
        """Rows that can reach the bound; None: none can. A slack covers rounding of the lengths."""
        reach = length * self.longest
        if bound <= 0 or reach <= 0:  # no product below the bound can be told by lengths
            return np.arange(len(self.ids)) if bound <= reach + 1e-6 else None
        local = bound / reach
        if local > 1 + 1e-9:
            return None
        if local < COORDINATE_FROM:
            return np.arange(int(np.searchsorted(-self.norms, -(bound / length) * (1 - 1e-9), side="right")))
        f = int(np.argmax(np.abs(q)))
        at, local = q[f] / length, min(local, 1.0) * (1 - 1e-9)
        wide = np.sqrt(max(0.0, (1 - local * local) * (1 - at * at))) + 1e-9
        # the angle to the axis differs from the query's by no more than the angle that is left
        low = -1.0 if at <= -local else at * local - wide
        high = 1.0 if at >= local else at * local + wide
        a, b = np.searchsorted(self.sorted_unit[f], [low - 1e-9, high + 1e-9])
        return self.by_coordinate[f][a:b]


def _better(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, top: int):
    """The top rows of both by score, ties to the smaller id."""
    i, s = np.concatenate([best[0], ids]), np.concatenate([best[1], scores])
    if len(s) > 4 * top:
        cut = np.partition(s, len(s) - top)[len(s) - top]
        near = s >= cut
        i, s = i[near], s[near]
    order = np.lexsort((i, ~s))[:top]
    return i[order], s[order]


def _search(top: int, bucket_rows: int):
    """Task body: rows of a group come first (kind 0), then the queries of one part (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, buckets, queries = None, [], None, []

        def answer():
            nonlocal queries, buckets, held
            if buckets is None:
                buckets = []
                for a in range(0, len(held), bucket_rows):
                    part = held[a : a + bucket_rows]
                    buckets.append(Bucket(np.array([h[0] for h in part], np.int64), np.stack([np.frombuffer(h[1], "<i8") for h in part])))
                held = []
            out_q, out_k, out_v, out_s = [], [], [], []
            for qid, blob, bound in queries:
                q = np.frombuffer(blob, "<i8")
                length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
                best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for b in buckets:
                    least = bound if len(best[1]) < top else max(bound, float(best[1][-1]))
                    rows = b.candidates(q.astype(np.float64), length, least) if least > -np.inf else np.arange(len(b.ids))
                    if rows is None or not len(rows):
                        continue
                    rows = rows[b.ids[rows] != qid]
                    scores = _product(b.rows[rows], q[None, :])[:, 0]
                    near = scores >= least
                    best = _better(best, b.ids[rows][near], scores[near], top)
                out_q += [qid] * len(best[0])
                out_k += [blob] * len(best[0])
                out_v.append(best[0])
                out_s.append(best[1])
            queries = []
            if out_q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_q, pa.int64()), pa.array(out_k, pa.binary()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))],
                    names=["query_id", "q", "vec_id", "score"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "dim", "part", "kind", "vec_id", "v", "bound")]
            for g, dim, part, kind, vid, blob, bound in zip(*cols):
                if (g, dim, part) != group:
                    if queries:
                        yield from answer()
                    group, held, buckets = (g, dim, part), [], None
                if kind == 0:
                    held.append((vid, blob))
                else:
                    queries.append((vid, blob, -np.inf if bound is None else float(bound)))
                    if len(queries) >= QUERY_BATCH:
                        yield from answer()
        if queries:
            yield from answer()

    return run


def top_products(table: DataFrame, queries: str, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding",
                 scale: float = SCALE, bucket_rows: int = BUCKET_ROWS, group_bytes: int = GROUP_BYTES,
                 part_queries: int = PART_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that the SQL condition ``queries`` (over vec_id) picks,
    the ``top`` greatest inner products with the vectors of all other rows."""
    spark = table.sparkSession
    rows = materialize(whole_vectors(table, id_col, vec_col, scale), "whole-vectors")
    size = rows.agg(F.coalesce(F.sum(F.length("v") + 16), F.lit(0))).first()[0]
    groups = max(spark.sparkContext.defaultParallelism, -(-size // group_bytes))
    dealt = rows.repartitionByRange(groups, F.col("dim"), F.col("norm").desc(), F.col("vec_id")).withColumn("grp", F.spark_partition_id())
    dealt = materialize(dealt, "length-groups")
    reach = materialize(dealt.groupBy("grp", "dim").agg(F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n")), "group-lengths")
    asked = rows.where(queries).dropDuplicates(["vec_id", "v"])
    first = reach.groupBy("dim").agg(F.max_by("grp", F.struct("longest", "n")).alias("grp"))

    def search(ask: DataFrame) -> DataFrame:
        """Answers of (grp, dim, vec_id, v, bound) rows in their groups."""
        shape = ["grp", "dim", "part", "kind", "norm", "vec_id", "v", "bound"]
        ask = materialize(ask, "asked")
        parts = ask.groupBy("grp", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_queries)).cast("int").alias("parts"))
        parts = materialize(parts, "asked-parts")  # a row per group
        there = dealt.join(F.broadcast(parts), ["grp", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        there = there.withColumn("kind", F.lit(0)).withColumn("bound", F.lit(None).cast("long")).select(shape)
        mine = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
        both = there.unionByName(ask.join(F.broadcast(parts), ["grp", "dim"]).withColumn("part", mine).withColumn("kind", F.lit(1)).select(shape))
        tasks = max(groups, parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0])
        both = both.repartition(tasks, "grp", "dim", "part").sortWithinPartitions("grp", "dim", "part", "kind", F.desc("norm"), "vec_id")
        return both.mapInArrow(_search(top, bucket_rows), "query_id long, q binary, vec_id long, score long")

    opening = search(asked.join(first, "dim").withColumn("bound", F.lit(None).cast("long")))
    opening = materialize(opening, "first-answers")
    bounds = opening.groupBy("query_id", "q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    bounds = bounds.where(F.col("n") >= top).select(F.col("query_id").alias("vec_id"), F.col("q").alias("v"), F.col("s").alias("bound"))
    rest = asked.join(bounds, ["vec_id", "v"], "left").join(reach.drop("n"), "dim")
    rest = rest.join(first, ["grp", "dim"], "left_anti")
    rest = rest.where(F.col("bound").isNull() | (F.col("norm") * F.col("longest") * F.lit(1 + 1e-9) + F.lit(1e-6) >= F.col("bound")))
    found = opening.unionByName(search(rest.select("grp", "dim", "norm", "vec_id", "v", "bound")))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""
