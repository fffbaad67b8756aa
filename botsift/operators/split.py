"""Deterministic stratified train / test split.

Contract: exactly ``q_c`` posts of class ``c`` go to test, where the quotas are
``t = ceil(share * n)``, ``floor(t * n_c / n)`` per class and the remainder to the largest
fractions (ties to the smaller label); inside a class the test posts are those with the smallest
``(md5('<seed>:' || key), key)``. The result does not depend on partitioning or row order.

Scale: ordering a class is never done in one task. Because the order is by hash, the test part
of a class is a prefix of the hash order, i.e. everything up to one cutoff ``(h*, key*)``:

1. histogram of (class, first 4 hex digits of the hash) -> at most 65,536 rows per class;
2. running sums over that histogram locate the bucket holding the cutoff;
3. only the rows of that bucket (~n_c / 65,536) are ranked to find the cutoff row; a bucket
   above ``max_edge_rows`` is first narrowed by the next hex digits (one small histogram per
   round), so the ranked rows stay bounded at any table size;
4. the split column is then a narrow comparison with per-class literals: no join, no shuffle.

Keys are expected to be unique. Rows sharing a key always land on the same side (so with
duplicates a quota can be overshot by the copies of the cutoff key); a heavily repeated key never
lands in one task, because the boundary bucket is reduced to distinct keys before it is ranked.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botsift.functions.numeric import hash_key, hex_uniform
from botsift.session import materialize

H, B = "_split_h", "_split_b"
BUCKET_HEX = 4
REFINE_HEX = 4
MAX_EDGE_ROWS = 2_000_000
MAX_CLASSES = 256


def stratified_quotas(class_counts: dict, share: float) -> dict:
    """Test rows per class: ceil(share*n) in total, floors per class, remainder to largest fractions."""
    n = sum(class_counts.values())
    if n == 0:
        return {}
    t = math.ceil(share * n)
    floors = {c: (t * k) // n for c, k in class_counts.items()}
    rems = {c: (t * k) % n for c, k in class_counts.items()}
    r = t - sum(floors.values())
    for c in sorted(class_counts, key=lambda c: (-rems[c], c))[:r]:
        floors[c] += 1
    return floors


def _class_pred(label_col: str, c) -> Column:
    return F.col(label_col).isNull() if c is None else F.col(label_col) == F.lit(c)


def _in_bucket(prefix: str) -> Column:
    return F.substring(F.col(H), 1, len(prefix)) == F.lit(prefix)


def _refine_edges(keyed: DataFrame, edges, label_col: str, max_edge_rows: int):
    """Narrow a boundary bucket holding more than ``max_edge_rows`` rows to the sub-bucket (next
    REFINE_HEX hex digits) that holds its k-th row, so that the final ranking sees about
    ``max_edge_rows`` rows whatever the table size. Each round is one filtered scan of the keys and
    a histogram of at most 16**REFINE_HEX rows per class. A round that no longer shrinks the
    bucket (one heavily repeated key fills it) ends the refinement: copies of a key are one
    row in the ranking, so what is ranked then is a few distinct keys."""
    edges = list(edges)
    while True:
        big = [e for e in edges if e[3] > max_edge_rows and len(e[1]) < 32]
        if not big:
            return edges
        cond = reduce(lambda a, b: a | b, [_class_pred(label_col, e[0]) & _in_bucket(e[1]) for e in big])
        plen = {e[0]: min(32, len(e[1]) + REFINE_HEX) for e in big}
        sub_b = reduce(lambda acc, e: acc.when(_class_pred(label_col, e[0]), F.substring(F.col(H), 1, plen[e[0]])),
                       big[1:], F.when(_class_pred(label_col, big[0][0]), F.substring(F.col(H), 1, plen[big[0][0]])))
        # the sub-bucket of each class that holds its k-th row, found in Spark: one row per class comes back
        k_col = reduce(lambda acc, e: acc.when(_class_pred("_y", e[0]), F.lit(e[2])), big[1:],
                       F.when(_class_pred("_y", big[0][0]), F.lit(big[0][2])))
        sub = keyed.filter(cond).groupBy(F.col(label_col).alias("_y"), sub_b.alias("_sb")).agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.partitionBy("_y").orderBy("_sb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sub = sub.withColumn("_incl", F.sum("_n").over(upto)).withColumn("_k", k_col)
        sub = sub.filter((F.col("_incl") >= F.col("_k")) & (F.col("_incl") - F.col("_n") < F.col("_k")))
        found = {r["_y"]: (r["_y"], r["_sb"], r["_k"] - (r["_incl"] - r["_n"]), r["_n"]) for r in sub.collect()}
        out = [e for e in edges if e not in big] + [found.get(e[0], e) for e in big]
        shrunk = any(c in found and found[c][3] < n for c, _, _, n in big)
        edges = out
        if not shrunk:
            return edges


def split_stratified_exact(df: DataFrame, label_col: str = "label", key_col: str = "post_id",
                           seed: int = 42, test_share: float = 0.2, split_col: str = "split",
                           bucket_hex: int = BUCKET_HEX, max_edge_rows: int = MAX_EDGE_ROWS) -> DataFrame:
    # everything but the last step works on (class, key, hash), written once: the texts are read once more, at the end
    keyed = materialize(df.select(label_col, key_col, hash_key(seed, key_col).alias(H)), "split-keys")
    keyed = keyed.withColumn(B, F.substring(F.col(H), 1, bucket_hex))

    # 1. bounded histogram (map-side combined), materialised once in the shared folder
    hist = keyed.groupBy(label_col, B).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label_col).orderBy(B).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_incl", F.sum("_n").over(w)).withColumn("_before", F.col("_incl") - F.col("_n"))
    hist = materialize(hist, "split-hist")

    counts = {r[0]: r[1] for r in hist.groupBy(label_col).agg(F.sum("_n")).limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes; a stratified split expects a class label")
    if None in counts:
        raise ValueError("null labels: drop incomplete rows before splitting")
    quotas = stratified_quotas(counts, test_share)

    # 2. the bucket that holds the q-th row of each class, the rank k inside it and its size
    quota_col = reduce(lambda acc, c: acc.when(_class_pred(label_col, c), F.lit(quotas[c])),
                       list(quotas)[1:], F.when(_class_pred(label_col, list(quotas)[0]), F.lit(quotas[list(quotas)[0]])))
    edges = [(r[0], r[1], r[2], r[3]) for r in
             hist.withColumn("_q", quota_col)
             .filter((F.col("_before") < F.col("_q")) & (F.col("_q") <= F.col("_incl")))
             .select(label_col, B, (F.col("_q") - F.col("_before")).alias("_k"), "_n").collect()]
    edges = _refine_edges(keyed, edges, label_col, max_edge_rows)

    # 3. inside those buckets, the k-th row of the class in (hash, key) order. Rows are first
    #    collapsed to distinct keys with their counts (map-side combined), so even a key repeated
    #    in a third of all rows is one row here; the running sum then finds the cutoff key.
    cutoffs = {}
    if edges:
        in_edge = reduce(lambda a, b: a | b, [_class_pred(label_col, r[0]) & _in_bucket(r[1]) for r in edges])
        k_col = reduce(lambda acc, r: acc.when(_class_pred(label_col, r[0]), F.lit(r[2])), edges[1:],
                       F.when(_class_pred(label_col, edges[0][0]), F.lit(edges[0][2])))
        distinct = keyed.filter(in_edge).groupBy(label_col, H, key_col).agg(F.count(F.lit(1)).alias("_c"))
        rw = Window.partitionBy(label_col).orderBy(H, key_col).rowsBetween(Window.unboundedPreceding,
                                                                            Window.currentRow)
        run = distinct.withColumn("_cum", F.sum("_c").over(rw))
        cut_rows = (run.filter((F.col("_cum") >= k_col) & (F.col("_cum") - F.col("_c") < k_col))
                    .select(label_col, H, key_col).collect())
        cutoffs = {r[0]: (r[1], r[2]) for r in cut_rows}

    # 4. narrow: test iff (h, key) <= the class cutoff
    is_test = F.lit(False)
    for c, qc in quotas.items():
        if qc <= 0:
            continue
        if qc >= counts[c]:
            cond = F.lit(True)
        else:
            h_cut, k_cut = cutoffs[c]
            cond = (F.col(H) < F.lit(h_cut)) | ((F.col(H) == F.lit(h_cut)) & (F.col(key_col) <= F.lit(k_cut)))
        is_test = is_test | (_class_pred(label_col, c) & cond)
    rows = df.withColumn(H, hash_key(seed, key_col))
    return rows.withColumn(split_col, F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop(H)


def split_stratified_hash(df: DataFrame, key_col: str = "post_id", seed: int = 42, test_share: float = 0.2,
                          split_col: str = "split") -> DataFrame:
    """Incremental / streaming form: test iff the hash falls in the lowest ``share`` of its range.
    Per-row and stateless (no shuffle), so class shares are only approximately kept."""
    u = hex_uniform(hash_key(seed, key_col))
    return df.withColumn(split_col, F.when(u < F.lit(float(test_share)), F.lit("test")).otherwise(F.lit("train")))


def split_counts(df: DataFrame, label_col: str = "label", split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
