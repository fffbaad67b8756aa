import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from botsift.llm import simhash
from botsift.llm.common import join_dealt
from botsift.llm.components import connected_components
from botsift.session import materialize


def plain(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    s = [" ".join(w)] if 0 < len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(fps, distance=3):
    n = len(fps)
    head = list(range(n))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_groups(frame, sf_docs):
    rows = sorted(sf_docs[:300] + [(1000, None), (1001, ""), (1002, "  "), (1003, "Two Words"), (1004, "two words"), (1005, sf_docs[0][1].upper())])
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(rows, "doc_id long, text string")).collect()}
    fps = [plain(t) for _, t in rows]
    assert [got[i].fp & (1 << 64) - 1 for i, _ in rows] == fps
    assert [got[i].component_id for i, _ in rows] == [rows[k][0] for k in smallest(fps)]


def test_link_with_split_keys(spark):
    """Dense clouds around few centres: keys far over the limit, which are split once more."""
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = set(base)
    for b in base:
        for _ in range(150):
            x = b
            for _ in range(int(rng.integers(1, 7))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for limit in (3, 100_000):
        edges = simhash.link(df, 3, key_limit=limit)
        label = {r.node & (1 << 64) - 1: r.component for r in connected_components(edges).collect()}
        want = smallest(fps)
        groups = {}
        for f, k in zip(fps, want):
            groups.setdefault(k, set()).add(f)
        many = [g for g in groups.values() if len(g) > 1]
        assert set().union(*many) == set(label)
        assert all(len({label[f] for f in g}) == 1 for g in many)
        assert len({label[min(g)] for g in many}) == len(many)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    hot = connected_components(spark.createDataFrame(edges, "a long, b long"), hot_rows=3).collect()
    assert {r.node: r.component for r in hot} == got


def test_hot_keys_are_dealt_into_parts(spark):
    """A key with most rows, all of them equal, is joined by many tasks; no row is lost or doubled."""
    many = materialize(spark.range(4000).selectExpr("CASE WHEN id % 10 < 9 THEN 7 ELSE id END AS k", "1 AS id"), "t-many")
    one = spark.range(4000).selectExpr("id AS k", "id * 2 AS v", "5 AS part")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = join_dealt(many, one, "k", 100)
        assert got.columns == ["k", "id", "v", "part"]
        per_task = got.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in per_task) < 1200 and len(per_task) >= 6
        assert sorted(map(tuple, got.collect())) == sorted((r.k, 1, r.k * 2, 5) for r in many.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_groups_with_split_keys_and_parts(frame, sf_docs):
    rows = sf_docs[:80] + [(2000 + i, "a copy of many words in one text") for i in range(60)] + [(3000, "a copy of many words in one text")] * 30
    df = frame(rows, "doc_id long, text string")
    columns = ["doc_id", "text_hash", "fp", "component", "component_id"]
    whole = sorted(map(tuple, simhash.near_duplicates(df).select(columns).collect()))
    assert sorted(map(tuple, simhash.near_duplicates(df, hot_rows=7).select(columns).collect())) == whole and len(whole) == len(rows)


def test_hard_rows_one_of_each_and_empty(hard, empty):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == 14
    assert {r.component_id for r in rows if r.fp == 0 and r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id in (5, 6) and r.component_id == 5} == {5}
    kept = simhash.one_of_each(hard)
    assert kept.columns == hard.columns
    kept = kept.collect()
    assert len(kept) == len({r.component for r in rows})
    assert sorted((r.doc_id or 0) for r in kept if r.text and "repeated row" in r.text) == [5]
    assert simhash.near_duplicates(empty).collect() == [] and simhash.one_of_each(empty).collect() == []
