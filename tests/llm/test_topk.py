import math

import numpy as np
import pytest

from botsift.llm import topk


def brute(rows, top=5):
    vs = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vs.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = set()
    for q, a in {(i, tuple(v)) for i, v in vs if i % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vs if i != q and len(b) == len(a))[:top]
        out |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    return out


def run(df, **options):
    return [tuple(r) for r in topk.top_products(df, "vec_id % 50 = 0", **options).collect()]


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 16}, {"group_bytes": 4000, "bucket_rows": 7}, {"part_queries": 2}, {"part_queries": 1, "group_bytes": 9000}])
def test_hard_rows(frame, options):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, rng.choice([0.05, 1.0, 4.0]), 8).tolist()) for i in range(400)]
    tight = rng.normal(0, 1, 8)
    rows += [(500 + i, (tight + rng.normal(0, 0.05, 8)).tolist()) for i in range(200)]
    rows += [(1000 + i, [0.25] * 8) for i in range(20)] + [(1100, [0.0] * 8), (1101, [-0.25] * 8), (1150, [1.0, 2.0]), (1151, [3.0, 4.0]), (1200, [])]
    rows += [(2000, None), (2001, [1.0, None]), (2050, [math.nan] * 8), (2100, [math.inf] * 8), (None, [1.0] * 8), (50, rows[50][1]), (2151, rows[0][1])]
    got = run(frame(rows, "vec_id long, embedding array<float>"), **options)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_numbers_and_empty(frame):
    rows = [(0, [3e6, 1.0]), (50, [-3e6, 2.0]), (51, [3e6, 3.0])]
    assert set(run(frame(rows, "vec_id long, embedding array<float>"))) == brute(rows)
    assert run(frame([], "vec_id long, embedding array<float>")) == []


def test_prunings_keep_all_that_reach_the_bound():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (500, 6))
    rows[:100] = np.array([200, 10, -50, 30, 0, 5]) + rng.integers(-9, 9, (100, 6))
    b = topk.Bucket(np.arange(500), rows.astype(np.int64))
    for q in np.concatenate([rng.integers(-200, 200, (60, 6)), rows[:60]]):
        products = b.rows @ q
        for share in (0.2, 0.6, 0.9, 0.99, 1.0, 1.2):
            bound = share * np.linalg.norm(q) * b.longest
            got = b.candidates(q.astype(float), float(np.linalg.norm(q)), bound)
            need = set(np.flatnonzero(products >= bound).tolist())
            assert need <= set([] if got is None else got.tolist())


def test_no_task_answers_most_queries(spark):
    """All queries open in the group of the longest vectors: they are dealt over tasks, which a task's share of answers shows."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(1, 8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        topk_opening = []
        real = topk.materialize

        def noting(table, name):
            if name == "first-answers":
                table = table.withColumn("task", F.spark_partition_id())
            out = real(table, name)
            if name == "first-answers":
                topk_opening.extend(out.groupBy("task").agg(F.countDistinct("query_id").alias("n")).collect())
                out = out.drop("task")
            return out

        topk.materialize = noting
        assert set(run(df, part_queries=8)) == brute(rows)
    finally:
        topk.materialize = real
        for k, v in old.items():
            spark.conf.set(k, v)
    counts = [r.n for r in topk_opening]
    assert sum(counts) == 159 and max(counts) <= 40 and len(counts) >= 8
