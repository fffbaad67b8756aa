"""Rows told apart by the scan: the same numbers in every job, file layout and attempt, and no copy of the texts."""

import os

from pyspark.sql import functions as F
from table_dirs import SF_SMALL

from botsift.operators.encode import build_vocab, encode_ids
from botsift.operators.registry import fit_all_models
from botsift.operators.textmodels import score_models
from botsift.plans import catalog
from botsift.session import scratch_path, shared_dir
from botsift.sources import tables
from botsift.sources.rows import ROW, joined_row, with_scan_rows


def _written(spark):
    """Folders of written copies in the shared folder."""
    return {n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith("numbered-")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scores(df):
    return sorted((r.post_id, r.label, *(round(r[c], 9) for c in df.columns if c.startswith("p_"))) for r in df.collect())


def test_scoring_and_encoding_write_no_copy(spark):
    sp = catalog.split_posts(spark, SF_SMALL)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    models, vocab = fit_all_models(train), build_vocab(train)
    before = _written(spark)
    scored, ids = score_models(test, models), encode_ids(sp, vocab)
    for df in (scored, ids):
        assert df.count() and "numbered-" not in _plan(df) and "monotonically_increasing_id" not in _plan(df)
    assert _written(spark) == before
    # without identities the numbers are written, with the same result
    assert _scores(score_models(test.drop(ROW), models)) == _scores(scored)
    assert sorted(map(tuple, encode_ids(sp.drop(ROW), vocab).collect())) == sorted(map(tuple, ids.collect()))
    assert len(_written(spark)) > len(before)


def test_numbers_stay_over_files_jobs_and_tasks(spark):
    path = scratch_path(spark, "t-rows")
    spark.range(5000).withColumn("text", F.lit("same text")).repartition(7).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size, parts in (("128m", 3), ("4k", 5), ("2k", 1)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = with_scan_rows(spark.read.parquet(path)).repartition(parts).filter("id % 3 > 0")
            found.append({r.id: tuple(r[ROW]) for r in rows.collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == len(found[0])


def test_equal_rows_of_several_files_are_scored_apart(spark):
    """Equal keys and texts in several files: a score for each row, however the rows are dealt."""
    sp = catalog.split_posts(spark, SF_SMALL)
    few = sp.filter(F.pmod(F.xxhash64("post_id"), F.lit(3)) == 0)
    models = fit_all_models(sp.filter(F.col("split") == "train"))
    path = scratch_path(spark, "t-rows")
    posts = few.drop(ROW)
    posts.unionByName(posts).unionByName(posts).repartition(4).write.parquet(path)
    want = _scores(score_models(few, models))
    for parts in (1, 5):
        rows = with_scan_rows(spark.read.parquet(path)).repartition(parts)
        assert _scores(score_models(rows, models)) == sorted(want * 3) and len(want) > 10


def test_a_join_gives_each_pair_its_own_number(spark):
    path = [scratch_path(spark, f"t-{n}") for n in "ab"]
    spark.range(50).selectExpr("id % 5 AS k").write.parquet(path[0])
    spark.range(20).selectExpr("id % 5 AS k").write.parquet(path[1])
    left = with_scan_rows(spark.read.parquet(path[0]))
    right = with_scan_rows(spark.read.parquet(path[1]), "_other")
    pairs = left.join(right, "k").select(joined_row(F.col(ROW), F.col("_other")).alias("r"))
    assert pairs.count() == pairs.distinct().count() == 200
    l_domain = tables.second_domain(spark, SF_SMALL, row_id=True)
    assert l_domain.select(ROW).distinct().count() == l_domain.count() == tables.second_domain(spark, SF_SMALL).count()
