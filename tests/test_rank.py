"""Global rank / batches: a permutation of 1..n, and a hot key is cut across range partitions."""

from pyspark.sql import functions as F

from botsift.operators.rank import _LOW_BITS, _MID, assign_batches, global_rank, ranged_layout


def _frame(spark, n=3000):
    # a third of the rows are exact copies of one row
    hot = spark.range(n // 3).select(F.lit("k0").alias("post_id"), F.lit(1).alias("v"))
    rest = spark.range(n - n // 3).select(F.format_string("k%05d", F.col("id") + 1).alias("post_id"),
                                          F.col("id").cast("int").alias("v"))
    return hot.unionByName(rest).repartition(5)


def test_rank_is_a_permutation(spark):
    df = _frame(spark)
    r = global_rank(df, ["post_id"], n_parts=8)
    got = r.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"),
                F.max("rank").alias("hi")).first()
    assert (got["n"], got["d"], got["lo"], got["hi"]) == (3000, 3000, 1, 3000)
    # order is respected: the hot key ranks are one contiguous block, before every other key
    hot = r.filter(F.col("post_id") == "k0").agg(F.min("rank"), F.max("rank")).first()
    assert (hot[0], hot[1]) == (1, 1000)


def test_hot_key_is_spread_over_range_partitions(spark):
    ranged = ranged_layout(_frame(spark), ["post_id"], n_parts=8)
    sizes = [r[1] for r in ranged.groupBy(F.shiftright(F.col(_MID), _LOW_BITS)).count().collect()]
    assert sum(sizes) == 3000
    assert max(sizes) < 3000 / 4, sizes


def test_batches_are_consecutive(spark):
    b = assign_batches(_frame(spark, 100), batch_size=16)
    sizes = sorted(r[1] for r in b.groupBy("batch").count().collect())
    assert sizes == [4] + [16] * 6
