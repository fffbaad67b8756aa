"""The text scorers give the same result whatever join strategy the size check picks."""

import pytest
from pyspark.sql import functions as F

from table_dirs import SF_SMALL

from botsift.operators.registry import fit_all_models, load_models, save_models
from botsift.operators.textmodels import score_models
from botsift.plans import catalog
from botsift.session import scratch_path
from botsift.sources import tables


def _scores(df):
    return {r.post_id: (r.p_nb_word, r.p_nb_bigram, r.p_nb_trigram, r.p_style) for r in df.collect()}


def test_hybrid_and_shuffle_join_equal_broadcast(spark):
    sp = catalog.split_posts(spark, SF_SMALL)
    models = fit_all_models(sp.filter(F.col("split") == "train"))
    test = sp.filter(F.col("split") == "test")
    base = _scores(score_models(test, models))
    hybrid = _scores(score_models(test, models, max_broadcast_rows=300))     # hot terms broadcast, tail shuffled
    shuffle = _scores(score_models(test, models, max_broadcast_rows=1))      # nothing fits: shuffle join
    for other in (hybrid, shuffle):
        assert other.keys() == base.keys()
        for k in base:
            assert all(abs(a - b) < 1e-9 for a, b in zip(base[k], other[k])), k


def test_saved_models_score_the_same(spark):
    sp = catalog.split_posts(spark, SF_SMALL)
    models = fit_all_models(sp.filter(F.col("split") == "train"))
    path = scratch_path(spark, "t-models")
    save_models(spark, models, path)
    loaded = load_models(spark, path, [m.name for m in models])
    assert [m.name for m in loaded] == [m.name for m in models]
    test = sp.filter(F.col("split") == "test")
    a, b = _scores(score_models(test, models)), _scores(score_models(test, loaded))
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k]))


def test_duplicate_keys_are_scored_per_row(spark):
    sp = catalog.split_posts(spark, SF_SMALL)
    models = fit_all_models(sp.filter(F.col("split") == "train"))
    one = sp.filter(F.col("split") == "test").limit(3).collect()
    rows = [(r.post_id, r.label, r.text) for r in one]
    dup = [("dup", 1, rows[0][2]), ("dup", 0, rows[1][2])]
    df = spark.createDataFrame(rows + dup, "post_id string, label int, text string")
    out = score_models(df, models).collect()
    assert len(out) == 5
    dups = sorted((r.label, r.p_nb_word) for r in out if r.post_id == "dup")
    by_id = {r.post_id: r.p_nb_word for r in out if r.post_id != "dup"}
    assert len(dups) == 2
    assert sorted(d[1] for d in dups) == sorted([by_id[rows[0][0]], by_id[rows[1][0]]])


def test_checked_broadcast_falls_back_to_a_shuffle_join(spark):
    from botsift.operators.joins import join_small

    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    a = join_small(big, small, "k", small_rows=334)
    b = join_small(big, small, "k", small_rows=334, max_rows=10)
    plan_a = a._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan_a
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect()) == list(range(0, 1000, 3))


def test_broadcast_bound_counts_bytes_not_only_rows(spark):
    """Few rows with very long strings are not broadcast."""
    from botsift.operators.joins import hot_and_tail, join_small, join_terms, size_of

    small = spark.createDataFrame([(i, "x" * 5000) for i in range(10)], "k long, s string")
    rows, nbytes = size_of(small, ["s"])
    assert rows == 10 and nbytes >= 50000
    big = spark.range(100).withColumnRenamed("id", "k")
    kept = join_small(big, small, "k", str_cols=("s",), max_bytes=10_000)
    # no broadcast hint on the long-string side (the planner may still broadcast the tiny other side)
    assert "BuildRight" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 10
    table = small.select("k", F.col("s").alias("term"), F.lit(1.0).alias("weight"), F.col("k").alias("n"))
    occ = big.select("k", F.lit("x" * 5000).alias("term"))
    a = join_terms(occ, *hot_and_tail(table, "term", "n", 100, 100_000, 10, nbytes), ["k", "term"], "weight", ["k"])
    b = join_terms(occ, *hot_and_tail(table, "term", "n", 100, 10_000, 10, nbytes), ["k", "term"], "weight", ["k"])
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    got = lambda df: sorted((r.k, r.weight) for r in df.collect())
    assert got(a) == got(b)


def test_hot_cut_is_exact(spark):
    """Two million terms with frequencies as one over the rank: as many hot terms as allowed, never none."""
    from botsift.operators.joins import hot_and_tail

    table = spark.range(1, 2_000_001).select(F.col("id").cast("string").alias("term"), F.floor(F.lit(2_000_000) / F.col("id")).alias("n"))
    for allowed in (18, 100):
        hot, tail = hot_and_tail(table, "term", "n", allowed, 1 << 28, 2_000_000, 1 << 24)
        n = hot.count()
        assert allowed / 2 <= n <= allowed
        assert n + tail.count() == 2_000_000
        assert hot.agg(F.min("n")).first()[0] > tail.agg(F.max("n")).first()[0]


def test_large_vocabulary_plan_reads_the_posts_once(spark):
    sp = catalog.split_posts(spark, SF_SMALL)
    models = fit_all_models(sp.filter(F.col("split") == "train"))
    df = score_models(sp.filter(F.col("split") == "test").repartition(5), models, max_broadcast_rows=300)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3 and plan.count("Generate inline") == 1
    assert "monotonically_increasing_id" not in plan


def test_terms_without_a_post_and_settled_terms_are_spread(spark):
    from botsift.operators.joins import hot_and_tail, join_terms

    table = spark.createDataFrame([("the", 1.0, 1000), ("rare", 2.0, 1), ("odd", 3.0, 1)], "term string, weight double, n long")
    big = spark.createDataFrame([(1, "the"), (1, "rare"), (2, None), (3, "unseen"), (4, "the"), (4, "the"), (4, "odd")], "rid long, term string")
    hot, tail = hot_and_tail(table, "term", "n", 1, 1 << 28)
    rows = join_terms(big, hot, tail, ["term"], "weight", ["rid"]).collect()
    assert sorted((r.rid, r.weight or 0) for r in rows) == [(1, 1), (1, 2), (2, 0), (3, 0), (4, 1), (4, 1), (4, 3)]
    sums = join_terms(big, hot, tail, ["term"], "weight", ["rid"], sum_by=["rid"]).groupBy("rid").agg(F.sum("weight").alias("w")).collect()
    assert {r.rid: r.w or 0 for r in sums} == {1: 3, 2: 0, 3: 0, 4: 5}


def test_terms_that_the_tail_cannot_hold_are_not_shuffled(spark):
    """A thousand unseen terms of a row are settled by the bitmap, all but a few; those of the tail are all found."""
    from botsift.operators.joins import bitmap_blocks, hot_and_tail, join_terms, key_bitmap

    table = spark.range(300).select(F.concat(F.lit("t"), "id").alias("term"), F.lit(1.0).alias("weight"), F.lit(1).alias("n"))
    table = table.unionByName(spark.createDataFrame([("the", 0.5, 9)], table.schema))
    unseen = spark.range(1000).select((F.col("id") % 2).alias("rid"), F.concat(F.lit("u"), "id").alias("term"))
    big = unseen.unionByName(table.select(F.lit(1).cast("bigint").alias("rid"), "term"))
    hot, tail = hot_and_tail(table, "term", "n", 1, 1 << 28)
    blocks = bitmap_blocks(300)
    rows = join_terms(big, hot, tail, ["term"], "weight", ["rid"], sum_by=["rid"], bitmap=(key_bitmap(tail, ["term"], blocks), blocks))
    assert 302 <= rows.count() < 400          # 300 of the tail, two of what is settled, and a few bits in common
    sums = rows.groupBy("rid").agg(F.sum("weight").alias("w")).collect()
    assert {r.rid: r.w or 0 for r in sums} == {0: 0, 1: 300.5}
    narrow = join_terms(big, hot, tail, ["term"], "weight", ["rid"], sum_by=["rid"], bitmap=(key_bitmap(tail, ["term"], 1), 1))
    assert {r.rid: r.w or 0 for r in narrow.groupBy("rid").agg(F.sum("weight").alias("w")).collect()} == {0: 0, 1: 300.5}


def test_terms_are_looked_up_by_one_long(spark, monkeypatch):
    """The broadcast is keyed by a hash; terms of one hash stay apart."""
    from botsift.operators import joins

    table = spark.createDataFrame([(0, "a", 1.0, 9), (0, "b", 2.0, 9), (1, "a", 4.0, 9), (0, "c", 8.0, 1)], "m int, term string, weight double, n int")
    big = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 1, "a"), (2, 1, "b"), (3, 0, None), (3, 0, "c")], "rid int, m int, term string")

    def scored():
        hot, tail = joins.hot_and_tail(table, "term", "n", 3, 1 << 28)
        df = joins.join_terms(big, hot, tail, ["m", "term"], "weight", ["rid"], sum_by=["rid"], bitmap=(joins.key_bitmap(tail, ["m", "term"], 1), 1))
        return df._jdf.queryExecution().executedPlan().toString(), {r.rid: r.w for r in df.groupBy("rid").agg(F.sum("weight").alias("w")).collect()}

    plan, got = scored()
    assert "BroadcastHashJoin [_hash" in plan and got == {1: 3.0, 2: 4.0, 3: 8.0}
    monkeypatch.setattr(joins, "key_hash", lambda columns: F.lit(5).cast("bigint") + F.xxhash64(*columns) * 0)
    assert scored()[1] == got


def test_prepared_models_are_not_cut_again(spark, monkeypatch):
    """A stream scores every batch with the cut made when it starts: no job over the weight table for each batch."""
    from botsift.operators import textmodels as tm

    sp = catalog.split_posts(spark, SF_SMALL)
    models = fit_all_models(sp.filter(F.col("split") == "train"))
    test = sp.filter(F.col("split") == "test")
    monkeypatch.setattr(tm, "lookup_of", lambda nb, *bounds, f=tm.lookup_of: f(nb, 300, tm.MAX_BROADCAST_BYTES))
    ready = tm.prepare(models)
    cut = ready[0].lookup
    assert cut.tail is not None and cut.bitmap is not None
    cut.bounds = (tm.MAX_BROADCAST_ROWS, tm.MAX_BROADCAST_BYTES)
    monkeypatch.undo()
    base = _scores(score_models(test, models))
    monkeypatch.setattr(tm, "hot_and_tail", None)
    got = _scores(score_models(test, ready))
    assert got.keys() == base.keys() and all(abs(x - y) < 1e-9 for k in base for x, y in zip(base[k], got[k]))


def test_no_training_word_is_unknown_and_no_post_is_cut(spark):
    from botsift.config import UNK_ID
    from botsift.functions.terms import words
    from botsift.operators.encode import build_vocab, encode_ids

    sp = catalog.split_posts(spark, SF_SMALL)
    train = sp.filter(F.col("split") == "train")
    vocab = build_vocab(train)
    sizes = {(r.post_id, r.n) for r in train.select("post_id", F.size(words("text")).alias("n")).collect()}
    small = None
    for limit in (10**6, 50, 0):
        enc = encode_ids(train, vocab, max_rows=limit).collect()
        assert {(r.post_id, len(r.input_ids) - 2) for r in enc} == sizes
        assert not any(UNK_ID in r.input_ids for r in enc)
        got = sorted((r.post_id, list(r.input_ids)) for r in enc)
        small = small or got
        assert got == small
    assert max(len(i) for _, i in small) > 128
    ids = sorted(r.id for r in vocab.collect())
    assert ids == list(range(4, 4 + len(ids)))


def test_a_batch_reads_the_written_cut_and_joins_the_tail_by_one_long(spark):
    """The join to the tail shuffles and sorts by the hash alone; the plan reads the written cut, and neither computes weights nor splits the
    table again."""
    from botsift.operators import textmodels as tm
    from botsift.sources.rows import with_scan_rows
    from botsift.streaming.stream import predict_batch

    models = fit_all_models(catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tm, "lookup_of", lambda nb, f=tm.lookup_of: f(nb, 300, tm.MAX_BROADCAST_BYTES))
        ready = tm.prepare(models)
    ready[0].lookup.bounds = (tm.MAX_BROADCAST_ROWS, tm.MAX_BROADCAST_BYTES)
    path = scratch_path(spark, "t-posts")
    tables.posts(spark, SF_SMALL).write.parquet(path)
    posts = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = predict_batch(with_scan_rows(posts), ready)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(CASE WHEN isnull(_key") == 1 and plan.count("Exchange hashpartitioning(xxhash64(_tail_m") == 1
    assert "LOG(" not in plan.upper() and plan.count("SortMergeJoin [CASE") == 1 and plan.count("Sort [") == 2
    a, b = ({(r.post_id, r.model): r.p for r in predict_batch(x, m).collect()} for x, m in ((with_scan_rows(posts), ready), (posts, models)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
