"""Stream = batch on the same rows; plan shape checks; the driver contract."""

import os
import sys

from pyspark.sql import functions as F

from table_dirs import SF_SMALL

from botsift.functions import text as tx
from botsift.operators.registry import fit_all_models
from botsift.plans import catalog
from botsift.session import scratch_path
from botsift.sources import tables
from botsift.sources.rows import with_scan_rows
from botsift.streaming.stream import POSTS_SCHEMA, post_stream, predict_batch, read_predictions, stream_predict


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark):
    train = catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train")
    models = fit_all_models(train)
    src, out, ck = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-ck"))
    posts = tables.posts(spark, SF_SMALL)
    posts.write.parquet(src)
    stream_predict(post_stream(spark, src, POSTS_SCHEMA, max_files_per_trigger=2, row_id=True), models, out, ck).awaitTermination()
    streamed = read_predictions(spark, out).drop("batch")
    batch = predict_batch(posts, models)        # without identities from the scan: numbers are written
    key = ["post_id", "model"]
    a = {tuple(r[k] for k in key): (r.p, r.predicted) for r in streamed.collect()}
    b = {tuple(r[k] for k in key): (r.p, r.predicted) for r in batch.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k][0] - b[k][0]) < 1e-12 and a[k][1] == b[k][1] for k in a)


def test_a_replayed_batch_counts_once(spark):
    """The last commit is lost, the query starts again and replays its batch: predictions and metrics stay the same."""
    import os as _os
    import shutil

    from botsift.streaming.stream import stream_metrics

    models = fit_all_models(catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train"))
    src, out, ck, counts = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-ck", "t-counts"))
    tables.posts(spark, SF_SMALL).repartition(6).write.parquet(src)

    def run(checkpoint):
        stream_predict(post_stream(spark, src, POSTS_SCHEMA, max_files_per_trigger=2), models, out, checkpoint, metrics_path=counts).awaitTermination()
        rows = read_predictions(spark, out)
        return rows.count(), sorted(tuple(r) for r in stream_metrics(spark, counts).collect())

    before = run(ck)
    local = ck.removeprefix("file:")
    assert {"0", "1", "2"} <= set(_os.listdir(f"{local}/commits"))
    # a checkpoint as it is when the last batch was written, but not committed
    lost = local + "-lost"
    shutil.copytree(local, lost, ignore=lambda d, names: [n for n in names if d.endswith("commits") and n in ("2", ".2.crc")])
    assert run(lost) == before


def test_cleaning_stays_in_the_jvm(spark):
    df = tables.markup(spark, SF_SMALL)
    plan = _plan(df.select(tx.clean_strong("text"))) + (trace := _plan(tx.clean_trace(df, "text", "post_id")))
    assert trace.count("regexp_replace") == 4       # every stage is computed once
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_all_models_score_with_one_scan_of_the_test_posts(spark):
    ev = catalog.evaluation(spark, SF_SMALL)
    plan = _plan(catalog.predictions_long(ev, with_ensemble=True))
    assert plan.count("/numbered-") == 0         # rows are told apart by the scan: no copy of the posts is written
    assert plan.count("conversations.parquet") == 1
    assert "BroadcastHashJoin" in plan          # term table within the checked bound


def test_projection_pruned_into_scan(spark):
    df = tables.second_domain(spark, SF_SMALL).select("post_id", "label")
    plan = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint>" in plan or "struct<doc_id:bigint>" in plan


def test_entry_contract(spark):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    others = entry._llm("QUERIES")
    assert set(q) - set(o) - set(others) == set()
    rows = entry.entry(spark).collect()
    assert [r.model for r in rows if r.model == "ENSEMBLE"] == ["ENSEMBLE"]
    assert len(rows) == 5


def test_term_arrays_are_not_copied_into_filters(spark):
    """A plain explode would make the optimizer infer size(array) > 0 and push a second copy of
    the term expression into the scan; the fit and the vocabulary must not do that."""
    from botsift.operators.encode import build_vocab
    from botsift.operators.textmodels import term_counts

    train = catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train")
    specs = [("nb_word", "word"), ("nb_bigram", "bigram"), ("nb_trigram", "trigram")]
    plan = _plan(term_counts(train, specs))
    filters = [l for l in plan.splitlines() if "Filter" in l]
    assert not any("zip_with" in l or "split(" in l for l in filters), filters
    counts = train.select(F.explode_outer(F.split("text", " ")).alias("token"))
    assert "size(" not in _plan(counts)


def test_term_pass_has_no_interpreted_lambda(spark):
    """Words, bigrams, trigrams and the model tagging are generated code: no array lambda in the
    scoring or fitting plans (a lambda would take the whole projection out of whole-stage codegen)."""
    from botsift.operators.textmodels import score_models, term_counts

    sp = catalog.split_posts(spark, SF_SMALL)
    specs = [("nb_word", "word"), ("nb_bigram", "bigram"), ("nb_trigram", "trigram")]
    counts = term_counts(sp.filter(F.col("split") == "train"), specs)
    assert "lambdafunction" not in _plan(counts)
    models = fit_all_models(sp.filter(F.col("split") == "train"))
    assert "lambdafunction" not in _plan(score_models(sp.filter(F.col("split") == "test"), models))


def test_a_batch_of_few_files_is_scored_by_all_cores(spark):
    """One file of one row group: its rows are dealt out before the texts are taken apart."""
    src = scratch_path(spark, "t-one-file")
    rows = [(f"p{i}", f"word{i % 7} two three", "human") for i in range(400)]
    spark.createDataFrame(rows, POSTS_SCHEMA).coalesce(1).write.parquet(src)
    models = catalog.fit_all_models(catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train"), catalog.DEFAULT_REGISTRY[:1])
    plan = _plan(predict_batch(with_scan_rows(spark.read.schema(POSTS_SCHEMA).parquet(src)), models))
    dealt = plan.index("RoundRobinPartitioning")
    assert plan.index("Generate inline") < dealt < plan.index("FileScan parquet [post_id")
