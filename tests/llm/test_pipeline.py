import os

from pyspark.sql import functions as F

import corpus_pipeline
from botsift.llm import decontamination, simhash, suffix_dedup
from botsift.session import materialize, shared_dir
from botsift.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read_table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_copies", "drop_repeats", "drop_contaminated", "encode"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, SF), "t")
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if stage is corpus_pipeline.drop_near_copies:
            assert simhash.near_duplicates(docs).groupBy("component").count().where("count > 1").count() == 0
        if stage is corpus_pipeline.drop_repeats:
            assert suffix_dedup.remove_repeats(docs).where(F.size("spans") > 0).count() <= 0.02 * sizes[-1]
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
        if stage is corpus_pipeline.drop_contaminated:
            assert decontamination.contamination(docs, read_table(spark, SF, "benchmark")).where("n_hit > 0").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4]
    coded = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert coded.count() == sizes[4] and coded.where("n_corrected > 0").count() == 0


def test_hard_rows_pass_all_stages(spark, frame, tmp_path):
    rows = [(1, "plain words of a text " * 20, "en", "s", 1), (1, "plain words of a text " * 20, "en", "s", 1), (None, None, None, None, None), (2, "", None, "s", 0),
            (3, "you stupid idiot, you pathetic loser, you are scum", "en", "s", 5)]
    d = str(tmp_path)
    frame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    frame([(1, "other words entirely that no text has")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    # the repeated row goes, the empty texts are one group, the insults go
    assert sorted((r.doc_id, r.n_tokens > 0) for r in out) == [(1, True), (2, False)]
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        frame([], schema).write.mode("overwrite").parquet(f"{d}/empty/{name}.parquet")
    frame([], "item_id long, text string").write.mode("overwrite").parquet(f"{d}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{d}/empty").collect() == []


def test_the_session_and_the_shared_folder_are_left_as_they_were(spark):
    folder = shared_dir(spark).removeprefix("file:")
    size, before = spark.conf.get(corpus_pipeline.BATCH_SETTING), set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == size
    assert [n.rpartition("-")[0] for n in set(os.listdir(folder)) - before] == ["pipeline-encode"] and out.count() > 0
