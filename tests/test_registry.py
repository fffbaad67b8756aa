"""Stored and mixed registries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from table_dirs import SF_SMALL

from botsift.config import DEFAULT_PROFILE
from botsift.operators.head import fixture_weights
from botsift.operators.predict import ensemble_mean, to_long
from botsift.operators import registry
from botsift.operators.registry import (
    DEFAULT_REGISTRY, ModelSpec, available_models, current_version, external_model, fit_all_models, head_model, load_models,
    registry_frame, save_models, stored_models,
)
from botsift.operators.textmodels import prob_col, score_models
from botsift.plans import catalog
from botsift.session import scratch_path
from botsift.sinks.publish import names, put
from botsift.streaming.stream import predict_batch


def _posts(spark, profile=DEFAULT_PROFILE):
    """Split posts with a vector of eight numbers made from the text."""
    sp = catalog.split_posts(spark, SF_SMALL, profile)
    return sp.withColumn("embedding", F.array(*[(F.ascii(F.substring("text", i + 1, 1)) / 128).cast("float") for i in range(64)]))


def test_profile_and_sizes_come_back(spark):
    profile = DEFAULT_PROFILE.with_(clean="light", threshold=0.7, seed=7, test_share=0.3)
    train = catalog.split_posts(spark, SF_SMALL, profile).filter(F.col("split") == "train")
    models = fit_all_models(train, profile=profile)
    path = scratch_path(spark, "t-registry")
    save_models(spark, models, path)
    for a, b in zip(models, load_models(spark, path, [m.name for m in models])):
        assert (a.name, a.kind, a.terms, a.bias, a.n_terms, a.term_bytes, a.profile) == (b.name, b.kind, b.terms, b.bias, b.n_terms, b.term_bytes, b.profile)


def test_another_profile_is_an_error(spark):
    sp = catalog.split_posts(spark, SF_SMALL)
    models = fit_all_models(sp.filter(F.col("split") == "train"), [DEFAULT_REGISTRY[0]], DEFAULT_PROFILE.with_(clean="light"))
    with pytest.raises(ValueError, match="profile mismatch"):
        score_models(sp, models, profile=DEFAULT_PROFILE)


def test_no_folder_and_no_terms_mean_skipped(spark):
    reg = registry_frame(spark, DEFAULT_REGISTRY)
    status = lambda path: {r.model: r.status for r in available_models(reg, stored_models(spark, path)).collect()}
    assert set(status(scratch_path(spark, "t-none")).values()) == {"skipped"}
    path = scratch_path(spark, "t-registry")
    models = fit_all_models(catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train"))
    save_models(spark, models, path)
    assert set(status(path).values()) == {"available"}
    # only the meta rows: the term tables are missing
    bare = scratch_path(spark, "t-registry")
    spark.read.parquet(f"{current_version(spark, path)}/meta").write.parquet(f"{bare}/versions/1/meta")
    assert set(status(bare).values()) == {"skipped"}            # no pointer: nothing is published
    put(spark, f"{bare}/CURRENT", "1")
    assert status(bare) == {"nb_word": "skipped", "nb_bigram": "skipped", "nb_trigram": "skipped", "style": "available"}


def test_damaged_weights_are_found(spark):
    path = scratch_path(spark, "t-registry")
    models = fit_all_models(catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train"), [DEFAULT_REGISTRY[0], head_model("head", fixture_weights())])
    save_models(spark, models, path)
    folder = current_version(spark, path)
    status = lambda: {r.model: r.status for r in stored_models(spark, path).collect()}
    assert status() == {"nb_word": "available", "head": "available"}
    whole = spark.read.parquet(f"{folder}/terms")
    changed = whole.withColumn("weight", F.when(F.col("term") == whole.first()["term"], F.col("weight") + 1e-9).otherwise(F.col("weight")))
    other = scratch_path(spark, "t-changed")
    changed.write.parquet(other)
    spark.read.parquet(other).write.mode("overwrite").partitionBy("model").parquet(f"{folder}/terms")
    assert status() == {"nb_word": "damaged", "head": "available"}
    with pytest.raises(ValueError, match="nb_word"):
        load_models(spark, path)
    assert [m.name for m in load_models(spark, path, ["head"])] == ["head"]


def test_a_crash_between_any_two_writes_leaves_the_old_registry(spark, monkeypatch):
    """Publishing dies before each of its steps: readers keep the old version, whole; then it goes through, and old folders go."""
    from pyspark.sql import DataFrameWriter

    sp = catalog.split_posts(spark, SF_SMALL)
    train = sp.filter(F.col("split") == "train")
    old = fit_all_models(train, [DEFAULT_REGISTRY[0], head_model("head", fixture_weights()), DEFAULT_REGISTRY[3]])
    new = fit_all_models(train.limit(30), [ModelSpec("nb_word", "nb", "word"), ModelSpec("extra", "nb", "bigram")])
    path = scratch_path(spark, "t-registry")
    save_models(spark, old, path)
    seen = lambda: {(m.name, m.bias, m.n_terms) for m in load_models(spark, path)}
    before = seen()
    opened = load_models(spark, path, ["nb_word"])[0].weights
    rows = opened.count()
    write = DataFrameWriter.parquet
    for step in range(3):
        done = [0]

        def failing(writer, *args, step=step, done=done, **kw):
            if done[0] == step:
                raise OSError("the writer dies")
            done[0] += 1
            return write(writer, *args, **kw)

        monkeypatch.setattr(DataFrameWriter, "parquet", failing)
        monkeypatch.setattr(registry, "put", lambda *a: (_ for _ in ()).throw(OSError("the writer dies")))
        with pytest.raises(OSError):
            save_models(spark, new, path)
        monkeypatch.undo()
        assert seen() == before
    save_models(spark, new, path)
    assert {m.name for m in load_models(spark, path)} == {"nb_word", "extra"} and seen() != before
    assert opened.count() == rows                               # what a reader has opened is still there
    assert len(names(spark, f"{path}/versions")) <= 3


def test_mixed_registry_is_scored_stored_loaded_and_streamed(spark):
    def mean_length():
        return lambda batch: 1.0 / (1.0 + np.exp(-batch.sum(1) / 20.0))

    sp = _posts(spark)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    outside = external_model("outside", mean_length, ("embedding",), input_tensor_shapes=[[64]])
    specs = [DEFAULT_REGISTRY[0], ModelSpec("lr", "lr", options=(("steps", 3),)), head_model("head", fixture_weights()), outside, DEFAULT_REGISTRY[3]]
    models = fit_all_models(train, specs)
    names = [m.name for m in models]
    assert names == ["nb_word", "lr", "head", "outside", "style"]
    wide = ensemble_mean(score_models(test, models, profile=DEFAULT_PROFILE), names)
    rows = {r.post_id: r for r in wide.collect()}
    assert len(rows) == test.count()
    for r in rows.values():
        p = [r[prob_col(n)] for n in names]
        assert all(0 <= x <= 1 for x in p) and r[prob_col("ENSEMBLE")] == pytest.approx(np.mean(p))
    assert to_long(wide, names).count() == len(rows) * len(names)
    path = scratch_path(spark, "t-registry")
    save_models(spark, models, path)
    back = load_models(spark, path, names, external={"outside": outside})
    assert [m.name for m in back] == names
    for r in score_models(test, back).collect():
        assert [r[prob_col(n)] for n in names] == pytest.approx([rows[r.post_id][prob_col(n)] for n in names])
    assert [m.name for m in load_models(spark, path, names)] == [n for n in names if n != "outside"]
    # the per-post path of the stream, on models that read the text only
    text = [m for m in back if m.kind in ("nb", "lr", "style")]
    batch = test.select("post_id", "text")
    assert predict_batch(batch, text).count() == len(rows) * 3


def test_ids_and_mask_reach_an_external_model(spark):
    from botsift.operators.encode import build_vocab, encode_ids, pad_and_mask

    sp = catalog.split_posts(spark, SF_SMALL)
    enc = encode_ids(sp, build_vocab(sp.filter(F.col("split") == "train")), 32, carry=("text", "label"))
    enc = enc.select("post_id", "text", "label", *pad_and_mask("input_ids", 32))

    def make():
        return lambda ids, mask: (ids * mask).sum(1) / (1.0 + (ids * mask).sum(1))

    model = external_model("encoder", make, ("input_ids", "attention_mask"), input_tensor_shapes=[[32], [32]])
    got = {r.post_id: r.p_encoder for r in score_models(enc, [model]).collect()}
    for r in enc.collect():
        s = sum(i * m for i, m in zip(r.input_ids, r.attention_mask))
        assert got[r.post_id] == pytest.approx(s / (1.0 + s))
