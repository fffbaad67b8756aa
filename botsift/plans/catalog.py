"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator of the inventory.

Every query reads the driver's tables (through the views of ``botsift.sources.tables``) over
whole tables and whole texts. Doubles are rounded to 6 digits so that the DuckDB oracle,
which sums in another order, compares equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.config import DEFAULT_PROFILE, MAX_LEN_LONG, Profile
from botsift.functions import labels as lb
from botsift.functions import text as tx
from botsift.functions.numeric import predict_threshold, round6
from botsift.operators import metrics as mt
from botsift.operators.filters import choose_model, drop_incomplete, reject_blank
from botsift.operators.predict import ENSEMBLE, ensemble_mean, to_long, with_display
from botsift.operators.registry import DEFAULT_REGISTRY, MISSING_MODEL, available_models, contents, \
    external_model, fit_all_models, head_model, load_models, registry_frame, save_models, stored_models, ModelSpec
from botsift.operators.split import split_counts, split_stratified_exact, split_stratified_hash
from botsift.operators.textmodels import prob_col, score_models
from botsift.plans.workflow import Evaluation, fit_and_score, labelled_posts, predictions_long
from botsift.session import scratch_path
from botsift.sources import tables
from botsift.sources.columns import normalize_columns, q, schema_peek, select_detected, select_text_label
from botsift.sources.rows import ROW

QUERIES: dict = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# ------------------------------------------------------------------ shared building blocks

def split_posts(spark: SparkSession, sf: str, profile: Profile = DEFAULT_PROFILE) -> DataFrame:
    return split_stratified_exact(labelled_posts(spark, sf, profile), seed=profile.seed,
                                  test_share=profile.test_share)


def evaluation(spark: SparkSession, sf: str, specs=DEFAULT_REGISTRY, profile: Profile = DEFAULT_PROFILE,
               score_on: DataFrame | None = None) -> Evaluation:
    return fit_and_score(split_posts(spark, sf, profile), specs, profile, score_on)


def _round_p(df: DataFrame, col: str = "p") -> DataFrame:
    return df.withColumn(col, round6(col))


def _metrics6(df: DataFrame, by=("model",)) -> DataFrame:
    return df.select(*by, *[round6(m).alias(m) for m in mt.METRICS])


# ------------------------------------------------------------------ 2.2 projections, labels, filters

@query("normalize_columns")
def q_normalize_columns(spark, sf):
    p = tables.posts(spark, sf)
    messy = p.toDF(" Post_ID ", "TEXT", " Account.Type\t")
    return normalize_columns(messy)


@query("detect_columns")
def q_detect_columns(spark, sf):
    return select_detected(tables.posts(spark, sf))


@query("select_text_label")
def q_select_text_label(spark, sf):
    return select_text_label(tables.posts(spark, sf))


@query("encode_label_ci")
def q_encode_label_ci(spark, sf):
    p = tables.posts(spark, sf)
    return p.select("post_id", lb.encode_label_ci(F.col(q(tables.LABEL_COL))).alias("label"))


@query("encode_label_cs")
def q_encode_label_cs(spark, sf):
    p = tables.posts(spark, sf)
    return p.select("post_id", lb.encode_label_cs(F.col(q(tables.LABEL_COL))).alias("label"))


@query("label_as_int")
def q_label_as_int(spark, sf):
    d = tables.second_domain(spark, sf)
    return d.select("post_id", lb.label_as_int(F.col("label").cast("string")).alias("label"))


@query("drop_incomplete")
def q_drop_incomplete(spark, sf):
    p0 = select_text_label(tables.posts_with_gaps(spark, sf))
    return drop_incomplete(p0.withColumn("label", lb.encode_label_ci("label")))


@query("text_as_string")
def q_text_as_string(spark, sf):
    p0 = tables.posts_with_gaps(spark, sf)
    return p0.select("post_id", lb.text_as_string("text", "nan").alias("text"))


@query("reject_blank")
def q_reject_blank(spark, sf):
    both = tables.posts(spark, sf).select("post_id", "text").unionByName(tables.markup(spark, sf))
    accepted, _ = reject_blank(both)
    return accepted


@query("choose_model")
def q_choose_model(spark, sf):
    """The choice decides what is loaded: the stored registry is filtered, only that model is read and applied."""
    sp = split_posts(spark, sf)
    path = scratch_path(spark, "models")
    save_models(spark, fit_all_models(sp.filter(F.col("split") == "train")), path)
    chosen = [r["model"] for r in choose_model(stored_models(spark, path), "nb_bigram").select("model").collect()]
    models = load_models(spark, path, chosen)
    wide = score_models(sp.filter(F.col("split") == "test"), models, profile=DEFAULT_PROFILE)
    return _round_p(to_long(wide, [m.name for m in models])).select("post_id", "model", "p", "predicted")


# ------------------------------------------------------------------ 2.1 sources

@query("schema_peek")
def q_schema_peek(spark, sf):
    return schema_peek(tables.posts(spark, sf), 5)


# ------------------------------------------------------------------ 2.3 cleaning

@query("strip_urls")
def q_strip_urls(spark, sf):
    return tables.markup(spark, sf).select("post_id", tx.strip_urls("text").alias("text"))


@query("strip_tags")
def q_strip_tags(spark, sf):
    return tables.markup(spark, sf).select("post_id", tx.strip_tags("text").alias("text"))


@query("strip_non_letters")
def q_strip_non_letters(spark, sf):
    return tables.posts(spark, sf).select("post_id", tx.strip_non_letters("text").alias("text"))


@query("lower_strip")
def q_lower_strip(spark, sf):
    return tables.posts(spark, sf).select("post_id", tx.lower_strip("text").alias("text"))


def _three_sources(spark, sf):
    p = tables.posts(spark, sf).select(F.lit("P").alias("source"), "post_id", "text")
    h = tables.markup(spark, sf).select(F.lit("H").alias("source"), "post_id", "text")
    d = tables.second_domain(spark, sf).select(F.lit("L").alias("source"), "post_id", "text")
    return p.unionByName(h).unionByName(d)


@query("clean_strong")
def q_clean_strong(spark, sf):
    return _three_sources(spark, sf).select("source", "post_id", tx.clean_strong("text").alias("text"))


@query("clean_light")
def q_clean_light(spark, sf):
    both = tables.posts(spark, sf).select(F.lit("P").alias("source"), "post_id", "text") \
        .unionByName(tables.markup(spark, sf).select(F.lit("H").alias("source"), "post_id", "text"))
    return both.select("source", "post_id", tx.clean_light("text").alias("text"))


@query("clean_raw")
def q_clean_raw(spark, sf):
    return tables.posts(spark, sf).select("post_id", tx.clean_raw("text").alias("text"))


@query("clean_trace")
def q_clean_trace(spark, sf):
    return tx.clean_trace(tables.markup(spark, sf), "text", "post_id")


# ------------------------------------------------------------------ 2.4 split

@query("split_stratified_exact")
def q_split_exact(spark, sf):
    return split_posts(spark, sf).select("post_id", "label", "split")


@query("split_stratified_hash")
def q_split_hash(spark, sf):
    return split_stratified_hash(labelled_posts(spark, sf)).select("post_id", "label", "split")


@query("split_counts")
def q_split_counts(spark, sf):
    return split_counts(split_posts(spark, sf))


# ------------------------------------------------------------------ 2.6 scoring, 2.7 text training

@query("fit_text_nb")
def q_fit_text_nb(spark, sf):
    ev_train = split_posts(spark, sf).filter(F.col("split") == "train")
    m = fit_all_models(ev_train, [DEFAULT_REGISTRY[0]])[0]
    return m.weights.select("term", round6("weight").alias("weight"))


@query("fit_all_models")
def q_fit_all_models(spark, sf):
    """One row per registry entry: what was fitted (term-table size and bias come from Spark jobs)."""
    train = split_posts(spark, sf).filter(F.col("split") == "train")
    models = fit_all_models(train)
    rows = [(m.name, m.kind, int(m.n_terms), round(float(m.bias), 6)) for m in models]
    return spark.createDataFrame(rows, "model string, kind string, n_terms bigint, bias double")


@query("score_text")
def q_score_text(spark, sf):
    ev = evaluation(spark, sf, [DEFAULT_REGISTRY[0]])
    return _round_p(ev.wide.withColumnRenamed(prob_col("nb_word"), "p")).select("post_id", "label", "p")


@query("score_large_vocabulary")
def q_score_large_vocabulary(spark, sf):
    """A term table beyond the broadcast bound (set low here): hot terms broadcast, the tail joined by shuffle."""
    sp = split_posts(spark, sf)
    models = fit_all_models(sp.filter(F.col("split") == "train"), [DEFAULT_REGISTRY[1]])
    wide = score_models(sp.filter(F.col("split") == "test"), models, max_broadcast_rows=500, profile=DEFAULT_PROFILE)
    return wide.select("post_id", "label", round6(prob_col("nb_bigram")).alias("p"))


@query("predict_threshold")
def q_predict_threshold(spark, sf):
    ev = evaluation(spark, sf, [DEFAULT_REGISTRY[0]])
    return ev.wide.select("post_id", "label", predict_threshold(prob_col("nb_word")).alias("predicted"))


@query("decode_label")
def q_decode_label(spark, sf):
    ev = evaluation(spark, sf, [DEFAULT_REGISTRY[0]])
    return ev.wide.select("post_id", lb.decode_label(predict_threshold(prob_col("nb_word"))).alias("prediction"))


def _predict_one(spark, sf, profile):
    """The chosen model applied to every post of the table (labelled or not): blank posts are refused, the text
    is cleaned as the model's profile says."""
    accepted, _ = reject_blank(tables.posts(spark, sf, row_id=True).select("post_id", "text", ROW))
    posts = accepted.select("post_id", tx.clean("text", profile.clean).alias("text"), ROW)
    ev = evaluation(spark, sf, [DEFAULT_REGISTRY[0]], profile, score_on=posts)
    long = with_display(to_long(ev.wide, ["nb_word"], carry=(), threshold=profile.threshold))
    return long.select("post_id", "model", "prediction")


@query("predict_one_model")
def q_predict_one_model(spark, sf):
    return _predict_one(spark, sf, DEFAULT_PROFILE)


@query("predict_one_raw")
def q_predict_one_raw(spark, sf):
    """The same with texts as they are, for models fitted on raw text."""
    return _predict_one(spark, sf, DEFAULT_PROFILE.with_(clean="raw"))


@query("predict_all_models")
def q_predict_all_models(spark, sf):
    ev = evaluation(spark, sf)
    long = with_display(predictions_long(ev))
    return long.select("post_id", "model", "prediction", "confidence")


@query("score_batched")
def q_score_batched(spark, sf):
    ev = evaluation(spark, sf)
    return _round_p(predictions_long(ev)).select("post_id", "label", "model", "p", "predicted")


@query("ensemble_mean")
def q_ensemble_mean(spark, sf):
    ev = evaluation(spark, sf)
    wide = ensemble_mean(ev.wide, [m.name for m in ev.models])
    return wide.select("post_id", "label", round6(prob_col(ENSEMBLE)).alias("p"),
                       predict_threshold(prob_col(ENSEMBLE)).alias("predicted"))


@query("predict_mixed")
def q_predict_mixed(spark, sf):
    """A registry of all kinds on the vectors' rows: the head, an external batch model (a numpy stand-in that reads
    the first vector half) and the style scorer, averaged."""
    from botsift.operators.head import fixture_weights

    e = tables.vectors(spark, sf).withColumn("text", F.array_join(F.transform("embedding", lambda x: F.floor(x * 10).cast("string")), " "))

    def make_predict_fn():
        return lambda x: 1.0 / (1.0 + np.exp(-x.astype(np.float64)[:, :32].sum(1)))

    specs = [head_model("head", fixture_weights()), ModelSpec("style", "style"),
             external_model("half", make_predict_fn, ("embedding",), input_tensor_shapes=[[64]])]
    models = fit_all_models(e, specs)
    wide = ensemble_mean(score_models(e, models, profile=DEFAULT_PROFILE), [m.name for m in models])
    return _round_p(to_long(wide, [*(m.name for m in models), ENSEMBLE])).select("post_id", "label", "model", "p", "predicted")


# ------------------------------------------------------------------ 2.8 metrics

@query("label_distribution")
def q_label_distribution(spark, sf):
    return mt.label_distribution(labelled_posts(spark, sf))


@query("class_balance")
def q_class_balance(spark, sf):
    return mt.class_balance(labelled_posts(spark, sf)).withColumn("share", round6("share"))


def _pred(spark, sf, ensemble=False):
    return predictions_long(evaluation(spark, sf), with_ensemble=ensemble)


@query("accuracy")
def q_accuracy(spark, sf):
    return _metrics6(mt.compare_models(_pred(spark, sf))).select("model", "accuracy")


@query("precision")
def q_precision(spark, sf):
    return _metrics6(mt.compare_models(_pred(spark, sf))).select("model", "precision")


@query("recall")
def q_recall(spark, sf):
    return _metrics6(mt.compare_models(_pred(spark, sf))).select("model", "recall")


@query("f1")
def q_f1(spark, sf):
    return _metrics6(mt.compare_models(_pred(spark, sf))).select("model", "f1")


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return mt.confusion_matrix(_pred(spark, sf))


@query("confusion_labeled")
def q_confusion_labeled(spark, sf):
    return mt.confusion_labeled(_pred(spark, sf))


@query("compare_models")
def q_compare_models(spark, sf):
    return _metrics6(mt.compare_models(_pred(spark, sf)))


@query("compare_with_ensemble")
def q_compare_with_ensemble(spark, sf):
    return _ordered_metrics(spark, sf).select("position", "model", *mt.METRICS)


def _ordered_metrics(spark, sf):
    """Registry order, the ensemble last."""
    names = [s.name for s in DEFAULT_REGISTRY] + [ENSEMBLE]
    return mt.in_order(_metrics6(mt.compare_models(_pred(spark, sf, ensemble=True))), names)


@query("metrics_report")
def q_metrics_report(spark, sf):
    return mt.metrics_report(mt.compare_models(_pred(spark, sf, ensemble=True)))


@query("rank_models")
def q_rank_models(spark, sf):
    m = _metrics6(mt.compare_models(_pred(spark, sf, ensemble=True)))
    return mt.rank_models(m, "f1").select("model", "f1", "rank")


@query("metrics_by_domain")
def q_metrics_by_domain(spark, sf):
    """Models trained on the posts, scored on their own test part and on the other domain."""
    sp = split_posts(spark, sf)
    test_p = sp.filter(F.col("split") == "test").select(F.lit("P").alias("dataset"), "post_id", "text", "label", ROW)
    other = tables.second_domain(spark, sf, row_id=True).select(F.lit("L").alias("dataset"), "post_id",
                                                                tx.clean_strong("text").alias("text"), "label", ROW)
    target = test_p.unionByName(other)
    train = sp.filter(F.col("split") == "train")
    models = fit_all_models(train)
    wide = score_models(target, models, key="post_id", carry=("dataset", "label"))
    long = to_long(wide, [m.name for m in models], carry=("dataset", "label"))
    return _metrics6(mt.compare_models(long, by=("dataset", "model")), by=("dataset", "model"))


# ------------------------------------------------------------------ 2.1 sources (files written from the tables)

def _posts_csv(spark, sf, sep):
    from botsift.sources.csv import read_posts_csv, write_csv

    path = scratch_path(spark, "posts-csv")
    write_csv(tables.posts(spark, sf), path, sep=sep)
    return normalize_columns(read_posts_csv(spark, path, sep=sep, on_bad="skip"))


@query("read_posts_semicolon")
def q_read_posts_semicolon(spark, sf):
    return _posts_csv(spark, sf, ";")


@query("read_posts_comma")
def q_read_posts_comma(spark, sf):
    return _posts_csv(spark, sf, ",")


@query("read_prepared_test")
def q_read_prepared_test(spark, sf):
    """A prepared test file (tweet, label) from the labelled documents, read back strictly."""
    from botsift.sources.csv import read_prepared_test, write_csv

    path = scratch_path(spark, "prepared-csv")
    d = tables.second_domain(spark, sf).select("post_id", F.col("text").alias("tweet"), "label")
    write_csv(d, path, sep=",")
    back = read_prepared_test(spark, path)
    return back.select("post_id", lb.text_as_string("tweet", "nan").alias("tweet"),
                       lb.label_as_int("label").alias("label"))


@query("available_none")
def q_available_none(spark, sf):
    """Without a model folder every entry of the registry is skipped; the posts are then counted per skipped entry."""
    reg = registry_frame(spark, list(DEFAULT_REGISTRY) + [MISSING_MODEL])
    status = available_models(reg, stored_models(spark, scratch_path(spark, "no-models"))).select("model", "status")
    return status.withColumn("n_posts", F.lit(labelled_posts(spark, sf).count()).cast("bigint"))


@query("load_model")
def q_load_model(spark, sf):
    from botsift.operators.head import fixture_weights, score_head
    from botsift.sinks.writers import load_head, save_head

    path = scratch_path(spark, "head")
    save_head(spark, fixture_weights(), path)
    w = load_head(spark, path)
    e = tables.vectors(spark, sf)
    return e.select("post_id", round6(score_head("embedding", w)).alias("p"))


@query("available_models")
def q_available_models(spark, sf):
    """The registry held against a published store: what is whole, and what the stored tables hold."""
    train = split_posts(spark, sf).filter(F.col("split") == "train")
    models = fit_all_models(train)
    path = scratch_path(spark, "models")
    save_models(spark, models, path)
    reg = registry_frame(spark, list(DEFAULT_REGISTRY) + [MISSING_MODEL])
    status = available_models(reg, stored_models(spark, path)).select("model", "status")
    return status.join(F.broadcast(contents(spark, path)), "model", "left")


@query("post_stream_source")
def q_post_stream_source(spark, sf):
    from botsift.streaming.stream import POSTS_SCHEMA, post_stream

    src, out, ck = (scratch_path(spark, n) for n in ("stream-src", "stream-out", "stream-ck"))
    tables.posts(spark, sf).write.parquet(src)
    s = post_stream(spark, src, POSTS_SCHEMA)
    qy = (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
          .trigger(availableNow=True).start())
    qy.awaitTermination()
    return spark.read.schema(POSTS_SCHEMA).parquet(out)


# ------------------------------------------------------------------ 2.5 encoding

def _vocab_and_split(spark, sf, profile=DEFAULT_PROFILE):
    from botsift.operators.encode import build_vocab

    sp = split_posts(spark, sf, profile)
    return sp, build_vocab(sp.filter(F.col("split") == "train"))


@query("build_vocab")
def q_build_vocab(spark, sf):
    _, vocab = _vocab_and_split(spark, sf)
    return vocab


@query("encode_ids")
def q_encode_ids(spark, sf):
    from botsift.operators.encode import encode_ids

    sp, vocab = _vocab_and_split(spark, sf)
    return encode_ids(sp, vocab)


@query("truncate_ids")
def q_truncate_ids(spark, sf):
    """Evaluation encoding of the second data set: light cleaning, 256 ids."""
    from botsift.operators.encode import encode_ids

    prof = DEFAULT_PROFILE.with_(clean="light", max_len=MAX_LEN_LONG)
    sp, vocab = _vocab_and_split(spark, sf, prof)
    enc = encode_ids(sp, vocab, prof.max_len)
    return enc.select("post_id", "input_ids", F.size("input_ids").alias("n_ids"))


@query("pad_and_mask")
def q_pad_and_mask(spark, sf):
    from botsift.operators.encode import encode_ids, pad_and_mask

    sp, vocab = _vocab_and_split(spark, sf)
    enc = encode_ids(sp, vocab, 128)
    return enc.select("post_id", *pad_and_mask("input_ids", 128))


@query("length_profile")
def q_length_profile(spark, sf):
    from botsift.operators.encode import length_profile

    return length_profile(labelled_posts(spark, sf), 128)


@query("assign_batches")
def q_assign_batches(spark, sf):
    from botsift.operators.rank import assign_batches

    train = split_posts(spark, sf).filter(F.col("split") == "train").select("post_id", "label")
    return assign_batches(train, 16, shuffled=True).select("post_id", "rank", "batch")


# ------------------------------------------------------------------ 2.6 head scoring

def _head():
    from botsift.operators.head import fixture_weights

    return fixture_weights()


@query("cls_pool")
def q_cls_pool(spark, sf):
    from botsift.operators.head import chunk_states, cls_pool

    e = tables.vectors(spark, sf)
    return e.select("post_id", cls_pool(chunk_states("embedding", 4, 16)).alias("cls"))


def _round_arr(c):
    return F.transform(c, lambda x: F.round(x, 6))


@query("dense_relu")
def q_dense_relu(spark, sf):
    from botsift.operators.head import dense_relu

    e = tables.vectors(spark, sf)
    return e.select("post_id", _round_arr(dense_relu("embedding", _head())).alias("hidden"))


@query("dropout_mask")
def q_dropout_mask(spark, sf):
    from botsift.operators.head import dense_relu, dropout_mask

    e = tables.vectors(spark, sf).select("post_id", dense_relu("embedding", _head()).alias("hidden"))
    return e.select("post_id", _round_arr(dropout_mask("hidden", "post_id", seed=42, step=0)).alias("hidden"))


@query("dense_sigmoid")
def q_dense_sigmoid(spark, sf):
    from botsift.operators.head import dense_relu, dense_sigmoid

    w = _head()
    e = tables.vectors(spark, sf).select("post_id", dense_relu("embedding", w).alias("hidden"))
    return e.select("post_id", round6(dense_sigmoid("hidden", w)).alias("p"))


@query("score_head")
def q_score_head(spark, sf):
    from botsift.operators.head import score_head

    e = tables.vectors(spark, sf).select("post_id", "label", score_head("embedding", _head()).alias("p"))
    return e.select("post_id", "label", round6("p").alias("p"), predict_threshold("p").alias("predicted"))


@query("score_external")
def q_score_external(spark, sf):
    """The batch-model contract with a plain numpy stand-in for a pretrained encoder + head."""
    from botsift.operators.head import np_head, score_external

    w = _head()

    def make_predict_fn():
        return lambda x: np_head(x, w)

    e = tables.vectors(spark, sf)
    p = score_external("embedding", make_predict_fn, input_tensor_shapes=[[64]])
    return e.select("post_id", round6(p).alias("p"))


# ------------------------------------------------------------------ 2.7 head training

@query("bce_loss")
def q_bce_loss(spark, sf):
    from botsift.operators.head import score_head
    from botsift.operators.training import bce_loss

    e = tables.vectors(spark, sf).select("post_id", "label", score_head("embedding", _head()).alias("p"))
    return e.select("post_id", "label", round6(bce_loss("p", "label")).alias("loss"))


@query("epoch_loss")
def q_epoch_loss(spark, sf):
    from botsift.operators.head import score_head
    from botsift.operators.rank import assign_batches
    from botsift.operators.training import bce_loss, epoch_loss

    e = tables.vectors(spark, sf).select(F.col("post_id"), "label",
                                         bce_loss(score_head("embedding", _head()), "label").alias("loss"))
    batched = assign_batches(e, 16, shuffled=False)
    return epoch_loss(batched).select(round6("epoch_loss").alias("epoch_loss"), "n_batches")


@query("head_gradient")
def q_head_gradient(spark, sf):
    from botsift.operators.training import head_gradient

    g = head_gradient(tables.vectors(spark, sf), _head())
    return g.select("param", "idx", F.round(F.col("grad"), 9).alias("grad"))


@query("adamw_step")
def q_adamw_step(spark, sf):
    """First AdamW step from the fixture weights with the full-table gradient (lr 2e-5)."""
    from botsift.operators.head import fixture_param_value
    from botsift.operators.training import adamw_columns, head_gradient

    g = head_gradient(tables.vectors(spark, sf), _head())
    theta0 = fixture_param_value(F.col("param"), F.col("idx"))
    theta1, _, _ = adamw_columns(theta0, F.col("grad"), F.lit(0.0), F.lit(0.0), t=1)
    return g.select("param", "idx", F.round(theta1, 9).alias("value"))


@query("fit_head")
def q_fit_head(spark, sf):
    """Two epochs of two AdamW steps in train mode (dropout, new batches per epoch): the loss history."""
    from botsift.operators.training import fit_head

    _, hist = fit_head(tables.vectors(spark, sf), _head(), epochs=2, steps_per_epoch=2, lr=1e-3)
    rows = spark.createDataFrame(hist, "epoch int, step int, batch_loss double")
    return rows.withColumn("batch_loss", round6("batch_loss"))


@query("fit_text_lr")
def q_fit_text_lr(spark, sf):
    """The weight of every training word after five steps; the bias in the row of the empty word."""
    from botsift.operators.logistic import fit_text_lr

    sp = split_posts(spark, sf)
    model = fit_text_lr(sp.filter(F.col("split") == "train"), steps=5)
    bias = spark.range(1).select(F.lit("").alias("term"), F.lit(model.bias).alias("weight"))
    return model.weights.select("term", "weight").unionByName(bias).select("term", round6("weight").alias("weight"))


# ------------------------------------------------------------------ 2.9 sinks (written, then read back)

@query("write_results_csv")
def q_write_results_csv(spark, sf):
    from botsift.sinks.writers import read_results_csv, write_results_csv

    path = scratch_path(spark, "results-csv")
    write_results_csv(_ordered_metrics(spark, sf), path)
    return read_results_csv(spark, path)


@query("save_model")
def q_save_model(spark, sf):
    from botsift.sinks.writers import save_model

    train = split_posts(spark, sf).filter(F.col("split") == "train")
    path = scratch_path(spark, "models")
    save_model(spark, fit_all_models(train), path)
    m = load_models(spark, path, ["nb_word"])[0]
    return m.weights.select("term", round6("weight").alias("weight"))


@query("write_predictions")
def q_write_predictions(spark, sf):
    from botsift.sinks.writers import write_predictions

    path = scratch_path(spark, "predictions")
    write_predictions(_round_p(_pred(spark, sf)), path)
    return spark.read.parquet(path).select("post_id", "label", "model", "p", "predicted")


# ------------------------------------------------------------------ 2.10 streaming

def _run_prediction_stream(spark, sf):
    from botsift.streaming.stream import POSTS_SCHEMA, post_stream, stream_predict

    train = split_posts(spark, sf).filter(F.col("split") == "train")
    models = fit_all_models(train)
    src, out, ck, counts = (scratch_path(spark, n) for n in ("stream-src", "stream-pred", "stream-ck", "stream-counts"))
    tables.posts(spark, sf).write.parquet(src)
    stream_predict(post_stream(spark, src, POSTS_SCHEMA, max_files_per_trigger=4, row_id=True), models, out, ck,
                   metrics_path=counts).awaitTermination()
    return out, counts


@query("stream_predict")
def q_stream_predict(spark, sf):
    from botsift.streaming.stream import read_predictions

    out, _ = _run_prediction_stream(spark, sf)
    return _round_p(read_predictions(spark, out)).select(
        "post_id", "model", "label", "p", "predicted", "prediction")


@query("stream_metrics")
def q_stream_metrics(spark, sf):
    from botsift.streaming.stream import stream_metrics

    _, counts = _run_prediction_stream(spark, sf)
    return stream_metrics(spark, counts)
