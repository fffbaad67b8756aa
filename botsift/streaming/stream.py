"""Structured Streaming forms of the one-post paths.

Posts carry no event time, so nothing here needs a watermark:

* ``post_stream``     file source of arriving posts (parquet or JSON files dropped in a folder);
* ``stream_predict``  each micro-batch goes through the SAME batch plan (reject blank, clean,
                      score all fitted models, threshold) inside ``foreachBatch``, is written to a folder
                      of its own under ``<out>/data`` and becomes visible when its entry appears in the log
                      ``<out>/log`` (:mod:`botsift.streaming.runlog`); with ``metrics_path`` the batch's confusion
                      counts per model go to a second log. A replayed batch writes a new folder and
                      replaces its entry, so readers find the old rows or the new ones, and nothing counts twice. The
                      models are fixed, and their term table is prepared, when the query starts;
* ``read_predictions``  the rows of all finished batches;
* ``stream_metrics``  running confusion counts: the sum of the rows of the merged log, a few files
                      whatever the number of batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.config import DEFAULT_PROFILE, Profile
from botsift.functions.labels import encode_label
from botsift.functions.text import clean
from botsift.operators.filters import reject_blank
from botsift.operators.metrics import confusion_counts
from botsift.operators.predict import to_long, with_display
from botsift.operators.textmodels import TextModel, prepare, score_models
from botsift.sinks.publish import names, remove
from botsift.sources.columns import q
from botsift.sources.rows import ROW, with_scan_rows
from botsift.streaming.runlog import RunLog

POSTS_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("account.type", T.StringType()),
])


def post_stream(spark: SparkSession, path: str, schema: T.StructType = POSTS_SCHEMA, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, row_id: bool = False) -> DataFrame:
    """Arriving posts; with ``row_id`` (Parquet only) with the identity of each row, so that scoring writes no copy of a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_scan_rows(reader.load(path)) if row_id else reader.load(path)


def predict_batch(batch: DataFrame, models: list[TextModel], profile: Profile = DEFAULT_PROFILE,
                  label_col: str | None = "account.type", key: str = "post_id") -> DataFrame:
    """The per-post path on a static (micro-)batch: blank posts refused, text cleaned with the
    profile the models were fitted with, every model scored, thresholded and named. A batch is a few files, often of one
    row group each: its rows are dealt out first, else as many tasks as files would do all the work."""
    batch = batch.repartition(max(batch.rdd.getNumPartitions(), batch.sparkSession.sparkContext.defaultParallelism))
    accepted, _ = reject_blank(batch, "text")
    lab = encode_label(F.col(q(label_col))) if label_col and label_col in batch.columns else F.lit(None).cast("int")
    row = [c for c in (ROW,) if c in batch.columns]
    prepared = accepted.select(key, clean("text", profile.clean).alias("text"), lab.alias("label"), *row)
    wide = score_models(prepared, models, key=key, carry=("label",), profile=profile)
    long = with_display(to_long(wide, [m.name for m in models], key=key, threshold=profile.threshold))
    return long.select(key, "model", "label", "p", "predicted", "prediction")


BATCH_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("label", T.IntegerType()), T.StructField("p", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()), T.StructField("prediction", T.StringType()),
])
PRED_SCHEMA = T.StructType([*BATCH_SCHEMA, T.StructField("batch", T.LongType())])
COUNTS = ("tp", "fp", "fn", "tn")
COUNTS_SCHEMA = T.StructType([T.StructField("model", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])
FOLDERS_SCHEMA = T.StructType([T.StructField("folder", T.StringType()), T.StructField("batch", T.LongType())])


def _added(rows: list[dict]) -> list[dict]:
    """Counts of several batches added up: a row for each model."""
    total: dict[str, dict] = {}
    for r in rows:
        t = total.setdefault(r["model"], {"model": r["model"], **dict.fromkeys(COUNTS, 0)})
        for c in COUNTS:
            t[c] += r[c]
    return list(total.values())


def batch_log(spark: SparkSession, out_path: str) -> RunLog:
    """The finished batches of a prediction folder: which folder holds each."""
    return RunLog(spark, f"{out_path}/log", FOLDERS_SCHEMA)


def count_log(spark: SparkSession, metrics_path: str) -> RunLog:
    """Confusion counts of the finished batches, added up when runs are merged."""
    return RunLog(spark, metrics_path, COUNTS_SCHEMA, _added)


def finish_batch(spark: SparkSession, out_path: str, batch_id: int, rows: DataFrame) -> DataFrame:
    """Write a batch's rows to a new folder and publish it; the folders of earlier tries are deleted, the one that was visible until
    now when the next batch is finished (somebody may be reading it). Returns the rows as written."""
    log, data = batch_log(spark, out_path), f"{out_path}/data"
    seen = log.find(batch_id)
    visible = {r["folder"] for r in log.rows(seen)} if seen else set()
    for name in names(spark, data, f"{batch_id}-*"):
        if name not in visible:
            remove(spark, f"{data}/{name}")
    for run in log.runs():
        if run.level == 0 and run.last < batch_id:
            kept = {r["folder"] for r in log.rows(run)}
            for name in names(spark, data, f"{run.last}-*"):
                if name not in kept:
                    remove(spark, f"{data}/{name}")
    folder = f"{batch_id}-{uuid.uuid4().hex[:12]}"
    rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.parquet(f"{data}/{folder}")
    log.append(batch_id, [{"folder": folder, "batch": batch_id}])
    return spark.read.schema(PRED_SCHEMA).parquet(f"{data}/{folder}")


def compact_predictions(spark: SparkSession, out_path: str, rows_per_file: int = 1_000_000) -> int:
    """Rewrite the folders of every merged log entry as one folder with files of about ``rows_per_file`` rows, published by replacing the
    entry; returns how many entries were rewritten. With the log's levels, n batches then have about as many folders as the log has entries.
    What readers have open stays until :func:`delete_unpublished`."""
    log, data, done = batch_log(spark, out_path), f"{out_path}/data", 0
    for run in log.runs():
        rows = log.rows(run)
        if run.level > 0 and len(rows) > 1:
            folder = f"{run.first}-{run.last}-{uuid.uuid4().hex[:12]}"
            old = spark.read.schema(PRED_SCHEMA).parquet(*[f"{data}/{r['folder']}" for r in rows])
            old.coalesce(max(1, -(-old.count() // rows_per_file))).write.parquet(f"{data}/{folder}")
            log.replace(run, [{"folder": folder, "batch": run.last}])
            done += 1
    return done


def delete_unpublished(spark: SparkSession, out_path: str) -> list[str]:
    """Delete the folders of finished batches that no log entry names (earlier tries, folders that were rewritten); call it when
    no reader has them open. Folders of the batch that is being written stay."""
    log, data = batch_log(spark, out_path), f"{out_path}/data"
    runs = log.runs()
    kept = {r["folder"] for run in runs for r in log.rows(run)}
    last = max((run.last for run in runs), default=-1)
    gone = [n for n in names(spark, data) if n not in kept and int(n.split("-")[0]) <= last]
    for n in gone:
        remove(spark, f"{data}/{n}")
    return gone


def stream_predict(stream: DataFrame, models: list[TextModel], out_path: str, checkpoint: str,
                   profile: Profile = DEFAULT_PROFILE, trigger: dict | None = None, metrics_path: str | None = None):
    """Start the prediction stream; returns the StreamingQuery."""
    ready = prepare(models)

    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        done = finish_batch(spark, out_path, batch_id, predict_batch(batch, ready, profile))
        if metrics_path:
            counts = confusion_counts(done.filter(F.col("label").isNotNull())).collect()     # a row for each model
            count_log(spark, metrics_path).append(batch_id, [{"model": r["model"], **{c: r[c] for c in COUNTS}} for r in counts])

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def read_predictions(spark: SparkSession, out_path: str) -> DataFrame:
    """The predictions of all finished batches. A batch that is being written, or was left by a crash, isn't among them."""
    folders = [r["folder"] for r in batch_log(spark, out_path).snapshot()]     # one per batch, or per merged entry after compaction
    if not folders:
        return spark.createDataFrame([], PRED_SCHEMA)
    return spark.read.schema(PRED_SCHEMA).parquet(*[f"{out_path}/data/{f}" for f in folders])


def stream_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """Running confusion counts per model over all finished batches."""
    per_run = count_log(spark, metrics_path).table()
    return per_run.groupBy("model").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])
