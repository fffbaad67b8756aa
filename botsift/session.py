"""Session helpers: a local session for tests / bench, and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "botsift", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured like the cluster one (AQE on, UI off, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BOTSIFT_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local session (tests) may leave it unset: then a folder of our own is
    made and registered. On a cluster no machine's own folder would do, so an unset one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="botsift-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder (never reused, so no clean-up race)."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    for scope in getattr(spark.sparkContext, "_botsift_scopes", ()):
        scope.paths.append(path)
    return path


class ScratchScope:
    """The folders that were made inside a :func:`scratch_scope`."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, written):
        """Don't delete this folder, or table of :func:`materialize`; returns it."""
        path = written if isinstance(written, str) else written._written_at
        self.paths = [p for p in self.paths if p != path]
        return written


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete, at the end, every intermediate table that was written inside (numbered and ranked rows, fitted counts, split keys, ...).
    What is wanted afterwards has to be written elsewhere, collected, or kept by the scope; lazy results of the inside can't be read any more."""
    sc, scope = spark.sparkContext, ScratchScope()
    sc._botsift_scopes = [*getattr(sc, "_botsift_scopes", ()), scope]
    try:
        yield scope
    finally:
        sc._botsift_scopes = [s for s in sc._botsift_scopes if s is not scope]
        for path in scope.paths:
            discard(spark, path)


def materialize(df, name: str):
    """Write ``df`` as parquet in the shared folder and read it back: cuts the lineage (a lost
    executor cannot force a recomputation from the source), keeps column statistics for the
    planner, and is readable by any later job. Preferred over RDD checkpoints for large tables."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._written_at = path
    return out


#: rows of texts that a scan decodes, and that pass to Python, at a time inside :func:`small_batches`
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 256, "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000}


@contextmanager
def small_batches(spark: SparkSession):
    """What is evaluated inside holds few texts at a time (the default would be thousands, whatever their length); the session's
    own settings are put back at the end. Smaller ones stay."""
    before = {k: spark.conf.get(k) for k in SMALL_BATCHES}
    try:
        for k, rows in SMALL_BATCHES.items():
            spark.conf.set(k, min(int(before[k]), rows) if int(before[k]) > 0 else rows)
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def discard(spark: SparkSession, written) -> None:
    """Delete a table of :func:`materialize` (or a folder of :func:`scratch_path`) that no later plan reads."""
    path = written if isinstance(written, str) else getattr(written, "_written_at", None)
    if path and path.startswith(shared_dir(spark).rstrip("/") + "/"):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Make ``botsift`` importable in the Python workers of this context (numpy kernels of the
    head run inside tasks). The package is zipped once on the driver and added with ``addPyFile``,
    which is how Spark distributes Python code to every executor; done once per SparkContext."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_botsift_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="botsift-pyfiles-"), "botsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._botsift_shipped = True
