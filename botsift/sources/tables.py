"""The driver's tables and the views of them that the workflow reads (FIXTURES §2).

P   posts          conversations -> post_id, text, account.type
P0  posts w/ gaps  P with some texts missing
H   markup         pages -> post_id, text = url + ' ' + html
L   second domain  documents joined to labels -> post_id, text, label = 1 - quality
E   vectors        embeddings -> post_id, embedding, label = (label >= 5)

Only the needed columns are selected, so Catalyst prunes the parquet scans to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.sources.rows import ROW, joined_row, with_scan_rows

LABEL_COL = "account.type"


def read_table(spark: SparkSession, sf_dir: str, name: str, row_id: bool = False) -> DataFrame:
    """A table; with ``row_id`` with the identity of each row (see :mod:`botsift.sources.rows`)."""
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return with_scan_rows(table) if row_id else table


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread rows over the cluster when the scan yields fewer splits than there are cores
    (a table written as one row group is read by one task, and every regex and n-gram over
    its texts would then run on one core). Large inputs already have enough splits and are
    left alone; the planner pushes filters and column pruning below the round-robin exchange."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def posts(spark: SparkSession, sf_dir: str, row_id: bool = False) -> DataFrame:
    """P: one post per conversation turn; the role gives the author type in mixed spelling
    (user -> human / Human, assistant -> bot / BOT, system stays 'system' and is not a class)."""
    c = spread(read_table(spark, sf_dir, "conversations", row_id))
    author = (
        F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, F.lit("Human")).otherwise(F.lit("human")))
        .when(F.col("role") == "assistant", F.when(F.col("conv_id") % 7 == 0, F.lit("BOT")).otherwise(F.lit("bot")))
        .otherwise(F.col("role"))
    )
    return c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("post_id"),
        F.col("text"),
        author.alias(LABEL_COL),
        *([ROW] if row_id else []),
    )


def posts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P with the text missing where length(text) % 50 = 0."""
    p = posts(spark, sf_dir)
    return p.withColumn("text", F.when(F.length("text") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("text")))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: raw web pages as posts (the URL supplies the 'http' case)."""
    pg = spread(read_table(spark, sf_dir, "pages"))
    return pg.select(F.col("page_id").cast("string").alias("post_id"),
                     F.concat(F.col("url"), F.lit(" "), F.col("html")).alias("text"))


def second_domain(spark: SparkSession, sf_dir: str, row_id: bool = False) -> DataFrame:
    """L: labelled documents; label = 1 - quality (low quality counts as machine-written)."""
    from botsift.operators.joins import join_small

    docs = spread(read_table(spark, sf_dir, "documents", row_id).select("doc_id", "text", *([ROW] if row_id else [])))
    labels = read_table(spark, sf_dir, "labels", row_id).select("doc_id", "quality", *([F.col(ROW).alias("_label_row")] if row_id else []))
    # labels grow with the corpus: broadcast only under the checked row bound (the count comes
    # from parquet footers), so the document texts are not shuffled; beyond it a shuffle join
    return join_small(docs, labels, "doc_id", "inner").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("text"),
        (F.lit(1) - F.col("quality")).cast("int").alias("label"),
        *([joined_row(F.col(ROW), F.col("_label_row")).alias(ROW)] if row_id else []),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: one embedding (64 floats) per post; positive class = original label >= 5."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("post_id"), F.col("embedding"),
                    (F.col("label") >= 5).cast("int").alias("label"))
