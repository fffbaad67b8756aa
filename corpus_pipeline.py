"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

toxicity (documents scored as toxic go), SimHash near-dedup (one document of each group stays), suffix-array dedup (bytes
of strings that also start earlier go; a document of which nothing is left stays with an empty text), benchmark decontamination
(documents with an item's window go), SentencePiece encoding and decoding (ids and digests). All but the last return the
columns of ``documents``, n_chars anew after the third. Empty tables, nulls and repeated rows are handled as the operators state.

Texts pass to Python in small batches. A stage returns a plan that its caller evaluates, so a stage that is called by itself leaves
that batch size set; ``run`` puts the caller's back. ``run`` writes every stage's result, and deletes its inner tables and the result before.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from botsift.llm import decontamination, sentencepiece_codec, simhash, suffix_dedup, toxicity  # noqa: E402
from botsift.llm.queries import vocabulary  # noqa: E402
from botsift.session import discard, materialize, scratch_scope, ship_package  # noqa: E402
from botsift.sources.tables import read_table, spread  # noqa: E402


#: rows of documents that pass to Python at a time (a few MB of text, where the default would take all of a task)
ARROW_ROWS = 1_000
#: the codec's steps and cache: the executors' memory is fuller here than in a query of its own
CODEC_STEP_BYTES, CODEC_PARTS = 1 << 19, 200_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set(BATCH_SETTING, ARROW_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return toxicity.clean_rows(spread(docs), read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.one_of_each(spread(docs), simhash.SHINGLE_WORDS, simhash.MAX_DISTANCE)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return suffix_dedup.shortened(spread(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontamination.clean_rows(spread(docs), read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    coded = sentencepiece_codec.encode_decode(spread(docs), vocabulary(), step_bytes=CODEC_STEP_BYTES, cache_parts=CODEC_PARTS)
    return sentencepiece_codec.digests(coded, "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for _, stage in STAGES:
            with scratch_scope(spark) as scope:
                result = scope.keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{stage.__name__}"))
            discard(spark, docs)  # the given table isn't of the shared folder, and stays
            docs = result
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs


#: no SQL can express the stages
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
