"""The K most frequent words, counted exactly, without shuffling the others.

Full counts shuffle a row for every distinct word of every task, and most distinct words of a large crawl are junk. Here each
task keeps a summary of at most ``capacity`` counters: when there are more, the (capacity+1)-th largest count is taken off all of them
and those that reach zero go. Summaries are merged the same way, in two levels. What has been taken off, added over all steps, bounds what a word
can have lost: a word that isn't in the merged summary occurs at most that often.

The words of the summary are then counted exactly (map-side combined, nothing else is shuffled). If the K-th of them occurs more often than the
bound, no other word can belong to the K most frequent: the result is proven. Otherwise the capacity is raised, and where even the largest one
proves nothing (counts so flat that there are no frequent words), all words are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.operators.joins import join_small
from botsift.session import discard, materialize

SUMMARY = "token string, n long"
#: counters for each word asked for, at first and at most
FIRST, MOST = 4, 64
LEAST_COUNTERS = 1024
#: tasks of the first merge
MERGERS = 32


class Summary:
    """Counters of words; ``lost`` bounds what any word may have lost."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.lost = capacity, pa.table({"token": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0

    def add(self, tokens: pa.Array, n: pa.Array) -> None:
        both = pa.concat_tables([self.counts, pa.table({"token": tokens.cast(pa.string()), "n": n})])
        self.counts = both.group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
        if self.counts.num_rows > 2 * self.capacity:
            self.cut()

    def cut(self) -> None:
        """No more than ``capacity`` counters stay."""
        n = self.counts.column("n").to_numpy()
        if len(n) > self.capacity:
            off = int(np.partition(n, len(n) - self.capacity - 1)[len(n) - self.capacity - 1])
            left = pc.subtract(self.counts.column("n"), off)
            self.counts = pa.table({"token": self.counts.column("token"), "n": left}).filter(pc.greater(left, 0))
            self.lost += off

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The counters, and what was lost in a row without a word."""
        self.cut()
        yield from self.counts.cast(pa.schema([("token", pa.string()), ("n", pa.int64())])).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([self.lost], pa.int64())], names=["token", "n"])


def _of_words(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            words = batch.column(0).flatten()
            if len(words):
                found = words.value_counts()
                summary.add(found.field("values"), found.field("counts"))
        yield from summary.rows()
    return run


def _merged(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            known = batch.column(0).is_valid()
            summary.lost += pc.sum(batch.column(1).filter(pc.invert(known))).as_py() or 0
            summary.add(batch.column(0).filter(known), batch.column(1).filter(known))
        yield from summary.rows()
    return run


def summary_of(words: DataFrame, capacity: int) -> DataFrame:
    """(token, n) of at most ``capacity`` words of a table of word arrays, and a row without a word: no word that isn't
    here occurs more often than that row's n."""
    parts = words.mapInArrow(_of_words(capacity), SUMMARY).withColumn("part", F.spark_partition_id() % MERGERS)
    some = parts.repartition(MERGERS, "part").select("token", "n").mapInArrow(_merged(capacity), SUMMARY)
    return some.repartition(1).mapInArrow(_merged(capacity), SUMMARY)       # at most MERGERS summaries


def top_counts(texts: DataFrame, words: Column, k: int, first: int | None = None, most: int | None = None) -> DataFrame:
    """(token, n) of the ``k`` most frequent words, ties by word: the same rows as counting all words gives."""
    listed = texts.select(words.alias("words"))
    capacity, limit = first or max(FIRST * k, LEAST_COUNTERS), most or max(MOST * k, LEAST_COUNTERS)
    counts = lambda tokens: tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    tokens = listed.select(F.explode_outer("words").alias("token")).where(F.col("token").isNotNull())
    ordered = [F.desc("n"), F.asc("token")]
    while capacity <= limit:
        summary = materialize(summary_of(listed, capacity), "frequent-words")
        bound = summary.where(F.col("token").isNull()).agg(F.max("n")).first()[0] or 0
        asked = summary.where(F.col("token").isNotNull()).select("token")
        found = materialize(counts(join_small(tokens, asked, "token", "left_semi", str_cols=("token",))).orderBy(*ordered).limit(k), "frequent-counts")
        n, least = found.agg(F.count(F.lit(1)), F.min("n")).first()
        discard(texts.sparkSession, summary)
        if bound == 0 or (n == k and least > bound):
            return found
        discard(texts.sparkSession, found)
        capacity *= 4
    return counts(tokens).orderBy(*ordered).limit(k)
