"""The most frequent words equal the full count, and junk isn't shuffled."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from table_dirs import SF_ORACLE

from botsift.functions.terms import words
from botsift.operators import heavy
from botsift.operators.encode import build_vocab
from botsift.plans import catalog


def _texts(spark, rows, parts=6):
    return spark.createDataFrame([(t,) for t in rows], "text string").repartition(parts)


def _full(df, k):
    counts = df.select(F.explode(words("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return [tuple(r) for r in counts.orderBy(F.desc("n"), F.asc("token")).limit(k).collect()]


def _rows(df):
    return [tuple(r) for r in df.orderBy(F.desc("n"), F.asc("token")).collect()]


def test_a_summary_bounds_what_it_leaves_out():
    rng = random.Random(1)
    for _ in range(50):
        words_ = [rng.choice("abcdefgh" * 3 + "ijklmnopqrstuvwxyz") + rng.choice(["", "", "1", "2"]) for _ in range(rng.randint(0, 400))]
        true = {w: words_.count(w) for w in set(words_)}
        summary = heavy.Summary(rng.randint(1, 12))
        for i in range(0, len(words_), 37):
            part = words_[i : i + 37]
            summary.add(pa.array(part, pa.string()), pa.array([1] * len(part), pa.int64()))
        summary.cut()
        kept = dict(zip(summary.counts.column("token").to_pylist(), summary.counts.column("n").to_pylist()))
        assert len(kept) <= summary.capacity
        assert all(kept.get(w, 0) <= n <= kept.get(w, 0) + summary.lost for w, n in true.items())


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equal_to_the_full_count_under_junk(spark, k):
    rng = random.Random(k)
    common = [f"w{i}" for i in range(60)]
    rows = [" ".join(rng.choices(common, [1 / (i + 1) for i in range(60)], k=30)) + f" junk{i} junk{i}x {'z' * (i % 50)}{i}" for i in range(3000)]
    df = _texts(spark, rows)
    assert _rows(heavy.top_counts(df, words("text"), k, first=200)) == _full(df, k)


def test_flat_counts_and_ties_are_counted_in_full(spark):
    df = _texts(spark, [f"a{i} b{i}" for i in range(2000)] + ["a5"])
    for k in (1, 3, 40):
        assert _rows(heavy.top_counts(df, words("text"), k, first=20, most=100)) == _full(df, k)
    assert _rows(heavy.top_counts(_texts(spark, ["", "  "]), words("text"), 5)) == []
    assert _rows(heavy.top_counts(_texts(spark, ["one two two"]), words("text"), 5)) == [("two", 2), ("one", 1)]


def test_what_is_shuffled_doesnt_grow_with_junk(spark):
    def summaries(junk):
        df = _texts(spark, ["the cat and the dog " * 5 + " ".join(f"j{i}.{n}" for n in range(junk)) for i in range(400)], 4)
        listed = df.select(words("text").alias("words"))
        parts = listed.mapInArrow(heavy._of_words(64), heavy.SUMMARY).count()
        return parts, heavy.summary_of(listed, 64).count()

    few, many = summaries(10), summaries(1000)
    assert many[0] <= few[0] + 4 and many[0] <= 4 * 65 and many[1] <= 65


def test_vocabulary_of_the_most_frequent(spark):
    train = catalog.split_posts(spark, SF_ORACLE).filter(F.col("split") == "train")
    every = build_vocab(train).orderBy("id").limit(300).collect()
    assert build_vocab(train, size=300).orderBy("id").collect() == every
