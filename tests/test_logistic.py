"""Logistic regression over the whole vocabulary against plain numpy, and what it is good for."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from table_dirs import SF_ORACLE, SF_SMALL

from botsift.operators.logistic import fit_text_lr
from botsift.operators.textmodels import score_models
from botsift.plans import catalog
from botsift.sources.rows import ROW


def plain(posts, steps, rate, reg):
    """Full-batch Adam on a dense matrix of counts."""
    words = sorted({w for t, _ in posts for w in t.split()})
    place = {w: i + 1 for i, w in enumerate(words)}
    x = np.zeros((len(posts), len(words) + 1))
    x[:, 0] = 1
    for r, (t, _) in enumerate(posts):
        for w in t.split():
            x[r, place[w]] += 1
    y = np.array([label for _, label in posts], float)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(posts) + reg * w * (np.arange(len(w)) > 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[0], dict(zip(words, w[1:]))


POSTS = ([("good day sun sun", 0), ("good good friend", 0), ("click now offer", 1), ("offer offer sun", 1), ("", 1), ("", 0), ("now", 0), ("x" * 5000 + " click", 1)]
         + [("the same copy again", 1)] * 12)


@pytest.mark.parametrize("block_words", [1, 20, 500_000])
def test_weights_equal_plain_steps(spark, block_words):
    df = spark.createDataFrame([(str(i % 9), t, y) for i, (t, y) in enumerate(POSTS)], "post_id string, text string, label int").repartition(3)
    model = fit_text_lr(df, steps=12, rate=0.1, reg=0.01, block_words=block_words)
    bias, weights = plain(POSTS, 12, 0.1, 0.01)
    got = {r.term: r.weight for r in model.weights.collect()}
    assert got.keys() == weights.keys() and model.n_terms == len(weights) and model.bias == pytest.approx(bias, abs=1e-9)
    assert all(got[t] == pytest.approx(weights[t], abs=1e-9) for t in weights)


def test_every_word_has_its_own_weight(spark):
    """More words than any hashed space of the former size would keep apart: words of either class keep their sign."""
    n = 40_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("post_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"),
                                 (F.col("id") % 2).cast("int").alias("label"))
    model = fit_text_lr(rows, steps=2)
    wrong = model.weights.where((F.col("weight") > 0) != (F.substring("term", -1, 1).cast("int") % 2 == 1)).count()
    assert model.n_terms == n and wrong == 0


def test_learns_and_is_scored_with_the_other_models(spark):
    sp = catalog.split_posts(spark, SF_ORACLE)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    model = fit_text_lr(train)
    wide = score_models(sp, [model])
    loss = {r.split: r.loss for r in wide.join(sp.select("post_id", "split"), "post_id").groupBy("split").agg(
        F.avg(-F.log(F.when(F.col("label") == 1, F.col("p_lr")).otherwise(1 - F.col("p_lr")))).alias("loss")).collect()}
    assert loss["train"] < 0.6 * np.log(2)
    both = score_models(test, [model, *catalog.fit_all_models(train, catalog.DEFAULT_REGISTRY[:1])])
    assert both.columns == ["post_id", "label", "p_lr", "p_nb_word"] and both.count() == test.count()


def test_without_identities_and_without_posts(spark):
    sp = catalog.split_posts(spark, SF_SMALL).filter(F.col("split") == "train")
    a, b = fit_text_lr(sp, steps=3), fit_text_lr(sp.drop(ROW), steps=3)
    assert a.bias == pytest.approx(b.bias) and {(r.term, round(r.weight, 9)) for r in a.weights.collect()} == {(r.term, round(r.weight, 9)) for r in b.weights.collect()}
    with pytest.raises(ValueError, match="no posts"):
        fit_text_lr(sp.limit(0))
