"""Term arrays: words, bigrams and trigrams against plain Python definitions."""

import random

import pytest
from pyspark.sql import functions as F

from botsift.functions.terms import bigrams, trigrams, trigrams_of_chars, chars, words, with_terms
from botsift.functions.text import WS_CHARS


def py_words(s):
    return s.split()  # str.split() splits on Unicode whitespace (isspace) and drops empties


def py_trigrams(s):
    return [s[i:i + 3] for i in range(len(s) - 2) if not s[i:i + 3].isspace()]


def test_terms_match_python(spark):
    rng = random.Random(11)
    alphabet = list("abc XY\t\n") + ["\xa0", " ", "\x1c", "é", "\U0001F600", "\U00010348", "  "]
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    values += ["", "a", "ab", "abc", "   ", "\U0001F600ab", "a\U0001F600\U0001F600b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", words("s").alias("w"), bigrams("s").alias("b"), trigrams("s").alias("t"),
                     trigrams_of_chars(chars("s")).alias("t2")).collect()
    for r in rows:
        v = values[r.i]
        w = py_words(v)
        assert r.w == w, v
        assert r.b == [f"{a} {b}" for a, b in zip(w, w[1:])], v
        assert r.t == py_trigrams(v), (v, r.t)
        assert r.t2 == py_trigrams(v), (v, r.t2)


def test_with_terms_columns(spark):
    df = spark.createDataFrame([("x y  z",)], "text string")
    r = with_terms(df, "text", ["word", "bigram", "trigram"]).first()
    assert r["_terms_word"] == ["x", "y", "z"] and r["_terms_bigram"] == ["x y", "y z"]
    assert r["_terms_trigram"] == ["x y", " y ", "y  ", "  z"]


def test_exploded_terms_are_those_of_the_arrays(spark):
    """Words, bigrams and trigrams of the rows are the arrays' ones, for random Unicode with every kind of whitespace."""
    from collections import Counter

    from botsift.functions.terms import TERM_KINDS, explode_terms

    rng = random.Random(5)
    alphabet = [*"ab c<", *WS_CHARS, "\u00e9", "\U0001f600", "\u200b", "\u4e2d"]
    texts = [None, "", " ", "\t\n\u3000", "a", "a b", "abc", *["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(200)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    kinds = ["trigram", "word", "bigram", "word"]
    arrays = {r.id: r for r in with_terms(df, "text", TERM_KINDS).collect()}
    for per_text in (False, True):
        got = {i: Counter() for i in arrays}
        for r in explode_terms(df, "text", kinds, ["id"], per_text).collect():
            got[r.id][(r.m, r.term)] += r.term is not None
        for i, r in arrays.items():
            want = Counter((m, t) for m, k in enumerate(kinds) for t in (r[f"_terms_{k}"] or ()))
            if per_text and r.text is not None:
                want[(len(kinds), "")] += 1
            assert +got[i] == want, r.text
    with pytest.raises(ValueError):
        explode_terms(df, "text", ["letter"], ["id"])


def test_terms_are_exploded_without_a_regex_pass_per_kind(spark):
    from botsift.functions.terms import explode_terms
    from botsift.operators.textmodels import term_counts

    df = spark.createDataFrame([("a b c", 1), ("b c", 0)], "text string, label int")
    counts = term_counts(df, [("w", "word"), ("b", "bigram"), ("t", "trigram")])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("split(") == 2 and plan.count("Generate inline") == 1
    got = {(r.model, r.term): (r.c1, r.c0) for r in counts.collect()}
    assert got[("w", "b")] == got[("b", "b c")] == got[("t", "b c")] == got[("__posts__", "")] == (1, 1) and got[("b", "a b")] == (1, 0)
    assert None not in {k[1] for k in got}
