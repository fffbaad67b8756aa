"""Golden cleaning cases, and random texts against a character scanner written from the cleaning rules."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from botsift.functions import text as tx

# (input, strong, light)
GOLDEN = [
    ("http://a\xa0b c", "b c", "b c"),
    ("x http://a\x0bb", "x \x0bb", "x \x0bb"),
    ("x http://a\x1cb", "x \x1cb", "x \x1cb"),
    ("a<x\ny>b<z>c", "ax\nybc", "a<x\ny>bc"),
    ("a<x\ry>b", "ab", "ab"),
    ("a<x y>b", "ab", "ab"),
    ("a<x\x85y>b", "ab", "ab"),
    ("\t a \n", "a", "a"),
    ("\xa0a\xa0", "a", "a"),
    ("a\xa0b", "a\xa0b", "a\xa0b"),
    ('<a href="http://x.com">link</a> tail', "a href tail", '<a href=" tail'),
    ("ΟΔΟΣ İ ẞ", "", "οδος i̇ \xdf"),
    ("KK ſ", "kk", "kk ſ"),
    (" \t ", "", ""),
    ("\xe9İI", "i", "\xe9i̇i"),
    ("a\x1cb\x85c", "a\x1cb\x85c", "a\x1cb\x85c"),
    ("Hello, World! 123", "hello world", "hello, world! 123"),
    ("seehttps://t.co/x now", "see now", "see now"),
    ("http alone", "http alone", "http alone"),
    ("a < b > c", "a  c", "a  c"),
    ("#tag @user 50%", "tag user", "#tag @user 50%"),
    ("", "", ""),
    ("it's  two  spaces", "its  two  spaces", "it's  two  spaces"),
    ("<<b>>x", "x", ">x"),
]


def without_urls(s):
    """Scan for the four letters that begin an url and at least one more character that is no white space."""
    out, i = [], 0
    while i < len(s):
        stop = i + 4 if s.startswith("http", i) else i
        while stop > i and stop < len(s) and not s[stop].isspace():
            stop += 1
        if stop > i + 4:
            i = stop
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def without_tags(s):
    """From a left angle bracket to the next right one, if both stand on one line."""
    done = ""
    while "<" in s:
        head, _, s = s.partition("<")
        line = s.split("\n", 1)[0]
        if ">" in line:
            done, s = done + head, s[line.index(">") + 1 :]
        else:
            done += head + "<"
    return done + s


def trimmed(s):
    s = s.lower()
    inside = [i for i, c in enumerate(s) if not c.isspace()]
    return s[inside[0] : inside[-1] + 1] if inside else ""


def py_light(s):
    return trimmed(without_tags(without_urls(s)))


def py_strong(s):
    return trimmed("".join(c for c in without_tags(without_urls(s)) if c.isspace() or c.isascii() and c.isalpha()))


def _run(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", tx.clean_strong("s").alias("strong"), tx.clean_light("s").alias("light")).collect()
    return {r.i: (r.strong, r.light) for r in rows}


def test_golden_cases(spark):
    got = _run(spark, [g[0] for g in GOLDEN])
    for i, (src, strong, light) in enumerate(GOLDEN):
        assert py_strong(src) == strong and py_light(src) == light, src  # the table itself
        assert got[i] == (strong, light), (src, got[i])


def test_random_unicode_matches_python(spark):
    rng = random.Random(7)
    alphabet = (
        list("abcXYZ09 <>/:.htp#@'\"\n\r\t") + ["http", "<a>", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0",
        " ", " ", " ", "​", " ", " ", " ", " ", "　", "﻿",
        "\xe9", "İ", "Σ", "ſ", "\U0001F600"]
    )
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    got = _run(spark, values)
    bad = [(v, got[i]) for i, v in enumerate(values) if got[i] != (py_strong(v), py_light(v))]
    assert not bad, bad[:5]


def test_trace_steps(spark):
    df = spark.createDataFrame([("1", '<a href="http://x.com">link</a> tail')], "post_id string, text string")
    rows = tx.clean_trace(df, "text", "post_id").orderBy("step_no").collect()
    assert [r.step for r in rows] == list(tx.TRACE_STEPS)
    assert rows[-1].value == "a href tail"
    assert rows[1].value == '<a href=" tail'


def test_property_class_equals_explicit_list(spark):
    """The fast class body and the explicit character list select the same characters."""
    chars = [chr(c) for c in range(0, 0x3100)] + ["\U0001F600", "﻿", "᠎"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    rows = df.select("c", F.col("c").rlike(f"^[{tx.WS}]$").alias("a"),
                     F.col("c").rlike(f"^[{tx.WS_EXPLICIT}]$").alias("b")).collect()
    assert all(r.a == r.b == r.c.isspace() for r in rows), [r for r in rows if not (r.a == r.b == r.c.isspace())][:5]
