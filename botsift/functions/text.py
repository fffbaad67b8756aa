"""Text cleaning as built-in Column expressions.

The rules are those of Python's ``re`` on ``str`` patterns: ``\\S`` and ``strip()`` are Unicode-aware
and ``.`` stops only at a line feed. Java's regex classes are ASCII and its ``.`` also stops at
CR, U+0085, U+2028 and U+2029, so the classes are spelled out instead of using ``\\s`` / ``.``.
Everything stays inside whole-stage codegen; no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true, i.e. Unicode White_Space
# plus the separators U+001C..U+001F:
#   U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
#   U+202F, U+205F, U+3000
# As the body of a Java regex class this is "\x1c-\x1f" plus the White_Space property: one
# property lookup per character instead of a chain of a dozen range tests (4-5x faster).
WS = r"\x1c-\x1f\p{IsWhite_Space}"
#: the same characters one by one
WS_CHARS = tuple(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
WS_EXPLICIT = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

URL_RE = f"http[^{WS}]+"          # "http" and everything up to the next whitespace
TAG_RE = r"<[^\n]*?>"             # shortest <...> within one line
NON_LETTER_RE = f"[^a-zA-Z{WS}]"  # all but ASCII letters and whitespace
EDGE_WS_RE = f"^[{WS}]+|[{WS}]+\\z"
SPLIT_WS_RE = f"[{WS}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c) -> Column:
    return F.regexp_replace(_c(c), URL_RE, "")


def strip_tags(c) -> Column:
    return F.regexp_replace(_c(c), TAG_RE, "")


def strip_non_letters(c) -> Column:
    return F.regexp_replace(_c(c), NON_LETTER_RE, "")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (Spark ``trim`` only removes U+0020)."""
    return F.regexp_replace(_c(c), EDGE_WS_RE, "")


def lower_strip(c) -> Column:
    return strip_ws(F.lower(_c(c)))


def clean_strong(c) -> Column:
    """URLs, then tags, then non-letters, then lower + strip. The order matters."""
    return lower_strip(strip_non_letters(strip_tags(strip_urls(c))))


def clean_light(c) -> Column:
    """URLs, then tags, then lower + strip (digits, punctuation and accents stay)."""
    return lower_strip(strip_tags(strip_urls(c)))


def clean_raw(c) -> Column:
    return _c(c)


def clean(c, profile: str = "strong") -> Column:
    if profile == "strong":
        return clean_strong(c)
    if profile == "light":
        return clean_light(c)
    if profile == "raw":
        return clean_raw(c)
    raise ValueError(f"unknown cleaning profile {profile!r}")


TRACE_STEPS = ("original", "urls_removed", "tags_removed", "non_letters_removed", "lowercased")


def clean_trace(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep, step_no, step, value): one row per stage of the strong cleaning.

    Each stage is a column of a projection of its own, made from the one before; only then the columns become
    rows (under ``inline`` the whole chain would be written out again for every stage).
    """
    stages = [f"_{name}" for name in TRACE_STEPS]
    out = df.select(*keep, F.col(text_col).alias(stages[0]))
    for rule, before, after in zip((strip_urls, strip_tags, strip_non_letters, lower_strip), stages, stages[1:]):
        out = out.withColumn(after, rule(before))
    return out.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), F.col(f"_{name}").alias("value"))
        for i, name in enumerate(TRACE_STEPS)])))


def is_blank(c) -> Column:
    """True when nothing but Unicode whitespace is left (or the value is null)."""
    return F.coalesce(F.length(strip_ws(c)) == 0, F.lit(True))
