"""Term arrays for the text scorers, as built-in functions (no Python).

word    = non-empty pieces between whitespace
bigram  = adjacent words joined by one blank
trigram = every 3-character substring that is not all whitespace

Fitting and scoring take texts apart with ``explode_terms``: one split into words and one into code points, whose shifted
slices are exploded side by side and put together as terms only then. ``words``, ``bigrams`` and ``trigrams`` give the terms as arrays,
in one codegen'd split / regex pass per kind; ``bigrams_of`` and ``trigrams_of_chars`` are the same definitions written with
array lambdas, kept as executable specifications for the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.functions.text import SPLIT_WS_RE, WS, WS_CHARS

TERM_KINDS = ("word", "bigram", "trigram")
_HAS_NON_WS = f"[^{WS}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """``array_remove`` drops the empty pieces (leading whitespace, empty text) in generated code;
    a ``filter`` lambda would be interpreted per element."""
    return F.array_remove(F.split(_c(c), SPLIT_WS_RE), "")


def bigrams_of(w: Column) -> Column:
    """Adjacent pairs of an array of words: the array zipped with itself shifted by one.
    (Indexing the array from inside a lambda would re-evaluate it per element.)"""
    k = F.size(w) - 1
    return F.when(F.size(w) >= 2,
                  F.zip_with(F.slice(w, 1, k), F.slice(w, 2, k), lambda a, b: F.concat(a, F.lit(" "), b))) \
        .otherwise(F.array().cast("array<string>"))


# Overlapping pairs in one regex pass over the text with whitespace runs collapsed to one blank and
# the ends trimmed: at every word start (not preceded by a non-blank, and not the second half of a
# surrogate pair, where a zero-width match can land), capture "word blank word".
_BIGRAM_RE = "(?<![^ ])(?![\\x{DC00}-\\x{DFFF}])(?=([^ ]+ [^ ]+))"


def bigrams(c) -> Column:
    """Adjacent words joined by one blank, as generated code (no lambda): equal to
    ``bigrams_of(words(c))``."""
    norm = F.regexp_replace(F.regexp_replace(_c(c), SPLIT_WS_RE, " "), "^ | $", "")
    return F.regexp_extract_all(norm, F.lit(_BIGRAM_RE), 1)


def trigrams_of_chars(chars: Column) -> Column:
    """3-code-point windows of an array of code points: the array zipped with its shifts.
    Exact for any text (supplementary characters included), but lambda-evaluated per element."""
    k = F.size(chars) - 2
    grams = F.zip_with(F.zip_with(F.slice(chars, 1, k), F.slice(chars, 2, k), lambda a, b: F.concat(a, b)),
                       F.slice(chars, 3, k), lambda ab, x: F.concat(ab, x))
    return F.when(F.size(chars) >= 3, F.filter(grams, lambda g: g.rlike(_HAS_NON_WS))) \
        .otherwise(F.array().cast("array<string>"))


# One regex pass: at every position, capture the next three code points unless all three are
# whitespace. A zero-width match advances one UTF-16 unit, so it can land between the halves of a
# surrogate pair; a start on a low surrogate is refused, which makes the pass exact for any text.
_TRIGRAM_RE = f"(?s)(?=((?![{WS}]{{3}})(?![\\x{{DC00}}-\\x{{DFFF}}]).{{3}}))"


def chars(c) -> Column:
    """One element per code point (Spark splits an empty pattern by code point)."""
    return F.split(_c(c), "")


def trigrams(c) -> Column:
    """3-code-point windows that are not all whitespace, in generated code (no lambda); equal to
    ``trigrams_of_chars(chars(c))``."""
    return F.regexp_extract_all(_c(c), F.lit(_TRIGRAM_RE), 1)


def terms(c, kind: str) -> Column:
    if kind == "word":
        return words(c)
    if kind == "bigram":
        return bigrams(c)
    if kind == "trigram":
        return trigrams(c)
    raise ValueError(f"unknown term kind {kind!r}; use one of {TERM_KINDS}")


def with_terms(df: DataFrame, text_col: str, kinds, prefix: str = "_terms_") -> DataFrame:
    """Adds one array column per term kind (``{prefix}{kind}``). Each kind is one pass of a
    codegen'd string function over the text (split / regex), so the whole projection stays in
    whole-stage codegen; no array is re-indexed from inside a lambda."""
    kinds = list(dict.fromkeys(kinds))
    out = []
    for k in kinds:
        if k in TERM_KINDS:
            out.append(terms(text_col, k).alias(prefix + k))
        else:
            raise ValueError(f"unknown term kind {k!r}; use one of {TERM_KINDS}")
    return df.select("*", *out)


def _side_by_side(m: int, n: Column, array: str, width: int) -> Column:
    """``n`` structs (m, a, b, c) of ``width`` neighbours each in ``array``; what a narrower term doesn't need is null."""
    none = F.array().cast("array<string>")
    shifted = [F.slice(F.col(array), F.lit(i + 1), n).alias(c) if i < width else none.alias(c) for i, c in enumerate("abc")]
    return F.arrays_zip(F.array_repeat(F.lit(m), n).alias("m"), *shifted)


def explode_terms(df: DataFrame, text_col: str, kinds, keep, per_text: bool = False) -> DataFrame:
    """(*keep, m, term): a row for each term of each text, ``m`` the place of its kind in ``kinds``; with ``per_text`` also a row
    (number of kinds, '') for each text. A text without terms has a row with a null term, and so has every place where three characters are
    all whitespace.

    No regex pass per kind and no string per term before the rows are there: a bigram is two neighbouring words, a trigram three
    neighbouring code points. ``inline_outer``, as a plain generator makes the optimizer infer "size(array) > 0" and push that copy of the
    whole term expression below the exchange."""
    kinds = list(kinds)
    for k in kinds:
        if k not in TERM_KINDS:
            raise ValueError(f"unknown term kind {k!r}; use one of {TERM_KINDS}")
    # the arrays and their sizes are columns of projections of their own, so that each is computed once
    arrays = [words(text_col).alias("_words")] * any(k != "trigram" for k in kinds) + [chars(text_col).alias("_chars")] * ("trigram" in kinds)
    df = df.select(*keep, *arrays)
    width = {"word": 1, "bigram": 2, "trigram": 3}
    source = {"word": "_words", "bigram": "_words", "trigram": "_chars"}
    df = df.select("*", *[F.greatest(F.size(source[k]) - (width[k] - 1), F.lit(0)).alias(f"_n_{k}") for k in dict.fromkeys(kinds)])
    parts = [_side_by_side(i, F.col(f"_n_{k}"), source[k], width[k]) for i, k in enumerate(kinds)]
    if per_text:
        parts.append(F.array(F.struct(F.lit(len(kinds)).alias("m"), *[F.lit("").alias(c) for c in "abc"])))
    rows = df.select(*keep, F.inline_outer(F.concat(*parts)))
    a, b, c = (F.col(x) for x in "abc")
    blank = reduce(lambda x, y: x & y, [x.isin(*WS_CHARS) for x in (a, b, c)])
    made = {"word": a, "bigram": F.concat(a, F.lit(" "), b), "trigram": F.when(~blank, F.concat(a, b, c))}
    term = F.when(F.lit(False), a)
    for i, k in enumerate(kinds):
        term = term.when(F.col("m") == i, made[k])
    return rows.select(*keep, "m", (term.otherwise(a) if per_text else term).alias("term"))
