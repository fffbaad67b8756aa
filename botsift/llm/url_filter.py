"""URL filter: host and path rules first, then host word segmentation and naive Bayes.

The longest rule that fits an url's host (or a parent domain) and the beginning of its path decides.
For urls without a rule, the letters of each host label are cut into words by a unigram Viterbi
search: word counts come from the visible text of all pages, and only the counts of those words are looked
up that stand somewhere in a host (distinct labels, all their substrings, one join). A multinomial naive Bayes over
host words and path tokens, with the pages that a rule decides as its labelled rows, gives the verdict.

Counts cover all pages and all words. Everything is done on distinct hosts and distinct urls, so a hot host or url
costs a row; in the joins back, a label, host or url of many rows is dealt into parts by their number.

Defined results: null urls and urls without ``://`` have an empty host and path, and no rule unless one
fits those; without pages that rules decide, or with one kind of them only, the more frequent verdict (allow
on a tie) stands for the rest; repeated rows and null ids give a row each; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.llm.common import HOT_ROWS, join_dealt
from botsift.session import materialize

# Fixed rules of the registered query: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters of the longest word that a host may be cut into
LONGEST_WORD = 20
SMOOTHING = 0.5
SALTS = 16
#: token weights that are broadcast; a larger table is joined by shuffle
BROADCAST_ROWS = 200_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as text), and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones stand in front
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): words of the visible text of all pages, in lower case."""
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely cut of a label; a string that is no word costs more with each letter."""
    n = len(label)
    best, back = np.full(n + 1, -np.inf), [0] * (n + 1)
    best[0] = 0.0
    for stop in range(1, n + 1):
        for start in range(max(0, stop - LONGEST_WORD), stop):
            word = label[start:stop]
            seen = counts.get(word, 0)
            cost = np.log(seen / total) if seen else np.log(10 / (total + 10)) - np.log(10) * len(word)
            if best[start] + cost > best[stop]:
                best[stop], back[stop] = best[start] + cost, start
    words, stop = [], n
    while stop:
        words.append(label[back[stop] : stop])
        stop = back[stop]
    return words[::-1]


def segmented(hosts: DataFrame, counts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(host, words): distinct hosts with the words of their labels, in order; none where a host has no letters."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pieces = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"\p{L}+"), F.lit(0))).alias("place", "label"))
    pieces = materialize(pieces, "host-labels")
    labels = pieces.select("label").distinct()
    inside = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("start"))
    inside = inside.select("label", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("label") - F.col("start") + 1))).alias("size"))
    inside = inside.select("label", F.substring(F.col("label"), F.col("start"), F.col("size")).alias("word")).distinct()
    known = inside.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    known = labels.join(known, "label", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [viterbi(label, {k["word"]: k["n"] for k in found or ()}, max(total, 1))
                   for label, found in zip(batch.column("label").to_pylist(), batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(cut, pa.list_(pa.string()))], names=["label", "words"])

    cut = known.mapInArrow(run, "label string, words array<string>")
    found = join_dealt(pieces, cut, "label", hot_rows).groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda s: s["words"])).alias("words"))
    return hosts.join(found, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def path_tokens(path: Column) -> Column:
    """Runs of letters in lower case, and runs of digits as their length."""
    found = F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+|\d+"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike(r"^\d"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, log_odds) of every page; log_odds of allow over block
    where no rule decides."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = materialize(rows, "page-urls")
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = materialize(urls.withColumn("rule", name).withColumn("verdict", verdict), "urls")
    counts = materialize(word_counts(pages, html_col), "page-words")
    words = segmented(urls.select("host").distinct(), counts, hot_rows)
    known = join_dealt(urls, words, "host", hot_rows)
    known = materialize(known.select("host", "path", "n", "rule", "verdict", F.col("words").alias("host_words")), "url-words")
    tokens = known.select("host", "path", "n", "verdict", F.explode(F.concat(
        F.transform("host_words", lambda w: F.concat(F.lit("host:"), w)), F.transform(path_tokens(F.col("path")), lambda w: F.concat(F.lit("path:"), w)))).alias("token"))
    allow = F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)
    block = F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)
    decided = known.agg(F.coalesce(F.sum(allow), F.lit(0)), F.coalesce(F.sum(block), F.lit(0))).first()
    per = materialize(tokens.where(F.col("verdict").isNotNull()).groupBy("token").agg(F.sum(allow).alias("a"), F.sum(block).alias("b")), "url-tokens")
    sums = per.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count(F.lit(1))).first()
    if decided[0] and decided[1]:
        prior = float(np.log(decided[0] / decided[1]))
        weight = F.log((F.col("a") + SMOOTHING) / F.lit(sums[0] + SMOOTHING * sums[2])) - F.log((F.col("b") + SMOOTHING) / F.lit(sums[1] + SMOOTHING * sums[2]))
        weights = per.select("token", weight.alias("weight"))
        open_ = tokens.where(F.col("verdict").isNull())
        if sums[2] <= BROADCAST_ROWS:
            scored = open_.join(F.broadcast(weights), "token")
        else:
            weights = weights.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
            scored = open_.withColumn("part", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(weights, ["token", "part"])
        scored = scored.groupBy("host", "path").agg(F.sum("weight").alias("evidence"))
        known = known.join(scored, ["host", "path"], "left").withColumn("log_odds", F.lit(prior) + F.coalesce("evidence", F.lit(0.0)))
    else:
        known = known.withColumn("log_odds", F.lit(-1.0 if decided[1] else 0.0))
    judged = known.select(
        "host", "path", "rule", F.coalesce("verdict", F.when(F.col("log_odds") >= 0, "allow").otherwise("block")).alias("verdict"),
        "host_words", F.when(F.col("verdict").isNull(), F.col("log_odds")).alias("log_odds"))
    return join_dealt(rows, judged, ["host", "path"], hot_rows).select("page_id", "host", "path", "rule", "verdict", "host_words", "log_odds")
