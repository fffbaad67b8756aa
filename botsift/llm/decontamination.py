"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item gives windows of ``window`` consecutive words (an item of fewer words is one window); a
window is the set of its word shingles with their offsets. Containment has to be whole, so the
necessary prefix of a window, its shingles ordered by rarity in the corpus, is its rarest shingle:
only occurrences of that one make candidates. A candidate is kept by its position (the window has
to start and end inside the text) and then verified on every shingle of the window at its offset.

One pass over the texts marks every occurrence of an item shingle; counts, prefix join and
verification work on these marks. Item tables are broadcast up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES``
of text, and shuffled beyond; a frequent prefix shingle is then dealt into parts by its count. No step brings the occurrences of one shingle, item or passage together in one task: counts
are combined before the shuffle and verification is keyed by document and place.

Defined results: null texts have no words; each repeated row gives a row (rows of equal id and
text share their result); a null doc_id is a document like any other; windows of an item with null
id mark words but aren't listed; empty tables give no hits; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from botsift.llm.common import HOT_ROWS, id_and_text, unused
from botsift.operators.joins import fits, size_of
from botsift.session import materialize

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: item shingles (a few words each) that are broadcast; a larger benchmark is joined by shuffle
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only (the quick form where the text is ASCII)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, wid, words): the windows of each item; wid is the window's words, space-joined."""
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item_id"),
        words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    one = items.select("item_id", "w", F.explode(starts).alias("s"))
    one = one.select("item_id", F.expr(f"slice(w, s, {window})").alias("words"))
    return one.select("item_id", F.concat_ws(" ", "words").alias("wid"), "words").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(wid, length, need, width, off, s1..): each distinct window's shingles with their offsets."""
    w = windows.select("wid", "words").dropDuplicates(["wid"])
    w = w.withColumn("length", F.size("words")).withColumn("width", F.least("length", F.lit(shingle)))
    w = w.withColumn("need", F.col("length") - F.col("width") + 1)
    w = w.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("need") - 1)))
    parts = [F.when(F.col("width") > k, F.get("words", F.col("off") + k)).alias(f"s{k}") for k in range(shingle)]
    return w.select("wid", "length", "need", "width", "off", *parts).withColumn("shingle", F.concat_ws(" ", *[f"s{k}" for k in range(shingle)]))


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def marked(docs: DataFrame, shingles: DataFrame, shingle: int, small: bool) -> DataFrame:
    """(doc_id, th, n_words, pos, shingle): every occurrence of an item shingle in a text, and for
    each row of ``docs`` one row without a shingle. One pass for all shingles of full width (and one
    more for each shorter width that the benchmark has)."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    base = base.withColumn("n_words", F.size("w"))
    widths = [r[0] for r in shingles.select("width").distinct().collect()]
    out = None
    for width in sorted({*widths, shingle}, reverse=True):
        # the last element stands for the row itself: it has a place, but no word of a shingle
        full = F.concat(F.col("w"), F.array(F.lit(""))) if width == shingle else F.col("w")
        runs = [full.alias("w0")] + [F.slice("w", k + 1, F.greatest(F.col("n_words"), F.lit(1))).alias(f"w{k}") for k in range(1, width)]
        at = base.select("doc_id", "th", "n_words", F.posexplode(F.arrays_zip(*runs)).alias("pos", "z"))
        at = at.select("doc_id", "th", "n_words", "pos", *[F.col(f"z.w{k}").alias(f"w{k}") for k in range(width)])
        at = at.withColumn("h", F.xxhash64(*[f"w{k}" for k in range(width)]))
        known = shingles.where(F.col("width") == width).select("shingle", *[f"s{k}" for k in range(width)]).distinct()
        known = known.withColumn("hs", F.xxhash64(*[f"s{k}" for k in range(width)]))
        same = F.col("h") == F.col("hs")
        for k in range(width):
            same = same & (F.col(f"w{k}") == F.col(f"s{k}"))
        hit = at.join(_small(known, small), same, "left")
        if width == shingle:
            hit = hit.where(F.col("shingle").isNotNull() | (F.col("w0") == ""))
        else:
            hit = hit.where(F.col("shingle").isNotNull())
        hit = hit.select("doc_id", "th", "n_words", "pos", "shingle")
        out = hit if out is None else out.unionByName(hit)
    return out


def window_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS,
                       id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                       item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, occurrences, item_windows): rows (doc_id, th, n_words) of every input row; occurrences
    (doc_id, th, start, length, wid) of windows in texts; and which item has which window."""
    windows = materialize(item_windows(benchmark, window, item_id_col, item_text_col), "item-windows")
    shingles = materialize(window_shingles(windows, shingle), "item-shingles")
    small = fits(*size_of(shingles, ["wid", "shingle", "shingle"]), BROADCAST_ROWS, BROADCAST_BYTES)
    marks = materialize(marked(id_and_text(docs, id_col, text_col), shingles, shingle, small), "shingle-marks")
    rows = marks.where(F.col("shingle").isNull()).select("doc_id", "th", "n_words")
    hits = marks.where(F.col("shingle").isNotNull())
    rarity = materialize(hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle-counts")
    # the rarest shingle of each window; a window with a shingle that no text has drops out here
    ordered = shingles.join(_small(rarity, small), "shingle", "left").groupBy("wid", "length", "need").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "shingle")).alias("first"))
    prefix = ordered.where("first.n > 0").select("wid", "length", "need", F.col("first.n").alias("n"), F.col("first.off").alias("off"), F.col("first.shingle").alias("shingle"))
    start = F.col("pos") - F.col("off")
    asked = hits
    if not small:  # the prefix of a window is its rarest shingle; even that may be frequent
        most = prefix.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        parts = -(-most // HOT_ROWS) or 1
        asked = hits.withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(parts)).cast("int"))
        prefix = prefix.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    candidates = asked.join(_small(prefix.drop("n"), small), ["shingle"] if small else ["shingle", "part"]).where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    candidates = candidates.select("doc_id", "th", start.alias("start"), "length", "need", "wid").distinct()
    expected = candidates.join(_small(shingles.select("wid", "off", "shingle"), small), "wid").select(
        "doc_id", "th", "start", "length", "need", "wid", (F.col("start") + F.col("off")).alias("pos"), "shingle")
    there = hits.select("doc_id", "th", "pos", "shingle").distinct()
    e, t = expected.alias("e"), there.alias("t")
    found = e.join(t, F.col("e.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("e.th") == F.col("t.th"))
                   & (F.col("e.pos") == F.col("t.pos")) & (F.col("e.shingle") == F.col("t.shingle")), "left_semi")
    found = found.groupBy("doc_id", "th", "start", "length", "need", "wid").agg(F.count(F.lit(1)).alias("n"))
    found = materialize(found.where("n = need").select("doc_id", "th", "start", "length", "wid"), "window-occurrences")
    return rows, found, windows.select("item_id", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, th, n_words, n_hit, item_ids) of every row; item_ids are sorted as strings."""
    rows, found, windows = window_occurrences(docs, benchmark, **options)
    key = ["doc_id", "th"]
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    small = fits(*size_of(windows, ["wid", "item_id"]), BROADCAST_ROWS, BROADCAST_BYTES)
    items = found.select(*key, "wid").distinct().join(_small(windows, small), "wid")
    items = items.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    both = hit.alias("h").join(items.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.th") == F.col("i.th")), "left").select(
        F.col("h.doc_id").alias("hit_doc"), F.col("h.th").alias("hit_th"), "n_hit", "item_ids")
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("th") == F.col("hit_th")), "left")
    return out.select(
        "doc_id", "th", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def report(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) without a window of an item."""
    keys = unused(docs.columns, "none", "id", "hash")
    hit = contamination(docs, benchmark).where("n_hit > 0").select(
        F.col("doc_id").isNull().alias(keys[0]), F.coalesce("doc_id", F.lit(0)).alias(keys[1]), F.col("th").alias(keys[2])).distinct()
    rows = docs.select(
        "*", F.col("doc_id").isNull().alias(keys[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[1]),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(keys[2]))
    return rows.join(hit, keys, "left_anti").drop(*keys)


def oracle(window: int = WINDOW_WORDS) -> str:
    """DuckDB SQL of the same rows, by comparing every place of every text with every window."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + {window - 1}), ' ') AS wid, least(len(w), {window}) AS length
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {window - 1}, 1))) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
lens AS (SELECT DISTINCT length FROM wins),
places AS (
  SELECT r, w, length, unnest(generate_series(1, len(w) - length + 1)) AS s FROM docs, lens WHERE len(w) >= length),
found AS (
  SELECT p.r, p.s, p.length, x.item_id
  FROM (SELECT r, s, length, array_to_string(list_slice(w, s, s + length - 1), ' ') AS wid FROM places) p JOIN wins x ON p.wid = x.wid AND p.length = x.length),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + length - 1)) AS pos FROM (SELECT DISTINCT r, s, length FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.l, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (r) LEFT JOIN ids i USING (r)"""
