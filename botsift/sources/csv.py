"""Delimited-file sources (S1-S3) and the matching writer used by sinks and tests.

A labelled posts file is read with an explicit all-string schema (no inference pass) plus two
extra columns that let us reproduce the bad-line rule of the original reader:

* a line with too many fields is skipped,
* a line with too few fields is kept and padded with nulls.

Spark flags both shapes as corrupt. With one surplus column ``_overflow`` declared, a line of
exactly N fields is "corrupt" (one short) and a line of N+1 fields is not, so a line is too long
iff ``_overflow IS NOT NULL OR _corrupt_record IS NULL`` -- or, when the first surplus field is
empty (``_overflow`` null), iff the raw record kept in ``_corrupt_record`` has more than N fields.
That count is two regex passes: doubled quotes, then quoted fields are removed, and the
separators left are counted.

Before reading, one distributed pass over the lines surveys the blocks of the files (:mod:`botsift.sources.records`). Without a
line that ends inside a quoted field, and with one header, the files are read as lines, split over tasks. Otherwise whole
records are put together first, by as many tasks, and parsed by the same rule; columns that stand in another order in some files are
matched by name, other columns are an error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.operators.joins import join_small
from botsift.sources.columns import q
from botsift.sources.records import records_of, survey
from botsift.sources.rows import ROW

OVERFLOW = "_overflow"
CORRUPT = "_corrupt_record"

# The words the original (pandas) reader turns into a missing value by default.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ON_BAD = ("skip", "fail", "keep")


def _format(sep: str) -> dict[str, str]:
    """How a record is parsed. The bad-line rule needs every field of a line, also when the caller selects a few columns."""
    return {"sep": sep, "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
            "columnPruning": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _reader(spark: SparkSession, sep: str, multi_line: bool):
    return spark.read.options(**_format(sep)).option("header", True).option("multiLine", multi_line)


def raw_field_count(record, sep: str):
    """Fields of one raw CSV record: separators outside quoted fields, plus one.

    Doubled quotes are removed first (that keeps the parity of the quotes before every character,
    so no separator changes sides); a quoted field is then a quote at a field start, non-quotes and
    a quote -- a plain character-class loop, which Java's regex runs without recursion whatever the
    length of the text (an alternation inside a repeated group would recurse per character)."""
    esc = re.escape(sep)
    no_pairs = F.regexp_replace(record, '""', "")
    unquoted = F.regexp_replace(no_pairs, f'(?:^|(?<={esc}))"[^"]*"', "")
    return F.size(F.split(unquoted, esc, -1))


def header_columns(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> list[str]:
    """Column names from the header line (reads the first record only, no inference)."""
    return _reader(spark, sep, multi_line).csv(path).columns


def read_posts_csv(spark: SparkSession, path: str, sep: str = ",", on_bad: str = "skip",
                   null_words=NULL_WORDS, multi_line: bool | None = None, columns: list[str] | None = None, row_id: bool = False) -> DataFrame:
    """Read delimited posts files with a header each; every column is a string. ``multi_line=None``: records are put together
    where a quoted field may hold a line break; True: such fields, and each file is read whole by one task (only needed for files whose
    lines end in a lone carriage return, which are read so anyway); False: there are none.

    on_bad='skip' drops over-long lines (training / evaluation scripts), 'fail' stops the job on one (prepared test files), 'keep'
    keeps them (surplus fields dropped). ``row_id``: with the identity of each record (:mod:`botsift.sources.rows`: its file, block and
    number), so that scoring and encoding write no copy of the texts; the same as long as the files are split alike.
    """
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}")
    starts = survey(spark, path, sep)
    files = starts.where(F.col("block") == 0).select("file", "header")
    seen = starts.agg(F.min("header").alias("first"), F.max("header").alias("last"), F.coalesce(F.max("opens"), F.lit(False)).alias("opens"),
                      F.coalesce(F.max(F.contains("header", F.lit("\r"))), F.lit(False)).alias("returns")).first()
    alike = seen["first"] == seen["last"]
    spans = seen["opens"] if multi_line is None else multi_line
    if row_id and (multi_line or seen["returns"]):
        raise ValueError("rows are told apart by blocks and lines; files that are read whole have none")
    if alike and not row_id and (multi_line or seen["returns"] or not spans):
        return _read_alike(spark, path, sep, on_bad, null_words, bool(multi_line or seen["returns"]), columns)
    return _read_records(spark, path, sep, on_bad, null_words, columns, starts, files, seen["first"], row_id)


def _judged(raw: DataFrame, cols: list[str], sep: str, on_bad: str, path) -> DataFrame:
    """The bad-line rule on rows with the columns ``cols`` and the two extra ones."""
    too_long = (F.col(OVERFLOW).isNotNull() | F.col(CORRUPT).isNull()
                | (raw_field_count(F.col(CORRUPT), sep) > F.lit(len(cols))))
    if on_bad == "skip":
        return raw.filter(~too_long)
    if on_bad == "fail":
        return raw.filter(F.when(too_long, F.raise_error(F.lit(f"{path}: line with too many fields"))).otherwise(F.lit(True)))
    return raw


def _without_null_words(value, null_words):
    return F.when(value.isin(list(null_words)), F.lit(None).cast("string")).otherwise(value) if null_words else value


def _read_alike(spark: SparkSession, path, sep: str, on_bad: str, null_words, multi_line: bool, columns: list[str] | None) -> DataFrame:
    """Files of one header, by Spark's own reader."""
    cols = columns or header_columns(spark, path, sep, multi_line)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in (*cols, OVERFLOW, CORRUPT)])
    raw = _reader(spark, sep, multi_line).schema(schema).option("enforceSchema", True).csv(path)
    return _judged(raw, cols, sep, on_bad, path).select(*[_without_null_words(F.col(q(c)), null_words).alias(c) for c in cols])


def _parsed(text, n: int, sep: str):
    """The fields of a record as a struct of ``n`` strings f0, f1, ... and the two extra columns."""
    return F.from_csv(text, ", ".join(f"{c} string" for c in (*[f"f{i}" for i in range(n)], OVERFLOW, CORRUPT)), _format(sep))


def _names(record, sep: str, width: int):
    """The names that a header line gives, as an array (null: no name)."""
    n = F.least(raw_field_count(record, sep), F.lit(width))
    fields = _parsed(record, width, sep)
    return F.slice(F.array(*[fields[f"f{i}"] for i in range(width)]), F.lit(1), n)


def _safe(names: list[str | None]) -> list[str]:
    """Column names as Spark's reader makes them: a missing name becomes its place, and repeated names get theirs appended."""
    low = [n.lower() for n in names if n]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _read_records(spark: SparkSession, path, sep: str, on_bad: str, null_words, columns: list[str] | None, starts: DataFrame,
                  files: DataFrame, header: str, row_id: bool = False) -> DataFrame:
    """Records put together from lines and parsed one by one; ``header``: the first in order, which gives the columns' order."""
    width = files.agg(F.max(raw_field_count(F.col("header"), sep))).first()[0]
    named = files.select("file", _names(F.col("header"), sep, width).alias("names"))
    first = spark.range(1).select(_names(F.lit(header), sep, width).alias("names")).first()["names"]
    others = named.where(~F.col("names").eqNullSafe(F.array(*[F.lit(n) for n in first])))
    mixed = columns is None and others.limit(1).count() > 0
    cols = columns or _safe(first)
    records = records_of(spark, path, sep, starts).where("value <> ''")
    if mixed:
        other = others.where((F.array_sort("names") != F.array_sort(F.array(*[F.lit(n) for n in first]))) | F.lit(len(set(first)) < len(first))).limit(1).collect()
        if other:
            raise ValueError(f"{path}: the files' headers name different columns: {first} and {other[0]['names']}")
        places = F.array(*[F.array_position("names", F.lit(n)).cast("int") for n in first])
        records = join_small(records, named.select("file", places.alias("places")), "file", str_cols=("file",))
    fields = records.withColumn("_fields", _parsed(F.col("value"), len(cols), sep))
    row = F.struct(F.xxhash64("file", "block").alias("file"), "at").alias(ROW)
    fields = fields.select(*(["places"] if mixed else []), *([row] if row_id else []), "_fields.*")
    kept = _judged(fields, cols, sep, on_bad, path)
    listed = F.array(*[F.col(f"f{i}") for i in range(len(cols))])
    values = [F.element_at(listed, F.col("places")[i]) if mixed else F.col(f"f{i}") for i in range(len(cols))]
    return kept.select(*[_without_null_words(v, null_words).alias(c) for v, c in zip(values, cols)], *([ROW] if row_id else []))


def read_posts_semicolon(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_posts_csv(spark, path, sep=";", **kw)


def read_posts_comma(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_posts_csv(spark, path, sep=",", **kw)


def read_prepared_test(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Prepared test file (``tweet``, ``label``): a line with too many fields is an error."""
    kw.setdefault("on_bad", "fail")
    return read_posts_csv(spark, path, sep=",", **kw)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", single_file: bool = False) -> None:
    """CSV with a header that :func:`read_posts_csv` reads back unchanged (quotes doubled,
    whitespace kept, every value quoted so that line breaks survive)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("encoding", "UTF-8").csv(path))


def csv_to_parquet(spark: SparkSession, src: str, dst: str, sep: str = ",", **kw) -> DataFrame:
    """One-off conversion so that later jobs split the input instead of one task per file."""
    read_posts_csv(spark, src, sep=sep, **kw).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)
