"""Records of delimited files whose quoted fields may hold line breaks, read by as many tasks as the files have blocks.

Whether a line starts a record can't be seen from the line: it depends on the quotes of all lines before it. But a line has only two
possible starts, outside or inside a quoted field, so what it does is one of four maps from its start to its end, and maps can be
composed in any grouping. That gives a parallel scan:

1. every block of a file (the splits that Spark makes) composes the maps of its lines: its end for either start;
2. a running composition over the blocks of each file, one row a block, gives every block's true start, and the block in
   which the record that reaches into it begins;
3. every block is read again from its true start, and its lines are put together to whole records. A record that crosses the end
   of a block is put together from one piece per block; no other rows are shuffled.

A quote opens a field only at its start; elsewhere in an unquoted field it is a character. That makes the maps of lines
with stray quotes exact too (counting the parity of quotes would turn the rest of the file inside out).

Lines end at ``\\n``; in a file whose first line ends in ``\\r\\n`` they end there, and line breaks inside its fields are read as
``\\n``. If the files are split differently in a later run of the same plan (other settings), it fails and has to be built anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from botsift.operators.joins import MAX_BROADCAST_ROWS
from botsift.session import materialize

BLOCKS = "file string, block long, end0 boolean, end1 boolean, starts1 boolean, second boolean, opens boolean, header string"
#: blocks that a step gives back at a time
STEP = 4096


def ends_inside(line: Column, sep: str) -> Column:
    """Whether a line that starts outside quotes ends inside a quoted field. Doubled quotes are removed first: that changes no
    quote's side. (A line that starts inside ends like the same line behind one more quote.)"""
    esc = re.escape(sep)
    single = F.regexp_replace(line, '""', "")
    unquoted = F.regexp_replace(single, f'(?:^|(?<={esc}))"[^"]*"', "")
    return F.when(F.instr(line, '"') == 0, F.lit(False)).otherwise(unquoted.rlike(f'(?:^|{esc})"'))


def lines_of(spark: SparkSession, path, sep: str) -> DataFrame:
    """(file, block, value, end0, end1): every line with its map: where it ends when it starts outside, and inside."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    inside = F.when(F.instr("value", '"') == 0, F.lit(True)).otherwise(ends_inside(F.concat(F.lit('"'), "value"), sep))
    return lines.select("file", "block", "value", ends_inside(F.col("value"), sep).alias("end0"), inside.alias("end1"))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, end0, end1, first) to one row per block: its end for either start, whether a record starts in it
    when it starts inside, and behind its first line when it starts outside; whether any of its lines alone ends inside; its first
    line if it opens the file."""
    out, now = [], None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for file, block, end0, end1, first in zip(*cols):
            if now is None or now[1] != block or now[0] != file:
                if now is not None:
                    out.append(tuple(now))
                now = [file, block, False, True, False, False, False, first]
            elif not now[2]:
                now[5] = True
            if not now[3]:
                now[4] = True
            now[6] = now[6] or end0
            now[2] = end1 if now[2] else end0
            now[3] = end1 if now[3] else end0
        if len(out) >= STEP:
            yield _blocks(out)
            out = []
    if now is not None:
        out.append(tuple(now))
    if out:
        yield _blocks(out)


def _blocks(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), *[pa.bool_()] * 5, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def survey(spark: SparkSession, path, sep: str) -> DataFrame:
    """(file, block, inside, owner, crosses, opens, header, crlf): each block's true start, the block in which the record that
    reaches into it begins (null: it is the file's first), and whether a record crosses its start or its end. ``header``: the file's
    first line, in its first block; ``opens``: some line of the block would end inside a field if it started a record."""
    lines = lines_of(spark, path, sep)
    rows = lines.select("file", "block", "end0", "end1", F.when(F.col("block") == 0, F.col("value")))
    blocks = materialize(rows.mapInArrow(_compose, BLOCKS), "csv-blocks")
    file = Window.partitionBy("file")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # constant maps settle the start of what follows, swaps turn it over, the others leave it
    swaps = F.coalesce(F.sum(F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0)).over(before), F.lit(0))
    counted = blocks.withColumn("swaps", swaps)
    settled = F.when(F.col("end0") == F.col("end1"), F.struct("end0", "swaps"))
    last = counted.withColumn("last", F.last(settled, ignorenulls=True).over(before))
    turned = F.col("swaps") - F.coalesce("last.swaps", F.lit(0))
    known = last.withColumn("inside", (F.coalesce("last.end0", F.lit(False)).cast("int") + turned) % 2 == 1)
    # the first block counts as a start of records only if it has one behind the header
    starts = F.when(F.when(F.col("block") == 0, F.col("second")).otherwise(~F.col("inside") | F.col("starts1")), F.col("block"))
    crosses = F.col("inside") | F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0"))
    return materialize(known.select(
        "file", "block", "inside", F.last(starts, ignorenulls=True).over(before).alias("owner"), crosses.alias("crosses"), "opens",
        F.regexp_replace("header", "\r$", "").alias("header"), F.coalesce(F.max(F.col("header").endswith("\r")).over(file), F.lit(False)).alias("crlf")), "csv-starts")


def _whole_records(only_pieces: bool):
    """Lines (file, block, value, end0, end1, inside, owner) to whole records (file, value, block, at), numbered in their block, the
    first of each file left out; or to the pieces of records that cross the end of a block (file, value, owner, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pending, at = [], [], 0
        file = block = owner = None
        inside = reached = header = False  # in a field; in a record of an earlier block; in the file's first record

        def close(crosses: bool) -> None:
            """The pending lines are a record, or its piece in this block."""
            nonlocal header, at
            if pending:
                if crosses == only_pieces and not header and owner is not None:
                    found.append((file, "\n".join(pending), *((owner, block) if only_pieces else (block, at))))
                    at += 1
                header = False
                pending.clear()

        for batch in batches:
            for new_file, new_block, value, end0, end1, start, owned in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if new_block != block or new_file != file:
                    close(inside or reached)
                    file, block, owner, inside, reached, header, at = new_file, new_block, owned, start, start, new_block == 0, 0
                if not inside:
                    close(reached)
                    owner, reached = block, False
                pending.append(value)
                inside = end1 if inside else end0
            if found:
                yield _found(found, only_pieces)
        close(inside or reached)
        if found:
            yield _found(found, only_pieces)

    return run


def _found(found: list[tuple], only_pieces: bool) -> pa.RecordBatch:
    names = ["file", "value", *(["owner", "block"] if only_pieces else ["block", "at"])]
    columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64(), pa.int64()))]
    found.clear()
    return pa.RecordBatch.from_arrays(columns, names=names)


def records_of(spark: SparkSession, path, sep: str, starts: DataFrame) -> DataFrame:
    """(file, value, block, at): every record behind the first of each file, as text; line breaks inside it are ``\\n``. Block and
    number tell the records of a file apart (a record that crosses the end of a block has the number -1 in the block where it begins).
    ``starts``: see :func:`survey`. Records that cross the end of a block cost one more reading of their files."""
    shared = starts.select("file", "block", "inside", "owner", "crlf")
    few = starts.count() <= MAX_BROADCAST_ROWS
    lines = lines_of(spark, path, sep)

    def with_starts(some: DataFrame) -> DataFrame:
        changed = F.raise_error(F.lit("the files are split differently than when they were surveyed: read them anew")).cast("boolean")
        value = F.when(F.col("crlf"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
        columns = ["file", "block", value.alias("value"), "end0", "end1", F.coalesce("inside", changed).alias("inside"), "owner"]
        if few:  # the order of the lines stays
            return some.join(F.broadcast(shared), ["file", "block"], "left").select(columns)
        placed = some.withColumn("_at", F.monotonically_increasing_id()).join(shared, ["file", "block"], "left")
        return placed.repartition("file", "block").sortWithinPartitions("file", "block", "_at").select(columns)

    whole = with_starts(lines).mapInArrow(_whole_records(False), "file string, value string, block long, at long")
    crossing = starts.where("crosses").select("file").distinct()
    if not crossing.limit(1).count():
        return whole
    some = lines.join(F.broadcast(crossing) if few else crossing, "file", "left_semi")
    pieces = with_starts(some).mapInArrow(_whole_records(True), "file string, value string, owner long, block long")
    listed = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = pieces.groupBy("file", "owner").agg(F.array_join(listed["value"], "\n").alias("value"))
    return whole.unionByName(joined.select("file", "value", F.col("owner").alias("block"), F.lit(-1).cast("long").alias("at")))
