"""Row identity from the scan.

Operators that take a post apart (terms, tokens) bring its pieces together again by row, not by key: keys may repeat, and a
key in a third of all rows would be one huge group. The number of a row must be the same in every job, branch of a plan and
attempt of a task, also when a task behind a shuffle is run again. A file source knows such a number: the file and the row's place
in it (``_metadata``), so nothing has to be written. It is taken right at the scan as the column ``ROW`` and carried along;
:func:`botsift.operators.rank.with_row_id` writes the rows where no source gives one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (file, at): hash of the file's path and place in it
ROW = "_row"


def with_scan_rows(scan: DataFrame, name: str = ROW) -> DataFrame:
    """``scan``, a table just read from Parquet files, with the identity of each row."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return scan.select("*", place.alias(name))


def joined_row(left: Column, right: Column) -> Column:
    """Identity of a row that a join makes of two rows: two hashes of 64 bits over both, in either order."""
    parts = [row[c] for row in (left, right) for c in ("file", "at")]
    return F.struct(F.xxhash64(*parts).alias("file"), F.xxhash64(*reversed(parts)).alias("at"))
