"""WARC archives and the merge of their capture indexes.

Writing: payloads are grouped by SHA-1 and length (combined before the shuffle); the record of the smallest
id carries the payload, the others of at least ``min_bytes`` become revisit records that refer to it. Spark's
text writer writes the records: a record ends with two line ends, which is the writer's line separator, so each
file is a plain WARC file. Files hold about ``ARCHIVE_BYTES``: records of very different sizes go to different files, so that a
number of records bounds a file's bytes, and a few huge pages among many small ones don't gather in one.

Reading: every archive is parsed by the lengths in its headers, payload digests are computed again and held against the
headers, and its captures, sorted by URL key, time and id, make one run of the index, which is written. Merging: the runs are
cut at sampled keys; a task gets its range's slice of every run, in the order of the run, and merges the slices with a
loser tree. Nothing is sorted again: where a slice's order breaks off (a run that was read in two pieces), a further slice begins.
Ranges follow each other, so the index is ordered as a whole; a range is bounded in rows, since key, time, id and place cut a hot URL as well.

Defined results: a null html is an empty payload; a null url has no target header and an empty key; rows without id refer to
the smallest id of their payload, and are responses if there is none; repeated rows are records each (rows with the smallest id of a
payload are all responses); empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.llm.common import steps
from botsift.session import materialize, scratch_path

ARCHIVE_BYTES = 16 << 20
#: sizes of the records of one file differ by this factor at most (beyond four times the mean)
SIZE_STEP = 16
#: bytes of a record besides its payload, about
HEAD_BYTES = 600
RANGE_ROWS = 50_000
#: digests of repeated payloads that are broadcast; more are joined by shuffle, with hot ones split
BROADCAST_ROWS = 200_000
SALTS = 16
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
END = "\r\n"
INDEX = ("url_key string, timestamp string, page_id long, archive string, offset long, length long, record_type string, "
         "refers_to long, payload_bytes long, payload_digest string")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def moment(page_id: int | None) -> datetime:
    """Capture time: pages have none, so their number counts seconds."""
    return EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)


def url_key(url: str) -> str:
    """Sort key of an url: host labels in reverse, then the path, all in lower case."""
    found = re.match(r"(?is)^.*?://([^/?#]*)(.*)$", url)
    if not found:
        return url.lower()
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (found[2].partition("#")[0] or "/").lower()


def _safe(url: str) -> str:
    """An url as a header value: white space and control characters written with percent signs."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: str, refers_to: int | None, revisit: bool) -> str:
    """One WARC record without its two closing line ends."""
    body = payload.encode()
    sha = hashlib.sha1(body).digest()
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(body)}{END}{END}"
    block_bytes = len(http) + (0 if revisit else len(body))
    name = hashlib.md5(f"{page_id}\n{url}\n".encode() + sha).hexdigest()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>",
            f"WARC-Date: {moment(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{base32(sha)}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {block_bytes}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        head.append(f"WARC-Page: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    return END.join(head) + END + END + http + ("" if revisit else payload)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write a record for each page into archives under ``path``; returns the path."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html"))
    sums = keyed.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    sums = materialize(sums, "payloads")
    total = sums.agg(F.coalesce(F.sum(F.col("n") * (F.col("size") + HEAD_BYTES)), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)),
                     F.sum(F.when((F.col("n") > 1) & (F.col("size") >= min_bytes), 1).otherwise(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    again = sums.where((F.col("n") > 1) & (F.col("size") >= min_bytes) & F.col("first").isNotNull()).select("sha", "size", "first")
    if (total[2] or 0) <= BROADCAST_ROWS:
        typed = keyed.join(F.broadcast(again), ["sha", "size"], "left")
    else:
        again = again.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        typed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(again, ["sha", "size", "salt"], "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    typed = typed.select("size", "page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                cols = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")]
                yield pa.RecordBatch.from_arrays([pa.array([record(*r) for r in zip(*cols)], pa.string())], names=["value"])

    mean, least, most = total[0] / (total[1] or 1), -1, 4 * int(total[0] / (total[1] or 1))
    step = 0
    while True:  # one write for each step of sizes, a few at most: the first holds nearly all records
        each = max(1, int(4 * ARCHIVE_BYTES / (most + HEAD_BYTES)) if step else int(ARCHIVE_BYTES / mean))
        some = typed.where((F.col("size") > least) & (F.col("size") <= most)).drop("size")
        if not step or sums.where((F.col("size") > least) & (F.col("size") <= most)).limit(1).count():
            some.mapInArrow(run, "value string").write.option("lineSep", END * 2).option("maxRecordsPerFile", each).text(f"{path}/size-{step}")
        if most >= total[3]:
            return path
        least, most, step = most, most * SIZE_STEP, step + 1


def captures(archive: str, data: bytes) -> Iterator[tuple]:
    """Index rows of one archive, in the order of its records."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at} of {archive}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = stop + 4, int(head["content-length"])
        block = data[start : start + size]
        http, _, body = block.partition(b"\r\n\r\n")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            length = len(body)
            if base32(hashlib.sha1(body).digest()) != digest:
                raise ValueError(f"payload of the record at byte {at} of {archive} differs from its digest")
        else:
            length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        page, refers = head.get("warc-page"), head.get("warc-refers-to-page")
        end = start + size + 4
        yield (url_key(head.get("warc-target-uri", "")), re.sub(r"\D", "", head["warc-date"]), int(page) if page else None, archive, at, end - at, kind,
               int(refers) if refers else None, length, digest)
        at = end


def order_of(row: tuple) -> tuple:
    """Sort key of an index row: URL key, time, id (null first), place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives under ``path``, each archive's rows sorted: the runs of the merge. An archive's name is
    its folder and file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = sorted(captures("/".join(archive.split("/")[-2:]), data.as_py()), key=order_of)
                for i in range(0, len(rows), 10_000):
                    yield _batch(rows[i : i + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/size-*").select("path", "content")
    return files.mapInArrow(run, INDEX)


class LoserTree:
    """Merge of k sorted lists: the inner nodes keep the losers, the winner leaves at the root."""

    def __init__(self, lists: list[list], key):
        self.lists, self.key, self.k = lists, key, len(lists)
        self.at = [0] * self.k
        self.heads = [key(x[0]) if x else None for x in lists]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether list a's head goes before list b's; an empty list loses."""
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to come waits for the other side
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k:
            w = self.tree[0]
            if self.heads[w] is None:
                return
            rows = self.lists[w]
            yield rows[self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(rows[self.at[w]]) if self.at[w] < len(rows) else None
            self._play(w)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index of all runs in order: (range_no, place) and the index columns."""
    runs = materialize(runs, "capture-runs")
    ranges = max(1, -(-runs.count() // range_rows), runs.sparkSession.sparkContext.defaultParallelism)
    keys = ["url_key", "timestamp", "page_id", "archive", "offset"]
    cut = runs.repartitionByRange(ranges, *keys).withColumn("range_no", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, last, number = [], {}, 0  # last: the newest slice of each run
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                number, row = row[-1], row[:-1]
                mine = last.get(row[3])
                if mine is None or order_of(mine[-1]) > order_of(row):
                    mine = last[row[3]] = []
                    slices.append(mine)
                mine.append(row)
        held, place = [], 0
        for row in LoserTree(slices, order_of):
            held.append(row)
            if len(held) == 10_000:
                yield _numbered(held, number, place)
                place += len(held)
                held = []
        if held:
            yield _numbered(held, number, place)

    return cut.mapInArrow(run, f"{INDEX}, range_no int, place long")


def _numbered(rows: list[tuple], number: int, place: int) -> pa.RecordBatch:
    batch = _batch(rows)
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([number] * len(rows), pa.int32()), pa.array(range(place, place + len(rows)), pa.int64())],
        names=[*batch.schema.names, "range_no", "place"])


def archive_and_index(pages: DataFrame, min_bytes: int = 0, path: str | None = None, **columns) -> DataFrame:
    """Write the archives of all pages, read them back, merge their indexes."""
    spark = pages.sparkSession
    path = write_archives(pages, path or scratch_path(spark, "warc"), min_bytes, **columns)
    return merge_runs(read_runs(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, array_to_string([lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0') FOR c IN string_split(x, '')], '') AS bits FROM s),
m AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS BIGINT), 1) FOR i IN generate_series(0, 31)], '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM m"""
