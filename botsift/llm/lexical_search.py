"""Ranked lexical search: an inverted index in segments, searched by Block-Max MaxScore.

Index: each task cuts its documents into segments of about ``SEGMENT_BYTES`` of text. A segment holds every term of its
documents: posting lists in blocks of ``BLOCK`` documents, each block packed at the widths that it needs. Beside a block
stand its last document and its impacts, the (tf, length) pairs that no other pair of the block beats, so that its greatest
score is known exactly for any corpus-wide mean length, without unpacking it. The index needs one pass over the texts and
is written once; counts of documents, terms and documents per term come from it.

Search: a block of queries goes to all segments. In a segment the query's lists are ordered by their greatest score; the lists
whose bounds together stay below the query's threshold are non-essential and give no candidates. The others are unpacked and summed.
From the strongest non-essential list to the weakest, a candidate goes when its sum, the bounds of the weaker lists and
the maximum of the block that it falls into stay below the threshold: only blocks with candidates left are unpacked. Each task keeps
one heap of ``k`` documents for a query over all its segments, which sets the threshold; the heaps are merged in two steps.

Terms are dealt out by document, so no term, document or group of copies is a hot key; a task holds one segment, the queries of
one block and their heaps.

Defined results: a null text has no terms; documents with a null id rank behind those of equal score with one; repeated
documents rank each, repeated items give their rows each; an item without terms, or with none that occurs, has no
rows; empty tables give none; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botsift.llm.blocks import numbers, pack, unpack
from botsift.llm.common import buffer_of, id_and_text, release
from botsift.session import materialize, scratch_path

TOP = 20
#: postings of a block
BLOCK = 128
#: text bytes of a segment, and of one step of counting (a longer text is counted in several)
SEGMENT_BYTES = 16 << 20
SLICE_BYTES = 4 << 20
#: text bytes of the items that are searched for in one pass over the index
QUERY_BYTES = 16 << 20
#: parts that an item's heaps are merged in first
SALTS = 16
INDEX = "segment long, n_docs long, n_terms long, docs binary, terms binary, blocks binary, impacts binary, packed binary"
HITS = "item int, doc_id long, score long"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(text: str | None) -> Counter:
    """Terms of one text with their counts."""
    return Counter(WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()))


def counted(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of texts that lie one after another, and their postings: (terms, term, document, tf)."""
    inside = _INSIDE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]  # texts touch, terms don't
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) - starts + 1
    places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    kept = _LOWER[raw[inside]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    code = words.dictionary_encode()
    index = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n = len(offsets) - 1
    key, tf = np.unique(index * max(n, 1) + owner, return_counts=True)
    return code.dictionary, key // max(n, 1), key % max(n, 1), tf.astype(np.int64)


def slices(raw: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes as (first text, bytes, offsets); a longer text in pieces that don't cut a term."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = min(max(int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1, start + 1), n)
        at, end = int(offsets[start]), int(offsets[stop])
        if end - at <= limit or stop - start > 1:
            yield start, raw[at:end], offsets[start : stop + 1] - at
        else:
            while at < end:
                cut = min(at + limit, end)
                while cut < end and _INSIDE[raw[cut]]:
                    step = np.flatnonzero(~_INSIDE[raw[cut : cut + limit]][: end - cut])
                    cut = min(cut + (int(step[0]) if len(step) else limit), end)
                yield start, raw[at:cut], np.array([0, cut - at])
                at = cut
        start = stop


class Segment:
    """A segment under construction."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.docs = self.bytes = 0
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, slice_bytes: int) -> None:
        for first, part, places in slices(raw, offsets, slice_bytes):
            terms, term, doc, tf = counted(part, places)
            self.parts.append((terms, term, doc + self.docs + first, tf))
        self.ids.append(ids)
        self.docs += len(ids)
        self.bytes += int(offsets[-1] - offsets[0])

    def row(self, number: int) -> pa.RecordBatch:
        code = pa.chunked_array([p[0] for p in self.parts], pa.large_binary()).combine_chunks().dictionary_encode()
        index = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum([0, *[len(p[0]) for p in self.parts]])
        term = np.concatenate([index[a:b][p[1]] for a, b, p in zip(at, at[1:], self.parts)])
        doc, tf = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        if len(term) and not fresh.all():  # a text that was counted in pieces
            tf = np.add.reduceat(tf, np.flatnonzero(fresh))
            term, doc = term[fresh], doc[fresh]
        length = np.bincount(doc, tf, self.docs).astype(np.int64)
        ids = pa.concat_arrays(self.ids)
        blocks, impacts, packed = pack_lists(term, doc, tf, length)
        n_of_term = np.bincount(term, minlength=len(code.dictionary)).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([int((length > 0).sum())], pa.int64()), pa.array([int(length.sum())], pa.int64()),
            *[pa.array([b], pa.binary()) for b in (pack(ids=ids, length=length), pack(terms=code.dictionary, n=n_of_term), blocks, impacts, packed)]],
            names=[c.split()[0] for c in INDEX.split(", ")])


def pack_lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Posting lists, sorted by term and document, in blocks: what stands beside each block, impacts, packed postings."""
    n_of_term = np.bincount(term) if len(term) else np.zeros(0, np.int64)
    place = np.arange(len(term)) - (np.cumsum(n_of_term) - n_of_term)[term]
    opens = place % BLOCK == 0
    first, block = np.flatnonzero(opens), np.cumsum(opens) - 1
    sizes = np.diff(np.append(first, len(term)))
    step = doc - np.where(opens, 0, np.concatenate([[0], doc[:-1]]))
    width = [_width(np.maximum.reduceat(v, first)) if len(v) else np.zeros(0, np.int64) for v in (step, tf)]
    ends = np.cumsum(sizes * (width[0] + width[1]))
    packed, begin = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - sizes * (width[0] + width[1])
    inside = np.arange(len(term)) - first[block] if len(term) else np.zeros(0, np.int64)
    for values, w, at in ((step, width[0], begin), (tf, width[1], begin + sizes * width[0])):
        for k in range(8):
            some = np.flatnonzero(w[block] > k)
            if len(some):
                packed[at[block[some]] + inside[some] * w[block[some]] + k] = values[some] >> 8 * k & 255
    # impacts: by rising length, the pairs whose tf exceeds that of all shorter documents of the block
    order = np.lexsort((-tf, length[doc], block))
    height = block * (int(tf.max(initial=0)) + 1) + tf
    height = height[order]
    best = np.ones(len(order), bool)
    best[1:] = height[1:] > np.maximum.accumulate(height)[:-1]
    kept = order[best]
    beside = pack(last=doc[first + sizes - 1].astype(np.int32), doc_width=width[0].astype(np.int8), tf_width=width[1].astype(np.int8),
                  impacts=np.bincount(block[kept], minlength=len(first)).astype(np.int32))
    return beside, pack(tf=tf[kept], length=length[doc[kept]]), packed.tobytes()


def _width(greatest: np.ndarray) -> np.ndarray:
    return np.where(greatest < 1 << 8, 1, np.where(greatest < 1 << 16, 2, np.where(greatest < 1 << 32, 4, 8)))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES,
                slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The index, one row per segment, written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 24, Segment()
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = buffer_of(batch.column(1))
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[start] + segment_bytes - held.bytes, "right")) - 1
                stop = min(max(stop, start + 1), batch.num_rows)
                held.add(batch.column(0).slice(start, stop - start), raw, offsets[start : stop + 1], slice_bytes)
                start = stop
                if held.bytes >= segment_bytes or start < batch.num_rows:
                    yield held.row(number)
                    number, held = number + 1, Segment()
        if held.docs:
            yield held.row(number)
        release()

    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lexical-index")
    id_and_text(docs, id_col, text_col).mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Lists:
    """The posting lists of a segment, unpacked block by block where needed."""

    def __init__(self, row: dict, wanted: pa.Array, docs_in_all: int, terms_in_all: int):
        ids = unpack(row["docs"])
        known = ids.column(0)
        self.no_id = known.is_null().to_numpy(zero_copy_only=False)
        self.ids = known.fill_null(0).to_numpy(zero_copy_only=False)
        self.total, self.terms_in_all = docs_in_all, max(terms_in_all, 1)
        self.m = self.length_part(numbers(ids, "length"))
        terms, beside, impacts = unpack(row["terms"]), unpack(row["blocks"]), unpack(row["impacts"])
        place = pc.index_in(wanted, value_set=terms.column(0)).fill_null(-1).to_numpy(zero_copy_only=False)
        n = numbers(terms, "n").astype(np.int64)
        per_term = -(-n // BLOCK)
        begin = np.cumsum(per_term) - per_term
        #: place of each wanted term among the segment's, -1 where it has none
        self.place, self.begin, self.stop = place, begin, begin + per_term
        self.sizes = np.full(int(per_term.sum()), BLOCK)
        has = per_term > 0
        self.sizes[(begin + per_term - 1)[has]] = (n - (per_term - 1) * BLOCK)[has]
        self.last = numbers(beside, "last").astype(np.int64)
        self.widths = numbers(beside, "doc_width").astype(np.int64), numbers(beside, "tf_width").astype(np.int64)
        ends = np.cumsum(self.sizes * (self.widths[0] + self.widths[1]))
        self.at = ends - self.sizes * (self.widths[0] + self.widths[1])
        self.raw = row["packed"]
        share = self.share(numbers(impacts, "tf"), self.length_part(numbers(impacts, "length")))
        counts = numbers(beside, "impacts").astype(np.int64)
        self.block_best = np.maximum.reduceat(share, np.cumsum(counts) - counts) if len(counts) else share
        self.best = np.maximum.reduceat(self.block_best, begin[has]) if has.any() else self.block_best
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def length_part(self, length: np.ndarray) -> np.ndarray:
        return 75 + 25 * length * self.total // self.terms_in_all

    @staticmethod
    def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What an occurrence count gives a document before the term's weight."""
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of one block, unpacked when it is first asked for."""
        found = self.open.get(b)
        if found is None:
            n, at, (dw, tw) = int(self.sizes[b]), int(self.at[b]), (int(self.widths[0][b]), int(self.widths[1][b]))
            docs = np.cumsum(np.frombuffer(self.raw, f"<u{dw}", n, at).astype(np.int64))
            tf = np.frombuffer(self.raw, f"<u{tw}", n, at + n * dw).astype(np.int64)
            found = self.open[b] = docs, self.share(tf, self.m[docs])
        return found


class Heap:
    """The best documents of one query so far: score descending, documents with an id first, id ascending."""

    __slots__ = ("score", "no_id", "ids", "k")

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """The score that a document has to reach (one of equal score may have the smaller id)."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        score, no_id, ids = np.concatenate([self.score, score]), np.concatenate([self.no_id, no_id]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, no_id, -score))[: self.k]
        self.score, self.no_id, self.ids = score[best], no_id[best], ids[best]


def search_segment(lists: Lists, query: list[tuple[int, int]], heap: Heap) -> None:
    """Block-Max MaxScore of one query, given as (wanted term, weight), over one segment."""
    here = [(w * int(lists.best[lists.place[t]]), w, int(lists.place[t])) for t, w in query if lists.place[t] >= 0]
    here.sort()
    least = heap.least()
    bounds = np.cumsum([b for b, _, _ in here]).tolist()
    essential = next((i for i, b in enumerate(bounds) if b >= least), len(here))
    if essential == len(here):
        return
    scores = np.zeros(len(lists.ids), np.int64)
    for _, weight, t in here[essential:]:
        for b in range(int(lists.begin[t]), int(lists.stop[t])):
            docs, share = lists.block(b)
            scores[docs] += weight * share
    left = np.flatnonzero(scores)
    left = left[scores[left] + (bounds[essential - 1] if essential else 0) >= least]
    for i in range(essential - 1, -1, -1):
        if not len(left):
            return
        _, weight, t = here[i]
        below = bounds[i - 1] if i else 0
        first, stop = int(lists.begin[t]), int(lists.stop[t])
        # the block that holds each candidate, if the list has it at all
        b = first + np.searchsorted(lists.last[first:stop], left)
        most = np.zeros(len(left), np.int64)
        reach = b < stop
        most[reach] = weight * lists.block_best[b[reach]]
        stays = scores[left] + most + below >= least
        left, b = left[stays], b[stays]
        for one in np.unique(b[b < stop]).tolist():
            docs, share = lists.block(one)
            asked = left[b == one]
            at = np.minimum(np.searchsorted(docs, asked), len(docs) - 1)
            same = docs[at] == asked
            scores[asked[same]] += weight * share[at[same]]
        left = left[scores[left] + below >= least]
    if len(left):
        heap.add(scores[left], lists.no_id[left], lists.ids[left])


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _document_counts(index: DataFrame, wanted: list[bytes]) -> list[int]:
    """Documents of each wanted term, over all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, total = pa.array(wanted, pa.large_binary()), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                terms = unpack(payload)
                place = pc.index_in(ask, value_set=terms.column(0)).fill_null(-1).to_numpy(zero_copy_only=False)
                total += np.where(place >= 0, numbers(terms, "n")[place], 0) if terms.num_rows else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "df"])

    found = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = [0] * len(wanted)
    for r in found.collect():  # one row per term of a bounded block of queries
        out[r["term"]] = r["df"]
    return out


def _search(index: DataFrame, queries: list[Counter], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): per task the heap of each query, by its place in ``queries``."""
    wanted = sorted({t for q in queries for t in q})
    weights = [weight_of(n_docs, df) if df else 0 for df in _document_counts(index, wanted)]
    place = {t: i for i, t in enumerate(wanted)}
    asked = [[(place[t], weights[place[t]] * n) for t, n in q.items() if weights[place[t]] > 0] for q in queries]
    shared = index.sparkSession.sparkContext.broadcast((wanted, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lists_of = shared.value
        words = pa.array(words, pa.large_binary())
        heaps = [Heap(k) for _ in lists_of]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Lists({c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}, words, n_docs, n_terms)
                for query, heap in zip(lists_of, heaps):
                    search_segment(segment, query, heap)
        for a in range(0, len(heaps), 4096):
            part = heaps[a : a + 4096]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(a, a + len(part)), [len(h.score) for h in part]).astype(np.int32)),
                pa.array(np.concatenate([h.ids for h in part]), mask=np.concatenate([h.no_id for h in part])),
                pa.array(np.concatenate([h.score for h in part]))], names=["item", "doc_id", "score"])
        release()

    return index.select("docs", "terms", "blocks", "impacts", "packed").mapInArrow(run, HITS)


def _best(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES, id_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``items``. Items are searched for in blocks of about
    ``query_bytes`` of text, each in one pass over the index; the blocks' results are written as they come."""
    spark = index.sparkSession
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // query_bytes))
    # rows of one item may repeat, so they are numbered before they are dealt into blocks
    numbered = materialize(asked.withColumn("at", F.monotonically_increasing_id()), "items") if parts > 1 else asked.withColumn("at", F.lit(0))
    out = None
    for part in range(parts):
        rows = numbered.where(F.pmod(F.xxhash64("at"), F.lit(parts)) == part).select("item_id", "text").collect()  # bounded by query_bytes
        hits = _search(index, [terms_of(r["text"]) for r in rows], n_docs, n_terms, k)
        salt = F.spark_partition_id() % SALTS
        best = _best(_best(hits.withColumn("salt", salt), ["item", "salt"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        found = materialize(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "hits")
        out = found if out is None else out.unionByName(found)
    return out


ORACLE = """
WITH terms AS (
  SELECT doc_id, n, unnest(t) AS term FROM (
    SELECT doc_id, t, len(t) AS n FROM (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents))),
total AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM terms),
tfs AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM terms GROUP BY doc_id, term),
asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
