import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from botsift.llm import lexical_search

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, items, k=20):
    """Every document scored for every item, as defined."""
    counts = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            n, score = sum(c.values()), 0
            for t, q in terms(text).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += q * w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run(docs, items, k=20, query_bytes=1 << 20, **options):
    index = lexical_search.build_index(docs, **options)
    return sorted((tuple(r) for r in lexical_search.search(index, items, k, query_bytes).collect()), key=repr)


def made_up(seed, n, vocabulary):
    """Texts of few words by falling frequency, in very different lengths."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    chance = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices(words, chance, k=rng.choice([0, 1, 3, 10, 40, 200])))) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("seed,n,vocabulary,segment,k", [(1, 300, 50, 2_000, 20), (2, 600, 400, 1 << 20, 5), (3, 900, 20, 10_000, 20), (4, 50, 10, 100, 1)])
def test_against_every_document(frame, seed, n, vocabulary, segment, k):
    docs = made_up(seed, n, vocabulary)
    items = [(i, t) for i, (_, t) in enumerate(made_up(seed + 100, 12, vocabulary))] + [(90, "absent words only"), (91, "w0 w0 w0 w1 W2"), (92, None)]
    got = run(frame(docs, "doc_id long, text string", 2), frame(items, "item_id long, text string"), k, segment_bytes=segment)
    assert got == brute(docs, items, k)


def test_hard_rows(frame, hard, hard_rows):
    items = [(1, "one two three lorem"), (1, "one two three lorem"), (None, "row REPEATED é"), (3, None), (4, ""), (5, "lorem ipsum " * 3000), (6, "中文 😀 case"), (7, "null id")]
    table = frame(items, "item_id long, text string")
    want = brute(hard_rows, items)
    for options in ({}, {"segment_bytes": 1, "slice_bytes": 100}, {"segment_bytes": 50_000, "slice_bytes": 7, "query_bytes": 1000}):
        assert run(hard, table, **options) == want


def test_empty(frame, empty, hard):
    none = frame([], "item_id long, text string")
    assert run(empty, none) == run(hard, none) == run(empty, frame([(1, "some text")], "item_id long, text string")) == []


def test_lists_unpack_to_what_was_packed():
    rng = np.random.default_rng(2)
    raw = [(t, d, n) for t in range(40) for d in sorted(rng.choice(100_000, int(rng.integers(1, 900)), replace=False)) for n in [int(rng.integers(1, 400)) ** int(rng.integers(1, 3))]]
    term, doc, tf = (np.array(c, np.int64) for c in zip(*raw))
    length = np.bincount(doc, tf, 100_000).astype(np.int64)
    beside, impacts, packed = lexical_search.pack_lists(term, doc, tf, length)
    import pyarrow as pa
    names = [f"t{i}".encode() for i in range(40)]
    row = {"docs": lexical_search.pack(ids=pa.array(np.arange(100_000)), length=length), "blocks": beside, "impacts": impacts, "packed": packed,
           "terms": lexical_search.pack(terms=pa.array(names, pa.large_binary()), n=np.bincount(term).astype(np.int32))}
    lists = lexical_search.Lists(row, pa.array(names, pa.large_binary()), 100_000, int(tf.sum()))
    for t in range(40):
        found = [lists.block(b) for b in range(lists.begin[t], lists.stop[t])]
        mine = term == t
        assert np.concatenate([d for d, _ in found]).tolist() == doc[mine].tolist()
        share = lists.share(tf[mine], lists.m[doc[mine]])
        assert np.concatenate([s for _, s in found]).tolist() == share.tolist()
        assert [int(s.max()) for _, s in found] == lists.block_best[lists.begin[t] : lists.stop[t]].tolist() and share.max() == lists.best[t]


def test_blocks_are_left_packed():
    """With a full heap, most blocks of a frequent term are never unpacked."""
    import pyarrow as pa
    docs = [f"common x{i % 7}" + (" rare" if i % 500 == 0 else "") for i in range(20_000)]
    segment = lexical_search.Segment()
    text = pa.array(docs, pa.string())
    raw, offsets = lexical_search.buffer_of(text)
    segment.add(pa.array(range(20_000)), raw, offsets, 1 << 16)
    row = {c: v[0] for c, v in segment.row(0).to_pydict().items()}
    lists = lexical_search.Lists(row, pa.array([b"common", b"rare"], pa.large_binary()), 20_000, 60_000)
    heap = lexical_search.Heap(20)
    query = [(0, 5), (1, 5000)]
    lexical_search.search_segment(lists, query, heap)
    first = len(lists.open)
    lists.open.clear()
    lexical_search.search_segment(lists, query, heap)
    assert first > 150 and len(lists.open) <= 60


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(lexical_search.ORACLE).fetchall())
    got = run(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/benchmark.parquet"), segment_bytes=200_000)
    assert sorted(got) == want and len(want) > 500
