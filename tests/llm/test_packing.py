import random
import zlib

import numpy as np
import pytest

from botsift.llm import packing
from botsift.llm.queries import vocabulary


@pytest.fixture(scope="module")
def path():
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece(length, doc=0):
    return packing.Piece(doc, 0, np.arange(length, dtype=np.uint32), length)


def naive(lengths, window):
    """Best-fit decreasing by looking at every window."""
    filled = []
    for n in sorted(lengths, reverse=True):
        fits = [(window - f, i) for i, f in enumerate(filled) if window - f >= n]
        if fits:
            filled[min(fits)[1]] += n
        else:
            filled.append(n)
    return sorted(filled)


@pytest.mark.parametrize("window", [1, 7, 64, 100, 1024])
def test_best_fit_equals_looking_at_every_window(window):
    rng = random.Random(window)
    for _ in range(30):
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 80))]
        got = packing.best_fit([piece(n, i) for i, n in enumerate(lengths)], window)
        assert sorted(w.filled for w in got) == naive(lengths, window)
        assert sorted(len(p.ids) for w in got for p in w.pieces) == sorted(lengths)


def test_bad_lengths_are_filled_up():
    for lengths in ([600] * 50, [513] * 7 + [100] * 3, [1000] * 9, [1], [700, 700]):
        windows = packing.fill_up(packing.best_fit([piece(n, i) for i, n in enumerate(lengths)], 1024), 1024, 32)
        assert sum(w.filled for w in windows) == sum(lengths) and all(0 < w.filled <= 1024 for w in windows)
        assert sum(1024 - w.filled >= 32 for w in windows) <= 1
        spans = {}
        for w in windows:
            for p in w.pieces:
                spans.setdefault(p.doc, []).append((p.start, p.start + len(p.ids)))
                assert p.ids.tolist() == list(range(p.start, p.start + len(p.ids)))
        for i, n in enumerate(lengths):
            edges = sorted(spans[i])
            assert edges[0][0] == 0 and edges[-1][1] == n and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def test_ids_equal_the_library(path, library):
    rng = random.Random(5)
    pool = [chr(c) for c in (*range(0x180), 0x301, 0x200D, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0xE000, 0x10FFFF)] + ["<|endoftext|>", "'s", "  ", "\r\n", " re"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 50_000, " " * 50_000, "é!" * 9_000]
    found = packing.encoder(path).encode(texts)
    assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, docs, library, window):
    """Pieces tile every document, sequences have no gap and no overlap, checksums are those of the library's ids."""
    want = []
    for i, t in docs:
        want.append((i, library.encode(t or "", add_special_tokens=False).ids + [0]))
    sequences, by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) <= window and all(n > 0 for _, n in parts)
    ids_of = {}
    for i, ids in want:
        ids_of.setdefault(i, []).append(ids)
    assert set(by_doc) == set(ids_of)
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids_of[i]))
        for p in pieces:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                       for ids in ids_of[i])
    return sequences


@pytest.mark.parametrize("options", [{}, {"window": 16, "least_gap": 2, "chunk_tails": 4}, {"window": 1, "least_gap": 1}])
def test_hard_rows(hard, hard_rows, path, library, options):
    check(packing.pack(hard, path, **options).collect(), hard_rows, library, options.get("window", 1024))


def test_whole_table_little_padding_and_sequences(frame, sf_docs, path, library):
    df = frame(sf_docs, "doc_id long, text string")
    rows = packing.pack(df, path).collect()
    sequences = check(rows, sf_docs, library, 1024)
    total = sum(r.length for r in rows)
    assert len(sequences) * 1024 < 1.005 * total + 3 * 1024
    seqs = packing.sequences(df, path).collect()
    assert sum(len(s.ids) for s in seqs) == total and all(sum(s.lengths) == len(s.ids) <= 1024 and len(s.doc_ids) == len(s.lengths) for s in seqs)
    text_of, at = dict(sf_docs), {}
    for s in seqs:
        place = 0
        for doc, n in zip(s.doc_ids, s.lengths):
            at.setdefault(doc, []).append(s.ids[place : place + n])
            place += n
    for doc in list(at)[:50]:
        if len(at[doc]) == 1:
            assert library.decode(at[doc][0][:-1]) == text_of[doc]


def test_a_third_of_copies_of_a_bad_length(frame, path):
    rows = [(i, "word " * 600) for i in range(90)] + [(100 + i, "other " * 900) for i in range(90)]
    got = packing.pack(frame(rows, "doc_id long, text string"), path).collect()
    total, n = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert n <= -(-total // 1024) + 3 + total * 32 // 1024 // 1024 + 1


def test_empty(empty, path):
    assert packing.pack(empty, path).collect() == [] and packing.sequences(empty, path).collect() == []
