import hashlib

import numpy as np
import pytest

from botsift.llm import suffix_dedup as sd


def brute(rows, length=100):
    """(doc_id, bytes, removed, spans, digest) of each row: every window looked up in order of document."""
    import xxhash

    name = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode()) >> 1)
    seen, out = {}, []
    for who, data, i in sorted((name(r), (r[1] or "").encode(), r[0]) for r in rows):
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            first = seen.setdefault(data[p : p + length], (who, p))
            if first != (who, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in sd.report(sd.remove_repeats(df, **options)).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"hot_contexts": 2}, {"block_bytes": 5000}, {"block_bytes": 5000, "hot_contexts": 2}])
def test_hard_rows(frame, options):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), 4))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(1, 60)))) + (passage[: int(rng.integers(50, 300))] if i % 3 else passage) + word()) for i in range(60)]
    rows += [(100, None), (101, ""), (None, passage), (None, None), (7, passage), (7, passage), (8, "ab" * 300), (9, "a" * 99), (10, "a" * 100), (11, "a" * 250),
             (12, rows[3][1]), (12, rows[3][1]), (13, "x" + rows[4][1] * 40)]
    assert found(frame(rows, "doc_id long, text string"), **options) == brute(rows)


def test_documents(frame, sf_docs):
    rows = sf_docs[:250]
    assert found(frame(rows, "doc_id long, text string"), block_bytes=60_000) == brute(rows)


def test_empty_and_long(empty, hard):
    assert sd.remove_repeats(empty).collect() == []
    rows = sd.remove_repeats(hard).collect()
    assert len(rows) == 14
    assert all(sum(b - a for a, b in r.spans) == r.n_bytes - len(r.kept) for r in rows)


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    begin = np.sort(rng.integers(0, 2900, 700))
    size = rng.integers(0, 100, 700)
    group = np.sort(rng.integers(0, 9, 700))
    order, common = sd.sorted_classes(group, raw, begin, size)
    part = [raw[a : a + n].tobytes() for a, n in zip(begin, size)]
    assert [(group[i], part[i]) for i in order] == sorted((g, p) for g, p in zip(group, part))
    for k in range(1, len(order)):
        x, y = part[order[k - 1]], part[order[k]]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[k] == (n if group[order[k]] == group[order[k - 1]] else -1)


def test_colliding_hashes_are_sorted_by_bytes(monkeypatch):
    monkeypatch.setattr(sd.Suffixes, "part", lambda self, begin, size: size.astype(np.uint64))
    raw = np.frombuffer(b"bananabandana", np.uint8)
    begin = np.arange(13)
    order, common = sd.sorted_classes(np.zeros(13, np.int64), raw, begin, 13 - begin)
    assert [raw[i:].tobytes() for i in order] == sorted(raw[i:].tobytes() for i in range(13))
    assert common[0] == -1 and common.max() == 3


def test_shortened_rows_keep_their_columns(frame):
    text = "0123456789 é" * 40
    df = frame([(1, text, "x", 5), (2, text, None, None), (3, None, "z", 0)], "doc_id long, text string, lang string, n_chars long")
    rows = {r.doc_id: r for r in sd.shortened(df).collect()}
    assert sd.shortened(df).columns == df.columns
    # the text repeats itself after twelve characters
    assert rows[3].text == "" and rows[3].lang == "z" and rows[2].text == "" and rows[1].lang == "x"
    assert rows[1].n_chars == len(rows[1].text) < len(text) and text.startswith(rows[1].text[:50])


def test_groups_with_colliding_hashes_are_sorted_by_bytes(monkeypatch):
    """Strings whose polynomial hashes are equal modulo a power of two, among groups that don't collide: every group is
    sorted, and only those with a collision are sorted again."""
    def swapped(n, a, b):
        return bytes((a, b)[bin(i).count("1") & 1] for i in range(1 << n))

    rng = np.random.default_rng(7)
    strings, group = [], []
    for g in range(12):
        some = [bytes(rng.integers(97, 100, int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(9)]
        if g % 4 == 1:
            some += [swapped(11, 97, 98) + s for s in some[:4]] + [swapped(11, 98, 97) + s for s in some[:4]]
        strings += some
        group += [g] * len(some)
    group = np.array(group)
    size = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(strings), np.uint8)
    order, common = sd.sorted_classes(group, raw, begin, size)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))
    for k, (i, j) in enumerate(zip(order, order[1:]), 1):
        want = -1 if group[i] != group[j] else next((n for n, (p, q) in enumerate(zip(strings[i], strings[j])) if p != q), min(len(strings[i]), len(strings[j])))
        assert common[k] == want
    # an order that the comparisons got wrong is found even where neighbours' lengths are right
    suffixes = sd.Suffixes(np.frombuffer(b"abac", np.uint8), np.array([0, 2]), np.array([2, 2]))
    assert suffixes.verified(np.array([0]), np.array([1]), np.array([1])).tolist() == [True]
    assert suffixes.verified(np.array([1]), np.array([0]), np.array([1])).tolist() == [False]
