import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from botsift.llm import context_tree as ct


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def learns(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0


class Plain:
    """The tree by its definition: dictionaries of bit counts, one recursion for weights, one for scores."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for context, node, bit in self.steps(t):
                for d in range(depth + 1):
                    self.n[context[:d], node][bit] += 1
                    if d:
                        self.kids[context[: d - 1], node].add(context[:d])
        self.w = {}

    def steps(self, text):
        data = text.encode() + b"\xff"
        for i, byte in enumerate(data):
            context = tuple(data[i - k] if i - k >= 0 else 255 for k in range(1, self.depth + 1))
            node = 1
            for j in range(7, -1, -1):
                bit = byte >> j & 1
                yield context, node, bit
                node = node * 2 + bit

    def kt(self, c, node):
        a, b = self.n[c, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, c, node):
        if (c, node) not in self.w:
            own = self.kt(c, node)
            if len(c) < self.depth:
                below = sum(self.weighted(k, node) for k in self.kids[c, node])
                own = np.logaddexp(own, below) - math.log(2)
            self.w[c, node] = own
        return self.w[c, node]

    def p(self, context, node, bit):
        found = None
        for d in range(self.depth, -1, -1):
            c = context[:d]
            if (c, node) not in self.n:
                continue
            n = self.n[c, node]
            own = (n[bit] + 0.5) / (sum(n) + 1)
            stay = math.exp(self.kt(c, node) - math.log(2) - self.weighted(c, node)) if d < self.depth else 1.0
            found = own if found is None else stay * own + (1 - stay) * found
        return 0.5 if found is None else found

    def score(self, text):
        return sum(math.log10(self.p(c, n, b)) for c, n, b in self.steps(text))


def by_hand(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))
    c = Counter()
    for i, t in rows:
        if learns(i):
            c.update(words(t) + ["\n"])
    n, v = sum(c.values()), len(c)
    tree = Plain([low(t) for i, t in rows if learns(i)], ct.DEPTH)
    out = []
    for i, t in rows:
        tokens = words(t) + ["\n"]
        out.append((i, not learns(i), len(tokens), sum(c[w] > 0 for w in tokens), n,
                    sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), tree.score(low(t))))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[6])


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=1e-4)


def test_equals_the_definition(frame, sf_docs):
    rows = [(i, t[:400]) for i, t in sf_docs[:60]] + [(None, None), (None, "Null Id"), (100, ""), (101, "é 中 😀"), (3, sf_docs[3][1][:400])]
    same(ct.score_texts(frame(rows, "doc_id long, text string"), block_bytes=3000).collect(), by_hand(rows))


def test_split_pairs_equal_the_definition(frame, sf_docs):
    """Frequent pairs of context bytes are split by a third byte: the same tree, also where all pairs, or all but rare ones, are."""
    rows = [(i, t[:300]) for i, t in sf_docs[:50]] + [(None, None), (100, ""), (101, "é 中 😀"), (102, "aaaa" * 100)]
    want = by_hand(rows)
    for places in (1, 30, 200):
        same(ct.score_texts(frame(rows, "doc_id long, text string"), block_bytes=3000, hot_places=places).collect(), want)


def test_the_largest_shard_falls_with_split_pairs(sf_docs):
    text = pa.array([t for _, t in sf_docs], pa.string())
    raw, offsets = ct.texts_of(pa.RecordBatch.from_arrays([pa.array(range(len(text))), text], names=["a", "b"]))
    codes = np.unique(np.concatenate([c for _, _, c in ct.strings(ct.lower(raw), offsets)]))
    n = np.bincount(ct.lower(raw)[1:].astype(np.int64) << 8 | ct.lower(raw)[:-1], minlength=1 << 16)
    largest = {}
    for shards in (16, 64, 256, 1024):
        largest[shards] = [np.bincount(ct.shard_of(codes, shards, hot)).max() / len(codes) for hot in (np.zeros(1 << 16, bool), n > len(raw) / (2 * shards))]
    assert largest[1024][1] < 0.4 * largest[1024][0] and largest[256][1] < 0.7 * largest[256][0]
    assert largest[1024][1] < largest[256][1] < largest[64][1] < largest[16][1]


def test_hard_rows_and_empty_tables(hard, empty):
    got = ct.score_texts(hard).collect()
    assert len(got) == 14 and all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in got)
    assert [r.n_tokens for r in got if r.n_bytes == 0] == [1, 1, 1]
    assert len({(r.base_score, r.score) for r in got if r.doc_id in (5, 6) and r.n_bytes == 390}) == 1
    assert ct.score_texts(empty).collect() == []


def test_without_training_rows(frame):
    rows = [(i, "ab c") for i in range(200) if not learns(i)][:3]
    for r in ct.score_texts(frame(rows, "doc_id long, text string")).collect():
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0
        assert abs(r.score + 5 * 8 * math.log10(2)) < 1e-5


def test_gamma_and_table():
    x = np.array([0.5, 1, 1.5, 7, 123.5, 1e7])
    np.testing.assert_allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    cost = rng.random(len(codes)).astype(np.float32)
    pick = rng.integers(0, len(codes), 20000)
    assert (ct.Costs(codes, cost).of(codes[pick]) == cost[pick]).all()


def test_held_out_texts_beat_the_words(spark):
    from pyspark.sql import functions as F

    from botsift.llm.queries import op1_context_tree

    r = op1_context_tree(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("n_bytes").alias("n")).first()
    assert -r.s / math.log10(2) / r.n < 3.0
