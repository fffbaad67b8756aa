"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts earlier are removed.

Places that may repeat: in each window of LENGTH bytes the least hash of its strings of ``SEED`` bytes is the
window's anchor. The choice depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets, and each anchor stands for a run of window starts, whose bytes are its context. Anchors whose hash occurs
once in the corpus are settled by the first exchange; the contexts of the others are brought together by anchor.

Suffix sort: the contexts of an anchor are sorted by what follows the anchor, and by what stands before it, with a
merge sort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial
hashes. Neighbours in the sorted order are then compared byte by byte; a shard whose hashes collided is sorted again by bytes. Two
windows at the same offset are equal if their contexts agree that far to both sides, which the common extensions of
neighbours tell for all offsets; of equal windows the one that starts earliest stays, the others are removed.

Texts travel in blocks (see blocks.py). Inside a block equal contexts are sent once, as their earliest place, so a
passage in a third of all texts costs a block one context. An anchor with more than ``HOT_CONTEXTS`` different contexts is dealt out by window instead.

Order: documents by id (null last), then by a hash of the text; rows of equal id and text are one document. Defined results: null
and short texts lose nothing; repeated rows give a row each; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.llm.blocks import by_block, by_shard, joined, numbers, pack, rows, runs_of, shard_count, texts_of, unpack, write_blocks

LENGTH = 100
SEED = 24
SHARD_BYTES = 6 << 20
HOT_CONTEXTS = 50_000
#: window starts that are looked at in one step
PIECE = 1 << 17
BASE = 0x9E3779B97F4A7C15
COLUMNS = "kind string, block long, shard int, payload binary"
LAST = np.iinfo(np.int64).max


# --- prefix hashes --------------------------------------------------------------------------

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = max(1 << 18, 1 << int(n).bit_length())
    if size not in _POWERS:
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """h[i]: polynomial hash of the first i bytes, modulo 2**64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def spread(h: np.ndarray) -> np.ndarray:
    """The bits of a hash mixed, so that the order of hashes says nothing of the text."""
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


# --- anchors --------------------------------------------------------------------------------

def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first start, last start, hash) of every anchor of a block's texts, in order of place."""
    width = length - seed + 1
    last = np.maximum(offsets[1:] - length, offsets[:-1] - 1)  # last window start of each text
    out = []
    for a in range(0, max(len(raw) - length + 1, 0), PIECE):
        b = min(a + PIECE, len(raw) - length + 1)
        line = raw[a : b + length - 1]
        h = prefix_hashes(line)
        grams = len(line) - seed + 1
        h = spread((h[seed:] - h[:grams]) * powers(len(line))[1][:grams])
        # the least hash of each window and, of equal ones, the first: the place goes into the low bits
        low = np.uint64((1 << 18) - 1)
        ranked = h & ~low | np.arange(grams, dtype=np.uint64)
        fill = -grams % width
        table = np.concatenate([ranked, np.full(fill, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(table, 1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[: b - a], ahead[width - 1 : width - 1 + b - a]) & low).astype(np.int64)
        starts = np.arange(a, b)
        text = np.searchsorted(offsets, starts[:1], side="right")[0] - 1
        # windows that lie in one text
        fits = np.zeros(b - a + 1, np.int64)
        t = text
        lo = np.clip(offsets[t:-1], a, b) - a
        hi = np.clip(last[t:] + 1, a, b) - a
        stop = int(np.searchsorted(offsets[t:-1], b))
        lo, hi = lo[:stop], hi[:stop]
        real = hi > lo
        np.add.at(fits, lo[real], 1)
        np.add.at(fits, hi[real], -1)
        fits = np.cumsum(fits)[:-1] > 0
        where = np.flatnonzero(fits)
        if not len(where):
            continue
        p = place[where]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (where[1:] != where[:-1] + 1)])
        first = np.flatnonzero(new)
        final = np.concatenate([first[1:], [len(where)]]) - 1
        out.append((p[first] + a, where[first] + a, where[final] + a, h[p[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    place, lo, hi, h = (np.concatenate(x) for x in zip(*out))
    # an anchor whose windows were cut by a piece's end is one anchor
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (lo[1:] != hi[:-1] + 1)])
    first = np.flatnonzero(new)
    return place[first], lo[first], hi[np.concatenate([first[1:], [len(lo)]]) - 1], h[first]


def keys_of(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 32 more bits of an anchor hash."""
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def in_order(block: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The block's rows in order of document, with the two numbers that give the order."""
    import xxhash

    ids = block.column(0)
    doc = ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.array([xxhash.xxh64_intdigest(t) >> 1 for t in block.column(1).cast(pa.binary()).to_pylist()], np.int64)
    order = np.lexsort((text, ids.is_null().to_numpy(zero_copy_only=False), doc))
    return block.take(pa.array(order)), doc[order], text[order]


def asked(shards: int, length: int, seed: int):
    """What a block asks: which of its anchor hashes occur elsewhere too (more than once here: told)."""

    def ask(number: int, block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = texts_of(block)
        h = anchors(raw, offsets, length, seed)[3]
        shard, key = keys_of(h, shards)
        both, n = np.unique(shard.astype(np.uint64) << np.uint64(32) | key, return_counts=True)
        shard, key = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edges = np.searchsorted(shard, np.arange(shards + 1))
        for s in range(shards):
            a, b = edges[s], edges[s + 1]
            if b > a:
                yield rows("anchors", [number], [s], [pack(key=key[a:b], n=np.minimum(n[a:b], 1 << 30).astype(np.uint32))])

    return ask


def repeated(hot: int):
    """Per shard: the anchor hashes of each block that occur more than once in all; whether very often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in runs_of(batches, "shard"):
            held = [(r["block"], unpack(r["payload"])) for r in part]
            key, where = np.unique(np.concatenate([numbers(b, "key") for _, b in held]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([numbers(b, "n") for _, b in held]))
            at = 0
            for block, b in held:
                here = n[where[at : at + b.num_rows]]
                at += b.num_rows
                many = here > 1
                if many.any():
                    yield rows("again", [block], [shard], [pack(key=numbers(b, "key")[many], hot=here[many] > hot)])

    return run


# --- contexts of a block --------------------------------------------------------------------

def contexts(shards: int, length: int, seed: int):
    """Per block: answers first, then the texts. Sends each different context of a repeated anchor once, as its
    earliest place; its other places are wholly repeated and sent as spans. Of hot anchors, the same by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in runs_of(batches, "block"):
            many, hot, block = [], [], []
            for row in part:
                b = unpack(row["payload"])
                if row["kind"] == "again":
                    key = np.uint64(row["shard"]) << np.uint64(32) | numbers(b, "key").astype(np.uint64)
                    many.append(key)
                    hot.append(key[numbers(b, "hot")])
                elif many:
                    block.append(b)
            if not many:
                continue
            block, doc, text = in_order(joined(block))
            raw, offsets = texts_of(block)
            place, lo, hi, h = anchors(raw, offsets, length, seed)
            shard, key = keys_of(h, shards)
            full = shard.astype(np.uint64) << np.uint64(32) | key
            pick = np.flatnonzero(np.isin(full, np.concatenate(many)))
            is_hot = np.isin(full, np.concatenate(hot))
            owner = np.searchsorted(offsets, lo, side="right") - 1
            data = raw.tobytes()
            seen: dict[tuple[bytes, int], tuple[int, int]] = {}
            sent, spans = [], []
            for i in pick.tolist():
                a, b, t, p = int(lo[i]), int(hi[i]), int(owner[i]), int(place[i])
                at = a - int(offsets[t])
                ranges = ((a, b),) if not is_hot[i] else ((s, s) for s in range(a, b + 1))
                for x, y in ranges:
                    one = data[x : y + length]
                    before = seen.setdefault((one, p - x), (t, at + x - a))
                    twin = before[1] == at + x - a and (doc[before[0]], text[before[0]]) == (doc[t], text[t])
                    if twin:  # the first place itself, or the same place of a repeated row
                        # windows of hot anchors are dealt by their own bytes
                        to = int(shard[i]) if not is_hot[i] else hash_of(one) % shards
                        sent.append((to, int(key[i]), one, p - x, t, at + x - a))
                    else:
                        spans.append((t, at + x - a, at + y - a + length))
            if spans:
                yield rows("spans", [number], [-1], [pack_spans(spans)])
            sent.sort(key=lambda r: (r[0], r[1]))
            edges = np.searchsorted(np.array([r[0] for r in sent]), np.arange(shards + 1))
            for s in range(shards):
                some = sent[edges[s] : edges[s + 1]]
                if some:
                    t = np.array([r[4] for r in some])
                    yield rows("contexts", [number], [s], [pack(
                        key=np.array([r[1] for r in some], np.uint32), bytes=pa.array([r[2] for r in some], pa.binary()),
                        before=np.array([r[3] for r in some], np.int32), row=t.astype(np.int32), at=np.array([r[5] for r in some], np.int64),
                        doc=doc[t], text=text[t])])

    return run


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def pack_spans(spans: list[tuple[int, int, int]]) -> bytes:
    row, start, stop = zip(*spans)
    return pack(row=np.array(row, np.int32), start=np.array(start, np.int64), stop=np.array(stop, np.int64))


# --- suffix sort ----------------------------------------------------------------------------

class Suffixes:
    """Suffixes of one byte string: begin[i] with size[i] bytes."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.raw, self.begin, self.size = raw, begin, size
        self.h = prefix_hashes(raw)
        self.inverse = powers(len(raw) + 1)[1]

    def part(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.h[begin + size] - self.h[begin]) * self.inverse[begin]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b have in common: binary search over prefix hashes."""
        x, y = self.begin[a], self.begin[b]
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.size[a], self.size[b])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.part(x, mid) == self.part(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b (a shorter one before its extensions, ties by number)."""
        n = self.common(a, b)
        x, y = self.size[a] > n, self.size[b] > n
        end = len(self.raw) - 1
        p = np.where(x, self.raw[np.minimum(self.begin[a] + n, end)].astype(np.int64), -1)
        q = np.where(y, self.raw[np.minimum(self.begin[b] + n, end)].astype(np.int64), -1)
        return np.where(p == q, a < b, p < q)

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which pairs of suffixes a and b have exactly n bytes in common, byte by byte, and stand in order: a ends there, or goes on
        with the smaller byte. (If all neighbours of a group do, the group is sorted.)"""
        end = len(self.raw) - 1
        good = np.ones(len(a), bool)
        for k in range(int(n.max(initial=-1)) + 1):
            live = n >= k
            x = self.raw[np.minimum(self.begin[a] + k, end)] == self.raw[np.minimum(self.begin[b] + k, end)]
            inside = k < np.minimum(self.size[a], self.size[b])
            good &= ~live | np.where(k < n, x, ~(x & inside))
        x, y = (self.raw[np.minimum(self.begin[s] + n, end)] for s in (a, b))
        return good & ((self.size[a] == n) | (self.size[b] > n) & (x < y))


def merge_sort(group: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """Order of the suffixes inside each group (groups are contiguous and rising). Runs of 1, 2, 4, ... are merged in
    all groups at once: an element's place is its place in its run plus its rank in the other run, which a
    binary search with suffix comparisons finds."""
    n = len(group)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([first, [n]]))
    start = np.repeat(first, sizes)
    stop = start + np.repeat(sizes, sizes)
    place = np.arange(n) - start
    width = 1
    while width < (sizes.max() if n else 0):
        live = np.flatnonzero(np.repeat(sizes > width, sizes))
        run = place[live] // width
        own = start[live] + run * width
        other = start[live] + (run ^ 1) * width
        low = np.minimum(other, stop[live])
        high = np.minimum(other + width, stop[live])
        base, mine = low.copy(), order[live]
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) >> 1
            less = suffixes.before(order[mid], mine[open_])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        to = start[live] + (run & ~1) * width + (live - own) + (low - base)
        merged = order.copy()
        merged[to] = mine
        order = merged
        width *= 2
    return order


def sorted_classes(group: np.ndarray, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes sorted inside their groups, and what each has in common with the one before it
    (-1 for the first of a group). Verified by bytes; a group in which hashes collided is sorted by bytes."""
    suffixes = Suffixes(raw, begin, size)
    order = merge_sort(group, suffixes)
    common = np.full(len(order), -1, np.int64)
    inner = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    a, b = order[inner - 1], order[inner]
    common[inner] = suffixes.common(a, b)
    for g in np.unique(group[b[~suffixes.verified(a, b, common[inner])]]).tolist():
        at = np.flatnonzero(group[order] == g)
        part = {i: raw[begin[i] : begin[i] + size[i]].tobytes() for i in order[at].tolist()}
        order[at] = sorted(part, key=lambda i: (part[i], i))
        for i in at[1:].tolist():
            x, y = part[int(order[i - 1])], part[int(order[i])]
            common[i] = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return order, common


def classes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Class of each suffix among those that agree in their first ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def window_spans(group: np.ndarray, parts: list[bytes], before: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first start, last start): runs of windows, as starts inside their context, that an equal window of
    a lower rank precedes. Groups are contiguous; before: bytes in front of the anchor."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    follow = sorted_classes(group, raw, begin[:-1] + before, sizes - before)
    back = raw[::-1]
    precede = sorted_classes(group, back, len(raw) - begin[:-1] - before, before)
    windows = sizes - length + 1  # starts 0 .. windows - 1 in the context; offset of the start from the anchor: before - start
    by_rank = np.argsort(rank, kind="stable")
    found_c, found_s = [], []
    most = before.max(initial=-1)
    for r in range(int(most) + 1):
        here = by_rank[(before[by_rank] >= r) & (before[by_rank] - r < windows[by_rank])]
        if len(here) < 2:
            continue
        left, right = classes_at(*precede, r)[here], classes_at(*follow, length - r)[here]
        both = left * np.int64(len(group) + 1) + right
        _, first, where = np.unique(both, return_index=True, return_inverse=True)
        later = rank[here] > rank[here[first]][where]
        found_c.append(here[later])
        found_s.append(before[here[later]] - r)
    if not found_c:
        none = np.zeros(0, np.int64)
        return none, none, none
    c, s = np.concatenate(found_c), np.concatenate(found_s)
    order = np.lexsort((s, c))
    c, s = c[order], s[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1] + 1)]) if len(c) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    final = np.concatenate([first[1:], [len(c)]]) - 1 if len(first) else first
    return c[first], s[first], s[final]


def compared(length: int):
    """Per shard: contexts of all blocks, by anchor; each block gets the spans of its contexts that repeat an earlier
    place. Spans that a block found itself pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in runs_of(batches, "shard"):
            tables, blocks = [], []
            for row in part:
                if row["kind"] == "spans":
                    yield rows("spans", [row["block"]], [-1], [row["payload"]])
                    continue
                b = unpack(row["payload"])
                tables.append(b)
                blocks.append(np.full(b.num_rows, row["block"], np.int64))
            if not tables:
                continue
            get = lambda name: np.concatenate([numbers(t, name) for t in tables])
            key, before, row, at, doc, text = (get(c) for c in ("key", "before", "row", "at", "doc", "text"))
            block = np.concatenate(blocks)
            parts = [p for t in tables for p in t.column(1).to_pylist()]
            tables.clear()
            # ranks by document and place; windows are compared at one offset from the anchor, so any place of a context
            # orders them; places of repeated rows are equal
            by = np.lexsort((at, text, doc))
            step = np.concatenate([[0], (doc[by][1:] != doc[by][:-1]) | (text[by][1:] != text[by][:-1]) | (at[by][1:] != at[by][:-1])]) if len(by) else []
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(step)
            # equal contexts of other blocks: all windows but those of the first place are repeated
            first: dict[tuple[int, bytes, int], int] = {}
            spans: dict[int, list[tuple[int, int, int]]] = {}
            keep, twins = [], {}
            for i in by.tolist():
                f = first.setdefault((int(key[i]), parts[i], int(before[i])), i)
                if f == i:
                    keep.append(i)
                elif rank[f] == rank[i]:  # the same place of a repeated row
                    twins.setdefault(f, [f]).append(i)
                else:
                    spans.setdefault(int(block[i]), []).append((int(row[i]), int(at[i]), int(at[i]) + len(parts[i])))
            keep = np.array(keep, np.int64)
            keep = keep[np.argsort(key[keep], kind="stable")]
            # an anchor with one context has nothing more to compare
            same = key[keep]
            n = np.unique(same, return_counts=True)
            keep = keep[np.repeat(n[1] > 1, n[1])]
            if len(keep):
                c, a, b = window_spans(key[keep].astype(np.int64), [parts[i] for i in keep.tolist()], before[keep].astype(np.int64), rank[keep], length)
                for f, x, y in zip(keep[c].tolist(), a.tolist(), b.tolist()):
                    for i in twins.get(f, (f,)):
                        spans.setdefault(int(block[i]), []).append((int(row[i]), int(at[i]) + x, int(at[i]) + y + length))
            for number, found in spans.items():
                yield rows("spans", [number], [shard], [pack_spans(found)])

    return run


def united(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row in order, those that touch or overlap as one."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    if not len(row):
        return row, start, stop
    # far-apart rows on one line, so that one running maximum does for all
    shift = row.astype(np.int64) * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return row[first], start[first], np.maximum.reduceat(stop, first)


def removed(carried: list[str], as_text: bool):
    """Per block: spans first, then the texts; the spans of each text united, and what is left of it: bytes, or text
    without the characters that a cut has split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in runs_of(batches, "block"):
            found, block = [], []
            for row in part:
                b = unpack(row["payload"])
                if row["kind"] == "spans":
                    found.append([numbers(b, c) for c in ("row", "start", "stop")])
                else:
                    block.append(b)
            block, _, _ = in_order(joined(block))
            raw, offsets = texts_of(block)
            row, start, stop = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            row, start, stop = united(row, start, stop)
            data, per = memoryview(raw), np.bincount(row, minlength=block.num_rows)
            first = np.concatenate([[0], np.cumsum(per)])
            for a in range(0, block.num_rows, 1000):
                b = min(a + 1000, block.num_rows)
                kept = []
                for i in range(a, b):
                    x, y, spans = int(offsets[i]), int(offsets[i + 1]), range(first[i], first[i + 1])
                    edges = [x, *(x + int(e) for k in spans for e in (start[k], stop[k])), y]
                    kept.append(b"".join([data[p:q] for p, q in zip(edges[::2], edges[1::2])]))
                x, y = first[a], first[b]
                pairs = np.stack([start[x:y], stop[x:y]], 1)
                cut = (first[a : b + 1] - x).astype(np.int32)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * (y - x) + 1, 2, dtype=np.int32)), pa.array(pairs.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).slice(a, b - a), pa.array(np.diff(offsets)[a:b], pa.int64()), pa.ListArray.from_arrays(pa.array(cut), inner),
                     pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), *[c.slice(a, b - a) for c in block.columns[2:]]],
                    names=["doc_id", "n_bytes", "spans", "kept", *carried])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = SHARD_BYTES, hot_contexts: int = HOT_CONTEXTS, carry: Sequence[str] = (), as_text: bool = False, **blocks) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans [start, stop] of every row, and the bytes that are left (with
    ``as_text``: their whole characters as a string); the columns ``carry`` of the row behind them, as carried_0, carried_1, ..."""
    shards = shard_count(docs, text_col, shard_bytes)
    written = write_blocks(docs, asked(shards, length, seed), "suffix-blocks", id_col=id_col, text_col=text_col, carry=carry, **blocks)
    order = ["kind", "block", "shard", "payload"]
    texts = written.where(F.col("kind") == "text").select(order)
    again = by_shard(written.where(F.col("kind") == "anchors").select(order)).mapInArrow(repeated(hot_contexts), COLUMNS)
    sent = by_block(again.unionByName(texts)).mapInArrow(contexts(shards, length, seed), COLUMNS)
    # spans that need no comparison are dealt by block, so that they don't meet in one shard
    sent = sent.withColumn("shard", F.when(F.col("shard") < 0, F.lit(shards) + F.pmod(F.col("block"), F.lit(shards)).cast("int")).otherwise(F.col("shard")))
    spans = by_shard(sent).mapInArrow(compared(length), COLUMNS)
    behind = [T.StructField(f"carried_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    shape = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *behind])
    return by_block(spans.unionByName(texts)).mapInArrow(removed([f.name for f in behind], as_text), shape)


def report(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def shortened(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) with the repeats cut out of the text; characters that
    a cut has split go wholly. A column n_chars gets the new length."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, carry=others, as_text=True)
    columns = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text": F.col("kept").alias("text")}
    columns |= {c: F.col(f"carried_{i}").alias(c) for i, c in enumerate(others)}
    if "n_chars" in others:
        columns["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[columns[c] for c in docs.columns])
