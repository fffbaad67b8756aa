"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each context of up to ``DEPTH`` bytes keeps a Krichevsky-Trofimov
estimate for each of its (at most 255) decision nodes. A node's weighted probability is half its own block
probability and half the product of its children's, from the longest contexts down to the empty one; the same weights mix
the estimates of all depths when a byte is scored. A context that training hasn't seen leaves the mixture to the
shorter ones. A text is its lower-cased (A-Z) bytes and an end mark; contexts never reach into another text.

Counting: blocks of texts (see blocks.py) count their distinct strings of DEPTH + 1 bytes; these are summed by
shards of the two nearest context bytes, or of three where a histogram of all texts shows a pair to be frequent, and every shard
builds its part of the tree. The levels above (the empty context, those of one byte, and those of the frequent pairs: at
most 255 nodes for each of 1 + 255 + 4,096 contexts) are summed over the shards and handed to all tasks. Each block then gets the
code length of its own strings back. Word counts of the base score travel the same way, by shards of the word.
Nothing that grows with the corpus is broadcast or collected, and no text is read in part.

Defined results: a null text is the empty text (one end mark, one token); a null id counts as the empty text for the held-out
share; without training rows every bit costs one bit and every token is unknown; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.blocks import by_block, by_shard, joined, numbers, pack, rising, rows, runs_of, shard_count, texts_of, unpack, write_blocks
from botsift.llm.common import Slots, buffer_of, id_and_text
from botsift.session import materialize

MODULUS = 10
DEPTH = 5
#: byte that stands before a text and after it; no UTF-8 text has it
EDGE = 0xFF
PIECE = 1 << 20
SHARD_BYTES = 16 << 20
#: pairs of context bytes in so many places, or in this part of all, are split by a third byte
HOT_PLACES, HOT_PARTS = SHARD_BYTES // 2, 4096
SMOOTHING = 0.1
LEVELS = range(8)


def held_out(ids: list) -> np.ndarray:
    """Rows whose crc32 of the id as text, modulo ``MODULUS``, is 0."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % MODULUS == 0 for i in ids], bool)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def strings(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, stop text, codes): for runs of texts, the code of every byte and end mark: the byte
    in the lowest place, the nearest context byte in the highest."""
    lengths = np.diff(offsets)
    first = 0
    while first < len(lengths):
        stop = int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1
        stop = min(max(stop, first + 1), len(lengths))
        size = lengths[first:stop]
        # each text is followed by DEPTH edges, the first of which is its end mark
        starts = DEPTH + np.concatenate([[0], np.cumsum(size + DEPTH)])
        line = np.full(int(starts[-1]), EDGE, np.uint8)
        inside = np.ones(len(line), bool)
        inside[:DEPTH] = False
        ends = starts[1:] - DEPTH
        inside[(ends[:, None] + np.arange(1, DEPTH)).ravel()] = False
        body = inside.copy()
        body[ends] = False
        line[body] = raw[offsets[first] : offsets[stop]]
        wide = line.astype(np.uint64)
        codes = wide[DEPTH - 1 : -1].copy()
        for k in range(2, DEPTH + 1):
            codes <<= np.uint64(8)
            codes |= wide[DEPTH - k : len(wide) - k]
        codes <<= np.uint64(8)
        codes |= wide[DEPTH:]
        yield first, stop, codes[inside[DEPTH:]]
        first = stop


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with their counts added."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def pair_of(codes: np.ndarray) -> np.ndarray:
    """The two nearest context bytes."""
    return (codes >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)


def frequent_pairs(docs: DataFrame, places: int, id_col: str, text_col: str) -> np.ndarray:
    """Which pairs of bytes (of 65,536, the nearer one in front) stand in more than ``places`` places of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            raw, offsets = buffer_of(batch.column(1))
            for a in range(int(offsets[0]), int(offsets[-1]), PIECE):
                part = lower(raw[a : min(a + PIECE + 1, int(offsets[-1]))]).astype(np.int64)
                n += np.bincount(part[1:] << 8 | part[:-1], minlength=1 << 16)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["pair", "n"])

    counts = id_and_text(docs, id_col, text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    hot = np.zeros(1 << 16, bool)
    hot[[r["pair"] for r in counts.where(F.col("n") > places).collect()]] = True  # fewer than HOT_PARTS
    return hot


def shard_of(codes: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """By the two nearest context bytes, three where these are frequent."""
    pair = pair_of(codes)
    triple = (codes >> np.uint64(8 * (DEPTH - 2))).astype(np.int64) + (1 << 16)
    return (np.where(hot[pair], triple, pair) * 2654435761 >> 12) % shards


def word_lists(block: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Distinct words of a block's texts with the number of each place, and the words per text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(block.column(1)))
    flat = cut.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full).dictionary_encode(), np.bincount(owner, minlength=block.num_rows)


def word_shards(words: pa.Array, shards: int) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.int64) % shards


def counted(shards: int, hot: np.ndarray):
    """What a block asks: its strings and words, with their counts in training texts, by shard."""

    def ask(number: int, block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        train = ~held_out(block.column(0).to_pylist())
        raw, offsets = texts_of(block)
        raw = lower(raw)
        parts = []
        for first, stop, codes in strings(raw, offsets):
            learn = np.repeat(train[first:stop], np.diff(offsets)[first:stop] + 1)
            tagged = np.sort(codes << np.uint64(1) | learn)
            plain = tagged >> np.uint64(1)
            at = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
            parts.append((plain[at], np.add.reduceat((tagged & np.uint64(1)).astype(np.int64), at)))
        codes, counts = summed(*[np.concatenate(x) for x in zip(*parts)])
        shard = shard_of(codes, shards, hot)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            pick = order[edges[s] : edges[s + 1]]
            if len(pick):
                yield rows("strings", [number], [s], [pack(codes=rising(codes[pick]), counts=counts[pick].astype(np.uint32))])
        words, per_text = word_lists(block)
        learn = np.repeat(train, per_text)
        index = words.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(index[learn], minlength=len(words.dictionary))
        shard = word_shards(words.dictionary, shards)
        for s in np.unique(shard):
            pick = np.flatnonzero(shard == s)
            yield rows("words", [number], [int(s)], [pack(words=words.dictionary.take(pa.array(pick)), counts=counts[pick].astype(np.uint32))])
        yield rows("ends", [number], [int(train.sum())], [b""])

    return ask


# --- the tree -------------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers (Stirling's series after eight steps up)."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    inv = 1 / y
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def half_and_half(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2.0)


class Nodes:
    """Decision nodes of one depth and bit level, sorted by key (context, then the bits so far)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
        self.key, self.zeros, self.ones = key, zeros, ones
        own = block_probability(zeros, ones)
        self.weighted = own if children is None else half_and_half(own, children)
        self.stay = np.exp(own - np.log(2.0) - self.weighted) if children is not None else np.ones(len(own))

    def mix(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of the bits after this depth; ``deeper`` is that of longer contexts, NaN where unseen."""
        if not len(self.key):
            return deeper
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        seen = self.key[at] == key
        zeros, ones = self.zeros[at], self.ones[at]
        own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        stay = self.stay[at]
        mixed = np.where(np.isnan(deeper), own, stay * own + (1 - stay) * deeper)
        return np.where(seen, mixed, deeper)


def node_key(codes: np.ndarray, depth: int, level: int) -> np.ndarray:
    """Context of ``depth`` bytes, then the bits of the byte before bit ``level`` with a one in front."""
    byte = codes & np.uint64(255)
    context = codes >> np.uint64(8 * (DEPTH + 1 - depth))
    return context << np.uint64(8) | np.uint64(1 << level) | byte >> np.uint64(8 - level)


def parent_key(key: np.ndarray) -> np.ndarray:
    """The same decision one byte of context nearer."""
    return key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255)


def next_bit(codes: np.ndarray, level: int) -> np.ndarray:
    return (codes >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)


def grow(codes: np.ndarray, counts: np.ndarray, least: int) -> dict[tuple[int, int], Nodes]:
    """All nodes of depths ``least`` to DEPTH, from strings of training texts and their counts."""
    tree: dict[tuple[int, int], Nodes] = {}
    for depth in range(DEPTH, least - 1, -1):
        for level in LEVELS:
            key = node_key(codes, depth, level)
            order = np.argsort(key, kind="stable")
            key, bit, n = key[order], next_bit(codes, level)[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            ones = np.add.reduceat(n * bit, first) if len(first) else n
            children = None
            if depth < DEPTH:
                below = tree[depth + 1, level]
                children = np.bincount(np.searchsorted(key[first], parent_key(below.key)), weights=below.weighted, minlength=len(first))
            tree[depth, level] = Nodes(key[first], total - ones, ones, children)
    return tree


def shard_tree(hot: np.ndarray):
    """Sum the strings of each shard, grow its part of the tree, and keep for each string the eight
    probabilities that contexts of two bytes and more give (three and more for frequent pairs); for contexts of one byte, and of
    frequent pairs, the sums of their children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in runs_of(batches, "shard"):
            yield from _shard_tree(shard, part, hot)

    return run


def _shard_tree(shard: int, part: Iterator[dict], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def compact():
        nonlocal codes, counts, held, size
        codes, counts = summed(np.concatenate([codes, *[h[0] for h in held]]), np.concatenate([counts, *[h[1] for h in held]]))
        held, size = [], 0

    for row in part:
        b = unpack(row["payload"])
        held.append((np.cumsum(numbers(b, "codes"), dtype=np.uint64), numbers(b, "counts").astype(np.int64)))
        size += len(held[-1][0])
        if size > max(2_000_000, len(codes)):
            compact()
    compact()
    wide = hot[pair_of(codes)]
    kept = {f"p{level}": np.full(len(codes), np.nan, np.float32) for level in LEVELS}
    for some, least in ((np.flatnonzero(~wide), 2), (np.flatnonzero(wide), 3)):
        mine, n = codes[some], counts[some]
        tree = grow(mine[n > 0], n[n > 0], least)
        for level in LEVELS:
            bit, p = next_bit(mine, level), np.full(len(mine), np.nan)
            for depth in range(DEPTH, least - 1, -1):
                p = tree[depth, level].mix(node_key(mine, depth, level), bit, p)
            kept[f"p{level}"][some] = p
        top = [tree[least, level] for level in LEVELS]
        key = np.concatenate([parent_key(t.key) for t in top])
        values = [np.concatenate([getattr(t, a) for t in top]) for a in ("zeros", "ones", "weighted")]
        uniq, where = np.unique(key, return_inverse=True)
        sums = [np.bincount(where, weights=v, minlength=len(uniq)).astype(np.float64) for v in values]
        yield rows("top", [0], [shard], [pack(depth=np.full(len(uniq), least - 1), key=uniq.astype(np.int64), zeros=sums[0], ones=sums[1], children=sums[2])])
    yield rows("model", [0], [shard], [pack(codes=rising(codes), **kept)])


def top_nodes(parts: DataFrame) -> dict[tuple[int, int], Nodes]:
    """Nodes of the frequent pairs, of the contexts of one byte and of the empty context."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("payload"):
                yield unpack(p.as_py())

    sums = parts.select("payload").mapInArrow(spread, "depth long, key long, zeros double, ones double, children double")
    found = sums.groupBy("depth", "key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("children").alias("children")).collect()
    found.sort(key=lambda r: (r["depth"], r["key"]))
    depth_of, key = np.array([r["depth"] for r in found], np.int64), np.array([r["key"] for r in found], np.uint64)
    values = [np.array([r[c] for r in found], np.float64) for c in ("zeros", "ones", "children")]
    tree = {}
    for level in LEVELS:
        above = np.zeros(0, np.uint64), [np.zeros(0)] * 3  # what the nodes of one byte more add to their parents
        for depth in (2, 1, 0):
            here = (depth_of == depth) & ((key & np.uint64(255)) >> np.uint64(level) == 1)
            uniq, where = np.unique(np.concatenate([key[here], above[0]]), return_inverse=True)
            nodes = Nodes(uniq, *[np.bincount(where, weights=np.concatenate([v[here], a]), minlength=len(uniq)) for v, a in zip(values, above[1])])
            tree[depth, level] = nodes
            above = parent_key(nodes.key), [nodes.zeros, nodes.ones, nodes.weighted]
    return tree


def answers(tree: dict[tuple[int, int], Nodes]):
    """Per shard: the model's row first, then the blocks' strings; each block gets the log10 probability of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in runs_of(batches, "shard"):
            known, cost = np.zeros(0, np.uint64), np.zeros(0, np.float32)
            for row in part:
                b = unpack(row["payload"])
                codes = np.cumsum(numbers(b, "codes"), dtype=np.uint64)
                if row["kind"] == "model":
                    total = np.zeros(len(codes))
                    for level in LEVELS:
                        bit, p = next_bit(codes, level), numbers(b, f"p{level}").astype(np.float64)
                        for depth in (2, 1, 0):
                            p = tree[depth, level].mix(node_key(codes, depth, level), bit, p)
                        total += np.log10(np.where(np.isnan(p), 0.5, p))
                    known, cost = codes, total.astype(np.float32)
                else:
                    yield rows("costs", [row["block"]], [shard], [pack(codes=rising(codes), cost=cost[np.searchsorted(known, codes)])])

    return run


def word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: training counts of its words over all blocks, sent back to each block in the order it asked;
    and the shard's number of training tokens and of distinct words among them. A shard's rows are held
    compressed; their number of bytes is bounded by the number of shards."""
    for shard, part in runs_of(batches, "shard"):
        held = [(r["block"], r["payload"]) for r in part]
        table = pa.concat_tables([pa.Table.from_batches([unpack(p)]) for _, p in held]).combine_chunks()
        code = table.column("words").chunk(0).dictionary_encode()
        index = code.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(index, weights=table.column("counts").to_numpy(), minlength=len(code.dictionary)).astype(np.int64)
        at = 0
        for block, payload in held:
            n = unpack(payload).num_rows
            yield rows("counts", [block], [shard], [pack(counts=counts[index[at : at + n]])])
            at += n
        yield rows("sums", [int(counts.sum())], [int((counts > 0).sum())], [b""])


class Costs:
    """Costs of codes that are all known."""

    def __init__(self, codes: np.ndarray, cost: np.ndarray):
        self.slots = Slots(codes)
        self.cost = np.append(cost, np.float32(0))[self.slots.index]

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.cost[self.slots.find(codes)]


def text_scores(shards: int, smoothing: float, train_ends: int):
    """Per block: costs and counts first, then the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in runs_of(batches, "block"):
            codes, cost, replies, block = [], [], {}, []
            for row in part:
                b = unpack(row["payload"])
                if row["kind"] == "costs":
                    codes.append(np.cumsum(numbers(b, "codes"), dtype=np.uint64))
                    cost.append(numbers(b, "cost"))
                elif row["kind"] == "counts":
                    replies[row["shard"]] = numbers(b, "counts")
                else:
                    block.append(b)
            block = joined(block)
            table = Costs(np.concatenate(codes), np.concatenate(cost))
            raw, offsets = texts_of(block)
            raw = lower(raw)
            score = np.zeros(block.num_rows)
            for first, stop, here in strings(raw, offsets):
                starts = offsets[first:stop] - offsets[first] + np.arange(stop - first)
                score[first:stop] = np.add.reduceat(table.of(here).astype(np.float64), starts)
            words, per_text = word_lists(block)
            shard = word_shards(words.dictionary, shards)
            seen = np.zeros(len(words.dictionary), np.int64)
            for s, counts in replies.items():
                seen[shard == s] = counts
            index = words.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(block.num_rows), per_text)
            logs = np.bincount(owner, weights=np.log10(seen + smoothing)[index], minlength=block.num_rows) + np.log10(train_ends + smoothing)
            known = np.bincount(owner, weights=(seen > 0)[index], minlength=block.num_rows).astype(np.int64) + (train_ends > 0)
            ids = block.column(0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held_out(ids.to_pylist())), pa.array(per_text.astype(np.int64) + 1), pa.array(known), pa.array(logs), pa.array(score),
                 pa.array(np.diff(offsets))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smoothing: float = SMOOTHING,
                shard_bytes: int = SHARD_BYTES, hot_places: int | None = None, **blocks) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    shards = shard_count(docs, text_col, shard_bytes)
    hot = frequent_pairs(docs, hot_places or max(HOT_PLACES, shards * shard_bytes // HOT_PARTS), id_col, text_col)
    asked = write_blocks(docs, counted(shards, hot), "context-blocks", id_col=id_col, text_col=text_col, **blocks)
    kinds = {k: asked.where(F.col("kind") == k) for k in ("text", "strings", "words", "ends")}
    order = ["kind", "block", "shard", "payload"]
    columns = "kind string, block long, shard int, payload binary"
    built = materialize(by_shard(kinds["strings"].select(order)).mapInArrow(shard_tree(hot), columns), "context-tree")
    tree = top_nodes(built.where(F.col("kind") == "top"))
    # "model" sorts before "strings", so a shard's model comes before what is asked of it
    both = built.where(F.col("kind") == "model").select(order).unionByName(kinds["strings"].select(order))
    costs = by_shard(both, "kind").mapInArrow(answers(tree), columns)
    counts = materialize(by_shard(kinds["words"].select(order)).mapInArrow(word_totals, columns), "word-counts")
    sums = counts.where(F.col("kind") == "sums").agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("shard"), F.lit(0))).first()
    ends = kinds["ends"].agg(F.coalesce(F.sum("shard"), F.lit(0))).first()[0]
    tokens, distinct = sums[0] + ends, sums[1] + (1 if ends else 0)
    # "costs" and "counts" sort before "text"
    back = costs.unionByName(counts.where(F.col("kind") == "counts").select(order)).unionByName(kinds["text"].select(order))
    out = by_block(back).mapInArrow(
        text_scores(shards, smoothing, ends),
        "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long")
    each = float(np.log10(tokens + smoothing * (distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score", "n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
