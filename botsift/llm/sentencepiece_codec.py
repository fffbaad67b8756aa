"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols (its characters, spaces written as the meta mark, one mark in front).
An agenda of adjacent pairs whose concatenation is a piece, ordered by score and then by place,
is worked off until no pair is left; symbols that are no pieces fall back to byte pieces. The
agendas of a batch's new parts are worked off side by side: a row of pair ranks for each part, of which
every round takes the least; parts of more than ``ROW_SYMBOLS`` symbols have a heap each.
No piece has the mark after another character, so no merge crosses a mark: a text is cut
before each run of marks and every distinct part is worked off once per task (while it is in the cache). Each new part
is checked, in the Arrow batch it first appears in, against the sentencepiece library; a part that
differs takes the library's ids and is counted in ``n_corrected``. A vocabulary with pieces that do
cross a mark is handled as well: its texts are one part each.

Defined results: a null text is the empty text (no ids, empty decoding); extra columns are left
out; repeated rows and null ids give one row each; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.common import STEP_BYTES, Slots, id_and_text, list_array, release, steps

MARK = "▁"
#: parts kept per task in each of the two generations of the cache
CACHE_PARTS = 250_000
#: symbols of a part whose agenda is a row of a table
ROW_SYMBOLS = 32
NONE = np.iinfo(np.int32).max
SCHEMA = "doc_id long, ids array<int>, decoded string, n_corrected int"
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCodec:
    """Encoder and decoder of one vocabulary file, with a bounded cache of parts."""

    def __init__(self, model_path: str, cache_parts: int = CACHE_PARTS):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces, self.bytes_of = {}, {}
        self.surface: list[str | bytes] = []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_of[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.surface.append("" if lib.is_control(i) else " ⁇ ")
            else:
                self.pieces[piece] = i
                self.surface.append(piece)
        order = {score: r for r, score in enumerate(sorted({lib.get_score(i) for i in self.pieces.values()}, reverse=True))}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.pieces.items()}
        self.unknown = lib.unk_id()
        self._tabulate()
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.cache_parts = cache_parts
        # ids of each part; the text spelt from them is kept only where it isn't the part behind a space
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spelt: dict[str, str] = {}
        self.corrected: set[str] = set()

    def merge(self, part: str) -> list[int]:
        """Ids of one part by the score-ordered agenda. An entry is a number: the rank of the pair's score,
        then the place of its left symbol; it is stale if the pair at that place has another rank by now."""
        rank, symbols = self.rank.get, list(part)
        n = len(symbols)
        agenda = [r << 32 | i for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if (r := rank(pair)) is not None]
        if agenda:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            heapq.heapify(agenda)
            pop, push = heapq.heappop, heapq.heappush
            while agenda:
                entry = pop(agenda)
                i = entry & 0xFFFFFFFF
                j, a = right[i], symbols[i]
                if not a or j >= n:
                    continue
                both = a + symbols[j]
                if rank(both) != entry >> 32:
                    continue
                symbols[i], symbols[j] = both, ""
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    r = rank(both + symbols[k])
                    if r is not None:
                        push(agenda, r << 32 | i)
                k = left[i]
                if k >= 0:
                    r = rank(symbols[k] + both)
                    if r is not None:
                        push(agenda, r << 32 | k)
        ids, pieces = [], self.pieces
        for s in symbols:
            if s:
                i = pieces.get(s)
                if i is not None:
                    ids.append(i)
                elif self.bytes_of:
                    ids.extend([self.bytes_of[b] for b in s.encode()])
                else:
                    ids.append(self.unknown)
        return ids

    def _tabulate(self) -> None:
        """Numbers for all symbols that can merge, and a table of the pairs that do."""
        symbols = sorted({*self.pieces, *{c for p in self.pieces for c in p}})
        number = {s: i for i, s in enumerate(symbols)}
        self.piece_of = np.array([self.pieces.get(s, -1) for s in symbols], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for s in symbols:
            if len(s) == 1:
                self.symbol_of[ord(s)] = number[s]
        found = [(number[p[:k]] << 32 | number[p[k:]], self.rank[p], number[p]) for p in self.pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.pairs = Slots(np.array([f[0] for f in found], np.uint64))
        self.pair_rank = np.array([f[1] for f in found] + [NONE], np.int32)   # the last stands for no pair
        self.pair_symbol = np.array([f[2] for f in found] + [-1], np.int32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair, or -1 (a symbol of -1 is in no pair)."""
        key = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32)
        found = self.pairs.index[self.pairs.find(key.ravel())].reshape(key.shape)
        return np.where((left >= 0) & (right >= 0), found, -1)

    def merge_rows(self, parts: list[str], width: int) -> list[bytes]:
        """Ids (as bytes) of parts of at most ``width`` symbols: all agendas side by side."""
        n = len(parts)
        chars = np.frombuffer("".join([p.ljust(width, "\0") for p in parts]).encode("utf-32-le"), np.uint32).reshape(n, width)
        sizes = np.fromiter(map(len, parts), np.int64, n)
        inside = np.arange(width) < sizes[:, None]
        sym = np.where(inside, self.symbol_of[chars], -1)
        sym = np.concatenate([sym, np.full((n, 1), -1, np.int32)], 1)
        start = np.tile(np.arange(width + 1, dtype=np.int16), (n, 1))
        place = np.full((n, width + 1), -1, np.int32)
        place[:, :-1] = self._look_up(sym[:, :-1], sym[:, 1:])
        rank = self.pair_rank[place]
        live, columns = np.arange(n), np.arange(width + 1)
        while len(live):
            at = rank[live].argmin(1)
            more = rank[live, at] < NONE
            live, at = live[more], at[more]
            if not len(live):
                break
            merged = self.pair_symbol[place[live, at]]
            # the symbols behind the pair move up by one
            source = np.minimum(columns + (columns > at[:, None]), width)
            for table, fill in ((sym, -1), (start, 0), (place, -1), (rank, NONE)):
                table[live] = np.take_along_axis(table[live], source, 1)
                table[live, width] = fill
            sym[live, at] = merged
            sizes[live] -= 1
            for k, real in ((at, at + 1 < sizes[live]), (at - 1, at > 0)):
                rows, k = live[real], k[real]
                found = self._look_up(sym[rows, k], sym[rows, k + 1])
                place[rows, k] = found
                rank[rows, k] = self.pair_rank[found]
            ended = live[at + 1 >= sizes[live]]
            place[ended, sizes[ended] - 1], rank[ended, sizes[ended] - 1] = -1, NONE
        left = columns < sizes[:, None]
        ids = np.where(sym >= 0, self.piece_of[sym], -1)
        flat = ids[left].astype(np.int32)
        data, cuts = flat.tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 4
        out = [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        for i in np.flatnonzero(((ids < 0) & left).any(1)).tolist():
            some = []
            for k in range(int(sizes[i])):
                if ids[i, k] >= 0:
                    some.append(int(ids[i, k]))
                elif self.bytes_of:
                    some.extend([self.bytes_of[b] for b in chr(chars[i, start[i, k]]).encode()])
                else:
                    some.append(self.unknown)
            out[i] = array("i", some).tobytes()
        return out

    def merge_all(self, parts: list[str]) -> list[bytes]:
        """Ids (as bytes) of parts, by rows of similar length or by a heap."""
        out: list[bytes] = [b""] * len(parts)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            by_width.setdefault(-(-len(p) // 4) * 4 if len(p) <= ROW_SYMBOLS else 0, []).append(i)
        for width, some in by_width.items():
            ids = self.merge_rows([parts[i] for i in some], width) if width else [array("i", self.merge(parts[i])).tobytes() for i in some]
            for i, x in zip(some, ids):
                out[i] = x
        return out

    def spell(self, ids: Sequence[int]) -> str:
        """Text of the ids of one part, its mark still in front as a space."""
        said = [self.surface[i] for i in ids]
        if bytes in set(map(type, said)):
            out, run = [], bytearray()
            for s in [*said, ""]:
                if isinstance(s, bytes):
                    run += s
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(s)
            said = out
        return "".join(said).replace(MARK, " ")

    def parts(self, text: str) -> list[str]:
        """Parts of a text, each without its first mark."""
        if not text:
            return []
        if not self.separable:
            return [text.replace(" ", MARK)]
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [p[1:] for p in _RUNS.findall(MARK + text.replace(" ", MARK))]

    def learn(self, keys: set[str]) -> None:
        """Work off the parts that no generation of the cache holds, and check them."""
        new = []
        for k in keys:
            kept = self.old.get(k)
            if kept is not None:
                self.young[k] = kept
            else:
                new.append(k)
        if not new:
            return
        known = self.library.encode([k or MARK for k in new], num_threads=1)
        spelt = self.library.decode(known, num_threads=1)
        for k, ids, text, own in zip(new, known, spelt, self.merge_all([MARK + k for k in new])):
            checked = array("i", ids).tobytes()
            if not k:  # a lone mark: the library puts another in front, which would make it two
                checked, text = own, ""
            said = self.spell(array("i", own))
            if own != checked or said[1:] != text:
                own, said = checked, " " + text
                self.corrected.add(k)
            self.young[k] = own
            if said != " " + k:
                self.spelt[k] = said

    def forget(self) -> None:
        """Give back the memory of the parts: the worker may go on with something else."""
        self.young, self.old, self.spelt = {}, {}, {}
        self.corrected.clear()
        release()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[str], list[int]]:
        """Flat ids, ids per text, decoded texts, corrected parts per text."""
        cut = [self.parts(t) for t in texts]
        missing = {p for ps in cut for p in ps}.difference(self.young)
        self.learn(missing)
        found = self.young
        flat, lengths, decoded, wrong = [], [], [], []
        for ps in cut:
            ids = b"".join([found[p] for p in ps])
            flat.append(ids)
            lengths.append(len(ids) // 4)
            if self.spelt.keys().isdisjoint(ps):
                decoded.append(" ".join(ps))
            else:
                decoded.append("".join([self.spelt.get(p) or " " + p for p in ps])[1:])
            wrong.append(len([p for p in ps if p in self.corrected]) if self.corrected else 0)
        if len(found) > self.cache_parts:
            self.old, self.young = found, {}
            self.spelt = {k: t for k, t in self.spelt.items() if k in found}
            self.corrected &= found.keys()
        return np.frombuffer(b"".join(flat), np.int32), lengths, decoded, wrong


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of a vocabulary file, built once per Python worker."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", step_bytes: int = STEP_BYTES,
                  cache_parts: int = CACHE_PARTS) -> DataFrame:
    """(doc_id, ids, decoded, n_corrected) of every whole text. ``model_path`` is a vocabulary
    file that every worker can open (part of the installation, never of the data). Smaller steps and a smaller cache need less
    memory and some ten percent more time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_path)
        pieces.cache_parts = cache_parts
        for batch in batches:
            for part in steps(batch, "text", step_bytes):
                flat, lengths, decoded, wrong = pieces.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), list_array(flat, np.array(lengths), pa.int32()),
                     pa.array(decoded, pa.string()), pa.array(wrong, pa.int32())],
                    names=["doc_id", "ids", "decoded", "n_corrected"],
                )
        pieces.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """The digest columns of the registered query, and the columns ``more``."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "n_corrected", *more,
    )
