"""Packing of tokenized texts into training sequences by best-fit decreasing.

Every text becomes its token ids and an end id. A text of more than a window is cut into full windows first, each a
sequence of its own; what is left of it, and every shorter text, is a tail. A task holds at most ``CHUNK_TAILS`` tails
(and their ids) and packs them, longest first: a segment tree indexed by remaining capacity finds the tightest open
window that takes the tail, otherwise a new one is opened. Windows that stay open with ``least_gap`` ids or more free
are then filled up: the pieces of the emptiest go into the gaps of the fullest, cut where a gap ends, so lengths that fit badly
(a group of copies just over half a window) don't leave padding either. The one window that is left goes on to the
task's next tails.

A task needs nothing but its own rows: there is no shuffle, a hot source, key or group of copies is spread as the
scan spreads it, and a lost task repeats its own rows only. The packed table is written once, so that the sequences
of a task always stem from one attempt.

Defined results: a null or empty text is the end id alone; a null id stays null; repeated rows are packed each; ties of length go by
id (null first), start and checksum; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from botsift.llm.common import id_and_text, release, steps
from botsift.session import materialize

WINDOW = 1024
END_ID = 0
#: tails that a task holds and packs together (at most this times a window of ids)
CHUNK_TAILS = 8192
#: free ids from which an open window is filled up with cut pieces
LEAST_GAP = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEQUENCES = "sequence_id long, ids array<int>, doc_ids array<long>, lengths array<int>"

# Fixed value: the pattern that cuts a text before byte-pair merging in this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 for itself, the others
    from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = {}, 256
    for b in range(256):
        if b in printable:
            letters[chr(b)] = b
        else:
            letters[chr(extra)] = b
            extra += 1
    return letters


class ByteEncoder:
    """Ids of a byte-level vocabulary file of the ``tokenizers`` library. The merging is done by ``tiktoken`` from the same
    file, which is about three times as fast; the first text of every step is held against ``tokenizers``."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.fast.encode_to_numpy(t, allowed_special="all") for t in texts]
        if texts and found[0].tolist() != self.library.encode(texts[0], add_special_tokens=False).ids:
            raise ValueError("the vocabulary file isn't of the byte-level kind that this encoder reads")
        return found


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """The encoder of a vocabulary file, built once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


class OpenWindows:
    """Open windows by remaining capacity: leaf c of a segment tree keeps the windows with c ids free, and every inner
    place counts those below it, so the tightest window for a length is found on one way up and down."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, number: int) -> None:
        self.at[capacity].append(number)
        place = self.leaves + capacity
        while place:
            self.count[place] += 1
            place >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of at least ``length``: (capacity, number), or None."""
        count, place = self.count, self.leaves + length
        if not count[place]:
            while place > 1 and (place & 1 or not count[place + 1]):
                place >>= 1
            if place <= 1:
                return None
            place += 1
            while place < self.leaves:
                place = 2 * place if count[2 * place] else 2 * place + 1
        capacity = place - self.leaves
        while place:
            count[place] -= 1
            place >>= 1
        return capacity, self.at[capacity].pop()


@dataclass(slots=True)
class Piece:
    """A run of a document's ids."""
    doc: int | None
    start: int
    ids: np.ndarray
    total: int

    def split(self, first: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:first], self.total),
                Piece(self.doc, self.start + first, self.ids[first:], self.total))

    def checksum(self) -> int:
        return zlib.crc32(np.ascontiguousarray(self.ids, "<u4").data)


@dataclass(slots=True)
class Window:
    pieces: list[Piece] = field(default_factory=list)
    filled: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.filled += len(piece.ids)


def best_fit(tails: list[Piece], window: int) -> list[Window]:
    """Best-fit decreasing: each tail, longest first, into the tightest window that takes it."""
    tails = sorted(tails, key=lambda p: (-len(p.ids), p.doc is not None, p.doc or 0, p.start, p.checksum()))
    tree, windows = OpenWindows(window), []
    for piece in tails:
        length = len(piece.ids)
        found = tree.tightest(length)
        if found is None:
            capacity, number = window, len(windows)
            windows.append(Window())
        else:
            capacity, number = found
        windows[number].add(piece)
        if capacity > length:
            tree.put(capacity - length, number)
    return windows


def fill_up(windows: list[Window], window: int, least_gap: int) -> list[Window]:
    """Windows with ``least_gap`` ids or more free give and take until one of them is left: the emptiest gives its last pieces
    to the fullest, cut at the end of a gap."""
    rest = sorted((w for w in windows if window - w.filled >= least_gap), key=lambda w: w.filled)
    give, take = 0, len(rest) - 1
    while give < take:
        giver, taker = rest[give], rest[take]
        piece, gap = giver.pieces.pop(), window - taker.filled
        giver.filled -= len(piece.ids)
        if len(piece.ids) > gap:
            kept, piece = piece.split(len(piece.ids) - gap)
            giver.add(kept)
        taker.add(piece)
        if window - taker.filled < least_gap:
            take -= 1
        if not giver.pieces:
            give += 1
    return [w for w in windows if w.pieces]


def packed(documents: Iterator[tuple[int | None, np.ndarray]], window: int, least_gap: int, chunk_tails: int) -> Iterator[Window]:
    """The windows of one task's documents (id, ids with the end id)."""
    tails: list[Piece] = []
    for doc, ids in documents:
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            yield Window([Piece(doc, start, ids[start : start + window], len(ids))], window)
        if whole < len(ids):
            tails.append(Piece(doc, whole, ids[whole:].copy() if whole else ids, len(ids)))
        if len(tails) >= chunk_tails:
            windows = fill_up(best_fit(tails, window), window, least_gap)
            last = min(windows, key=lambda w: w.filled)
            tails = last.pieces if window - last.filled >= least_gap else []
            yield from (w for w in windows if not (tails and w is last))
    yield from fill_up(best_fit(tails, window), window, least_gap)


def _run(docs: DataFrame, path: str, window: int, end_id: int, least_gap: int, chunk_tails: int, schema: str,
         emit: Callable[[int, list[tuple[int, Window]]], pa.RecordBatch], id_col: str, text_col: str) -> DataFrame:
    if window < 1 or not 1 <= least_gap <= window or chunk_tails < 2:
        raise ValueError("window and least_gap must be positive, least_gap no more than the window, chunk_tails 2 or more")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        encode = encoder(path).encode
        for batch in batches:
            for part in steps(batch, "text"):
                found = encode(part.column("text").to_pylist())
                for doc, ids in zip(part.column("doc_id").to_pylist(), found):
                    yield doc, np.append(ids, np.uint32(end_id)).astype(np.uint32, copy=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, []
        for w in packed(documents(batches), window, least_gap, chunk_tails):
            held.append((number, w))
            number += 1
            if len(held) == 1024:
                yield emit(held)
                held = []
        if held:
            yield emit(held)
        release()

    return materialize(id_and_text(docs, id_col, text_col).mapInArrow(run, schema), "packed")


def _piece_rows(windows: list[tuple[int, Window]]) -> pa.RecordBatch:
    rows = []
    for number, w in windows:
        offset = 0
        for p in w.pieces:
            rows.append((p.doc, p.start, len(p.ids), p.checksum(), p.total, number, offset))
            offset += len(p.ids)
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def _sequence_rows(windows: list[tuple[int, Window]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([n for n, _ in windows], pa.int64()),
        pa.array([np.concatenate([p.ids for p in w.pieces]).astype(np.int32) for _, w in windows], pa.list_(pa.int32())),
        pa.array([[p.doc for p in w.pieces] for _, w in windows], pa.list_(pa.int64())),
        pa.array([[len(p.ids) for p in w.pieces] for _, w in windows], pa.list_(pa.int32())),
    ], names=["sequence_id", "ids", "doc_ids", "lengths"])


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, least_gap: int = LEAST_GAP,
         chunk_tails: int = CHUNK_TAILS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece (see ``PIECES``): where it lies in its document and in its sequence. ``path``: a byte-level
    vocabulary file that every worker can open."""
    return _run(docs, path, window, end_id, least_gap, chunk_tails, PIECES, _piece_rows, id_col, text_col)


def sequences(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, least_gap: int = LEAST_GAP,
              chunk_tails: int = CHUNK_TAILS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: (sequence_id, ids, doc_ids and lengths of their pieces), not padded."""
    return _run(docs, path, window, end_id, least_gap, chunk_tails, SEQUENCES, _sequence_rows, id_col, text_col)
