import numpy as np
import pytest
import sentencepiece

from botsift.llm.queries import vocabulary
from botsift.llm.sentencepiece_codec import PieceCodec, digests, encode_decode


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary())


def odd_texts():
    rng = np.random.default_rng(3)
    signs = list("ab the ing é中😀\t\n\r\x00▁  ﬁ<0x41>\u2028\u0301ñ") + ["▁▁", "   ", "<s>", "the "]
    return ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(1500)] + ["", " ", "  ", "▁", "a ", " a", "\x00", "x" * 5000, "ab" * 3000]


def test_agenda_equals_the_library(library):
    c = PieceCodec(vocabulary(), cache_parts=200)
    texts = odd_texts()
    for i in range(0, len(texts), 100):
        some = texts[i : i + 100]
        flat, lengths, decoded, _ = c.encode(some)
        want = library.encode(some)
        cut = np.split(flat, np.cumsum(lengths)[:-1])
        assert [x.tolist() for x in cut] == want
        assert decoded == library.decode(want)
    assert not c.corrected


def test_heap_and_rows_agree():
    c = PieceCodec(vocabulary())
    parts = [p for t in odd_texts() for p in c.parts(t) if p and len(p) <= 31]
    assert c.merge_all(["▁" + p for p in parts]) == [np.array(c.merge("▁" + p), np.int32).tobytes() for p in parts]


def test_texts_that_are_one_part_each(library):
    c = PieceCodec(vocabulary())
    c.separable = False
    flat, lengths, decoded, _ = c.encode(["hello  world", "", "naïve café"])
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == library.encode(["hello  world", "", "naïve café"])
    assert decoded == ["hello  world", "", "naïve café"]


def test_a_wrong_part_is_corrected(library, monkeypatch):
    c = PieceCodec(vocabulary())
    monkeypatch.setattr(c, "merge_all", lambda parts: [(5).to_bytes(4, "little")] * len(parts))
    flat, _, decoded, wrong = c.encode(["one two"])
    assert flat.tolist() == library.encode("one two") and decoded == ["one two"] and wrong == [2]


def test_hard_rows_and_empty(hard, empty, library):
    import hashlib

    rows = encode_decode(hard, vocabulary()).collect()
    assert len(rows) == 14 and all(r.n_corrected == 0 for r in rows)
    texts = sorted(r.text or "" for r in hard.collect())
    assert sorted(r.decoded for r in rows) == sorted(library.decode(library.encode(texts)))
    assert digests(encode_decode(empty, vocabulary())).collect() == []
    nothing = [r for r in digests(encode_decode(hard, vocabulary())).collect() if r.n_tokens == 0]
    assert len(nothing) == 3 and {r.ids_sha256 for r in nothing} == {hashlib.sha256(b"").hexdigest()}
