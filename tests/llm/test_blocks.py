import random

import numpy as np
import pyarrow as pa

from botsift.llm import blocks


def test_messages_come_back_as_they_were():
    rng = random.Random(3)
    kinds = {"i1": pa.int8(), "u4": pa.uint32(), "i8": pa.int64(), "u8": pa.uint64(), "f4": pa.float32(), "f8": pa.float64(), "b": pa.bool_(),
             "s": pa.string(), "x": pa.binary(), "ls": pa.large_string(), "lx": pa.large_binary()}

    def value(kind):
        if pa.types.is_boolean(kind):
            return rng.random() < 0.5
        if pa.types.is_floating(kind):
            return float(np.float32(rng.random()))
        if pa.types.is_integer(kind):
            return rng.randint(0, 127)
        text = "".join(rng.choice("aé中\x00 ") for _ in range(rng.randint(0, 9)))
        return text if "string" in str(kind) else text.encode()

    for _ in range(400):
        n = rng.choice([0, 1, 2, 7, 40, 300])
        some = rng.sample(list(kinds), rng.randint(1, 5))
        columns = {name: pa.array([value(kinds[name]) for _ in range(n)], kinds[name]) for name in some}
        batch = blocks.unpack(blocks.pack(**columns))
        assert batch.schema.names == some
        for name in some:
            assert batch.column(some.index(name)).equals(columns[name]), name
    # values that a short message doesn't hold: nulls, lists, long texts
    for column in (pa.array([1, None]), pa.array([[1], [2]]), pa.array(["x" * 100_000])):
        assert blocks.unpack(blocks.pack(a=column)).column(0).equals(column)
    parts = blocks.unpack(blocks.pack(a=pa.array(range(500))))
    assert blocks.unpack(blocks.pack(a=parts.column(0).slice(490, 5))).column(0).to_pylist() == [490, 491, 492, 493, 494]


def test_a_message_of_one_key_is_short():
    assert len(blocks.pack(key=np.array([5], np.uint32), n=np.array([1], np.uint32))) < 32
    one = blocks.pack(key=np.array([5], np.uint32), bytes=pa.array([b"x" * 100], pa.binary()), before=np.array([3], np.int32), row=np.array([0], np.int32),
                      at=np.array([9]), doc=np.array([1]), text=np.array([2]))
    assert len(one) < 100 + 100
