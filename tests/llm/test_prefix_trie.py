import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from botsift.llm import prefix_trie

SF = "/root/testdata/sf0.01"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def rebuilt(rows, group=20, heads=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % group if c >= 0 else -(-c % group))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Every node by looking at all conversations that start with it."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def words(node):
        return len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0

    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(node, [])]
        sums[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words(node))
    return {(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), *sums[node],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode()).hexdigest())
            for node, m in members.items()}


def run(df, **options):
    rows = [tuple(r) for r in prefix_trie.conversation_trie(df, **options).select(OUT).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(seed, n, longest, texts, hot=0.4):
    """Conversations of few texts, so that prefixes and whole conversations repeat; a share starts with one turn."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-n, 3 * n), n):
        for t in range(rng.randint(0, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randint(0, texts))) if t or rng.random() > hot else (c, 0, "user", "the hot turn"))
    return rows


@pytest.mark.parametrize("seed,n,longest,texts,turns", [(1, 60, 5, 2, 30), (2, 300, 4, 1, 50), (3, 200, 12, 0, 40), (4, 40, 40, 1, 25), (5, 500, 3, 3, 10**6)])
def test_against_all_conversations(frame, seed, n, longest, texts, turns):
    rows = made_up(seed, n, longest, texts)
    got = run(frame(rows, "conv_id long, turn long, role string, text string"), range_turns=turns)
    assert got == brute(rebuilt(rows))


def test_range_ends_by_plain_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 5, n)
        table = prefix_trie.RangeMinimum(values)
        for i in range(n):
            for bound in range(6):
                left = next(j for j in range(i, -1, -1) if j == 0 or values[j] < bound)
                right = next(j for j in range(i, n) if j == n - 1 or values[j + 1] < bound)
                assert table.left_end(np.array([i]), np.array([bound]))[0] == left
                assert table.right_end(np.array([i]), np.array([bound]), n - 1)[0] == right
            for j in range(i, n):
                assert table.least(np.array([i]), np.array([j]))[0] == values[i : j + 1].min()


def test_hard_rows(frame):
    long = "lorem ipsum " * 20_000
    rows = [(0, None, "user", "null turn first"), (0, 1, None, "x"), (0, 1, None, "x"), (0, 1, "user", None), (1, 0, None, None), (2, 0, "", ""), (21, 5, "user", long),
            (22, 5, "user", long + "end"), (None, 0, "user", "no conversation"), (None, None, None, None), (20, 0, "user", "é 😀"), (39, None, None, None), (-5, 0, "a", "b"),
            (-20, 0, "minus", "twenty"), (45, 0, "no base", "here"), (45, 1, "no base", "here")]
    for turns in (1, 100):
        assert run(frame(rows, "conv_id long, turn long, role string, text string"), range_turns=turns) == brute(rebuilt(rows))


def test_empty(frame):
    assert run(frame([], "conv_id long, turn long, role string, text string")) == set()


def test_a_third_in_one_conversation_text_is_cut_over_ranges(frame):
    """Most conversations are copies of one: no range holds them all, and the list of their numbers is the whole one."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(1000, 1100)]
    got = run(frame(rows, "conv_id long, turn long, role string, text string"), range_turns=20)
    assert got == brute(rebuilt(rows))


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(OUT)} FROM ({prefix_trie.ORACLE})").fetchall()
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert run(df) == set(want) == brute(rebuilt(rows)) and len(want) == len(set(want))
