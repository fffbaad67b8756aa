import re

from botsift.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, items, window=10):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, w[s : s + window]) for s in range(max(len(w) - window, 0) + 1)] if w else []
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=str)


def run(docs, items, **options):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in dc.contamination(docs, items, **options).collect()), key=str)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ITEMS = [(1, ITEM), (2, "short one"), (3, "Solo"), (10, "the the the the the the the the the the the the"), (4, None), (5, "..."), (6, "é ñ 中 x"),
         (None, "null item words here"), (7, ITEM), (7, ITEM), (8, "nowhere seen in any text at all, not once")]
DOCS = [(1, "x " + ITEM + " y"), (2, ITEM[:50]), (3, None), (4, ""), (5, "a short-one, solo; SOLO 9"), (6, "the " * 40), (7, "the " * 9), (None, ITEM), (None, None),
        (1, "x " + ITEM + " y"), (1, "other text, same id"), (8, "é! ñ? 中 x É ñ 中 x"), (9, "Null ITEM words here null item words"), (11, ("pad " * 500 + ITEM + " ") * 20),
        (12, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi alpha beta gamma")]


def test_hard_rows(frame):
    docs, items = frame(DOCS, "doc_id long, text string"), frame(ITEMS, "item_id long, text string")
    assert run(docs, items) == brute(DOCS, ITEMS)
    assert run(docs, items, window=4) == brute(DOCS, ITEMS, 4)


def test_shuffled_tables_give_the_same(frame, monkeypatch):
    """Beyond the bounds, by rows or by bytes, also with prefix shingles that are dealt into parts."""
    for rows, nbytes, hot in ((0, 1 << 30, 100_000), (500_000, 100, 3)):
        monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(dc, "BROADCAST_BYTES", nbytes)
        monkeypatch.setattr(dc, "HOT_ROWS", hot)
        assert run(frame(DOCS, "doc_id long, text string"), frame(ITEMS, "item_id long, text string")) == brute(DOCS, ITEMS)


def test_columns_of_any_name_stay(frame):
    docs = frame(DOCS, "doc_id long, text string")
    kept = dc.clean_rows(docs, frame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and {"__hash", "__none", "none", "part"} <= set(kept.columns)
    clean = sorted((d, t) for (d, t), hit in ((r, [x for x in brute([r], ITEMS) if x[2]]) for r in DOCS) if not hit and d is not None and t is not None)
    got = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None and r.text is not None)
    assert got == clean and all(r["__hash"] == 15 and r["_hash"] == 14 for r in kept.collect())


def test_empty(frame, empty):
    none = frame([], "item_id long, text string")
    assert run(empty, frame(ITEMS, "item_id long, text string")) == []
    assert run(frame(DOCS, "doc_id long, text string"), none) == brute(DOCS, [])


def test_clean_rows(frame):
    docs = frame(DOCS, "doc_id long, text string")
    kept = dc.clean_rows(docs, frame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    clean = sorted(((d, t) for (d, t), r in zip(DOCS, [brute([x], ITEMS)[0] for x in DOCS]) if not r[2]), key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == clean


def test_no_python_in_the_plan(frame):
    plan = dc.contamination(frame(DOCS, "doc_id long, text string"), frame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
