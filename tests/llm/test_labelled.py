import itertools
import math
import random
import zlib

import numpy as np
import pytest

from botsift.llm import labelled, quality, toxicity
from botsift.llm.labelled import training_sample
from botsift.llm.queries import op2_toxicity, op3_quality
from botsift.session import SMALL_BATCHES, small_batches
from botsift.sources.tables import read_table

SF = "/root/testdata/sf0.1"


def hits(spark, rows, label, least=None):
    """Hit rates of both labels among held-out rows."""
    joined = rows.where("held_out").join(read_table(spark, SF, "labels"), "doc_id").select("predicted", label).collect()
    rate = lambda y: sum(r.predicted == y for r in joined if r[label] == y) / max(1, sum(r[label] == y for r in joined))
    return rate(0), rate(1)


def test_toxicity_held_out(spark):
    clean, toxic = hits(spark, op2_toxicity(spark, SF), "toxic")
    assert clean > 0.99 and toxic > 0.85


def test_quality_held_out(spark):
    bad, good = hits(spark, op3_quality(spark, SF), "quality")
    assert bad > 0.9 and good > 0.97


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_hard_rows(frame, hard, empty, run):
    labels = frame([(1, 1, 1), (1, 0, 0), (7, 0, 1), (8, 1, 0), (9, None, None), (None, 1, 1), (6, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    none = frame([], "doc_id long, quality int, toxic int")
    for table in (labels, none, frame([(1, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")):
        rows = run(hard, table).collect()
        assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert run(empty, labels).collect() == []


def test_labels_of_held_out_rows_do_not_matter(frame, sf_docs):
    docs = frame(sf_docs[:200], "doc_id long, text string")
    rows = [(i, i % 3 == 0, i % 7 == 0) for i, _ in sf_docs[:200]]
    out = []
    for turn in (False, True):
        table = [(i, int(q != (turn and zlib.crc32(str(i).encode()) % 5 == 0)), int(t != (turn and zlib.crc32(str(i).encode()) % 5 == 0))) for i, q, t in rows]
        labels = frame(table, "doc_id long, quality int, toxic int")
        out.append([sorted((r.doc_id, round(r.score, 9)) for r in run(docs, labels).collect()) for run in (toxicity.toxicity, quality.quality)])
    assert out[0] == out[1]


def test_composed_machine():
    reader = toxicity.Reader(toxicity.seed_lexicon())
    kinds = lambda t: [(k, m) for _, _, found in reader.matches(t) for k, m, _ in found]
    assert kinds("An idiot wrote it.") == [("insult", "plain")]
    assert kinds("you are an IDIOT") == kinds("stupid you") == [("insult", "aimed")]
    assert kinds("you are not an idiot") == kinds("you aren't an idiot") == [("insult", "negated")]
    assert kinds("not at all, idiot") == [("insult", "plain")]
    assert kinds("he said they are idiots") == [("insult", "reported")]
    # a target counts before and behind a threat; a quoted or reported threat is reported
    for text in ("they will kill you", "I will kill you", "kill you", "we'll kill all of them", "I am going to hurt you."):
        assert kinds(text) == [("threat", "aimed")], text
    for text in ('"I will kill you", he said', 'she wrote: "I will kill you"', "he said that he will kill you"):
        assert kinds(text) == [("threat", "reported")], text
    assert kinds('"I will kill you" and nothing else') == [("threat", "aimed")]
    assert kinds('he wrote "I will kill you" and you moron') == [("threat", "reported"), ("insult", "aimed")]
    assert kinds("I will not kill you") == [("threat", "negated")]
    assert kinds("kill the lights") == [("threat", "plain")]
    assert kinds("idiotic, skilled") == []
    assert kinds("no idiot, you idiot") == [("insult", "negated"), ("insult", "aimed")]


def test_a_clause_has_one_score():
    reader = toxicity.Reader(toxicity.seed_lexicon())
    weigh = lambda t: reader.features(t) @ toxicity.prior()
    assert [c[2:4] for c in reader.clauses("you idiot, you moron, scum. Trash!")] == [("insult", "aimed"), ("insult", "plain")]
    assert weigh("you idiot") > weigh("an idiot") > weigh("no idiot") and weigh("such an idiot") > weigh("an idiot")
    assert weigh("I will kill you") > weigh("kill you") > weigh("kill the lights") and weigh("I will kill you") > weigh('"I will kill you", he said')
    # three words in one clause say less than three clauses
    assert weigh("idiot moron scum") < weigh("idiot. Moron. Scum.")


def plain_readings(symbols):
    """Every way through the five machines, each machine by itself: {(marks, weights): least cost}."""
    ways = []
    for make in toxicity.MACHINES:
        arcs, last = make()
        paths = [(0, ())]
        for x in symbols:
            paths = [(to, out + ((mark, weight, cost),)) for state, out in paths for to, mark, weight, cost in arcs.get((state, x), ())]
        ways.append([out for state, out in paths if state in last])
    found = {}
    for one in itertools.product(*ways):
        out, total = [], 0
        for i, x in enumerate(symbols):
            here = [w[i] for w in one]
            total += sum(h[2] for h in here)
            if x in toxicity.MATCHED:
                out.append((max((h[0] for h in here), key=toxicity.MARKS.index), round(math.prod(h[1] for h in here), 9)))
        found[tuple(out)] = min(total, found.get(tuple(out), 99))
    return found


def test_composition_against_plain_enumeration():
    rng, grammar = random.Random(4), toxicity.Grammar()
    strings = ["".join(s) for n in range(3) for s in itertools.product(toxicity.SYMBOLS, repeat=n)]
    strings += ["".join(rng.choice("IIHTNRMAQQBO") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    for s in strings:
        every = plain_readings(s)
        got = tuple((m, round(w, 9)) for m, w in grammar.read(s))
        assert every[got] == min(every.values()), s


def test_labelled_cases_move_the_weight_of_every_kind(frame):
    """Texts of each kind and mark, toxic or not as their mark says: every weight leaves the value of the grammar."""
    texts = {("insult", "plain"): ("an idiot", 1), ("insult", "aimed"): ("you idiot", 1), ("insult", "reported"): ("he said idiot", 0),
             ("insult", "negated"): ("no idiot", 0), ("threat", "plain"): ("kill the lights", 0), ("threat", "aimed"): ("I will kill you", 1),
             ("threat", "reported"): ('"I will kill you", he said', 0), ("threat", "negated"): ("I will not kill you", 0)}
    reader = toxicity.Reader(toxicity.seed_lexicon())
    docs, labels = [], []
    for (kind, mark), (text, toxic) in texts.items():
        assert [c[2:4] for c in reader.clauses(text)] == [(kind, mark)], text
        for _ in range(40):
            docs.append((len(docs), f"{text}. Number {len(docs)}"))
            labels.append((len(labels), toxic))
    for _ in range(1500):  # texts of the same other words
        docs.append((len(docs), f"he said no, I will not give you an apple. Number {len(docs)}"))
        labels.append((len(labels), 0))
    lexicon, weights = toxicity.fit(frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, toxic int"))
    moved = (weights - toxicity.prior())[1:].reshape(2, 4)
    for (kind, mark), (_, toxic) in texts.items():
        by = moved[toxicity.KINDS.index(kind), toxicity.MARKS.index(mark)]
        assert by > 0.05 if toxic else by < -0.05, (kind, mark, by)
    assert set(lexicon) == set(toxicity.seed_lexicon())


def test_words_of_seeds_give_no_stems(frame):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randint(4, 8)))
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() for _ in range(20)) + (f" {rng.choice(['worthless', 'trash', 'moron'])} zorb{word()}" if bad else " worth worthy Worte train more")))
        labels.append((i, int(bad)))
    lexicon, _ = toxicity.fit(frame(rows, "doc_id long, text string"), frame(labels, "doc_id long, toxic int"))
    reader = toxicity.Reader(lexicon)
    assert not [s for s in lexicon if s.endswith("*") and any(w.startswith(s[:-1]) for w in toxicity.INSULT)]
    for clean in ("worth", "worthy", "Worte", "train", "more"):
        assert reader.clauses(clean) == []


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_scores_do_not_depend_on_how_rows_are_dealt(spark, run):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    found = [sorted((r.doc_id, r.score) for r in run(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]


def test_the_sample_is_bounded_and_distinct(frame):
    docs = frame([(1, "the same row")] * 2000 + [(i, f"text {i}") for i in range(2, 400)] + [(5, "another text of five")], "doc_id long, text string")
    labels = frame([(i, i % 2) for i in range(0, 5000)] + [(7, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    for bound in (1, 50, 5000):
        rows = training_sample(docs, labels, "toxic", 5, bound).collect()
        assert len(rows) == len({(r.doc_id, r.text) for r in rows}) <= bound
        assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1, 400))
    assert len(rows) == 399 - held + (zlib.crc32(b"5") % 5 != 0) and {r.y for r in rows if r.doc_id == 3} <= {1}
    again = training_sample(docs.repartition(7), labels, "toxic", 5, 50).collect()
    assert {(r.doc_id, r.text) for r in again} == {(r.doc_id, r.text) for r in training_sample(docs, labels, "toxic", 5, 50).collect()}


@pytest.mark.parametrize("module, run", [(toxicity, toxicity.toxicity), (quality, quality.quality)])
def test_texts_are_read_in_small_batches(spark, frame, monkeypatch, module, run):
    """The sample and the scores are evaluated in small batches, scores are written by no more tasks than there are cores, and the settings come back, also after an error."""
    docs, labels = frame([(i, f"text {i}") for i in range(300)], "doc_id long, text string", 40), frame([(i, i % 2, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    kept, seen = {k: spark.conf.get(k) for k in SMALL_BATCHES}, {}

    def spied(name, f):
        def inner(*args, **options):
            seen[name] = {k: int(spark.conf.get(k)) for k in SMALL_BATCHES}
            return f(*args, **options)
        return inner

    monkeypatch.setattr(module, "training_sample", spied("sample", module.training_sample))
    monkeypatch.setattr(labelled, "materialize", spied("scores", labelled.materialize))
    rows = run(docs, labels)
    assert seen == {"sample": SMALL_BATCHES, "scores": SMALL_BATCHES} and {k: spark.conf.get(k) for k in SMALL_BATCHES} == kept
    assert len(rows.inputFiles()) <= spark.sparkContext.defaultParallelism and sorted(r.doc_id for r in rows.collect()) == list(range(300))
    smaller = {k: "7" for k in SMALL_BATCHES}
    try:
        for k, v in smaller.items():
            spark.conf.set(k, v)
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            assert {k: spark.conf.get(k) for k in SMALL_BATCHES} == smaller
            1 / 0  # noqa: B018
        assert {k: spark.conf.get(k) for k in SMALL_BATCHES} == smaller
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_clean_rows(frame, spark):
    docs = frame([(i, f"text number {i}" + (" you stupid idiot" * 3 if i % 4 == 0 else ""), i) for i in range(40)] + [(None, None, None)], "doc_id long, text string, n_chars int")
    kept = toxicity.clean_rows(docs, frame([], "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in range(40) if i % 4] + [(True, 0)]


def test_pairs_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) + rng.normal(0, 0.1, 400) > -1).astype(float)
    w = quality.fit_pairs(x, y)
    s = x @ w
    cut = quality.best_quantile(s, y)
    assert ((s >= cut) == (y > 0)).mean() > 0.95


def test_pair_loss_by_every_pair(monkeypatch):
    """Loss, gradient and curvature summed pair by pair, and a minimum that no small step improves."""
    rng = np.random.default_rng(3)
    good, bad, w = rng.normal(0.3, 1, (13, 4)), rng.normal(0, 1, (9, 4)), rng.normal(0, 1, 4)
    loss, gradient, curve = 0.0, np.zeros(4), np.zeros((4, 4))
    for g in good:
        for b in bad:
            d = g - b
            p = 1 / (1 + math.exp(d @ w))
            loss, gradient, curve = loss + math.log1p(math.exp(-(d @ w))), gradient - p * d, curve + p * (1 - p) * np.outer(d, d)
    n = len(good) * len(bad)
    for block in (1, 20, 1 << 20):
        monkeypatch.setattr(quality, "PAIR_BLOCK", block)
        got = quality._pair_sums(good, bad, w)
        assert np.allclose(got[0], loss / n) and np.allclose(got[1], gradient / n) and np.allclose(got[2], curve / n)
    x, y = np.concatenate([good, bad]), np.array([1.0] * 13 + [0.0] * 9)
    best = quality.fit_pairs(x, y, ridge=0.01)
    value = lambda v: quality._pair_sums(good, bad, v)[0] + 0.005 * float(v @ v)
    assert all(value(best) <= value(best + rng.normal(0, 0.01, 4)) for _ in range(200))


def test_quantile_by_trying_every_cut():
    rng = np.random.default_rng(5)
    for _ in range(50):
        s, y = rng.normal(0, 1, 30).round(1), rng.integers(0, 2, 30).astype(float)
        if y.min() == y.max():
            continue
        rate = lambda c: (s[y > 0] >= c).mean() + (s[y == 0] < c).mean()
        best = max(rate(c) for c in [*s, s.max() + 1])
        assert rate(quality.best_quantile(s, y)) >= best - 0.15 - 2 / min(y.sum(), (1 - y).sum())


def test_scores_are_the_strengths_cut_at_the_quantile(frame):
    """The registered scores against the definition on a small table: the same fit by hand, the same threshold."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["word", "Other", "BIG!!", "x1"] if i % 3 else ["@@", "##", "$$$", "zz"]) for _ in range(rng.randint(5, 60)))) for i in range(120)]
    labels = [(i, int(i % 3 > 0)) for i in range(120)]
    got = {r.doc_id: (r.score, r.predicted) for r in quality.quality(frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, quality int")).collect()}
    train = sorted((q, quality.numbers(t)) for (i, t), (_, q) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5)
    x, y = quality.expand(np.array([v for _, v in train])), np.array([float(q) for q, _ in train])
    mean, width = x.mean(0), x.std(0) + 1e-9
    x = np.clip((x - mean) / width, -8, 8)
    w = quality.fit_pairs(x, y)
    cut, unit = quality.best_quantile(x @ w, y), (x @ w).std() / 2 + 1e-9
    for i, t in docs:
        z = (np.clip((quality.expand(np.array([quality.numbers(t)]))[0] - mean) / width, -8, 8) @ w - cut) / unit
        assert got[i][0] == pytest.approx(0.3 * math.exp(z) / (0.7 + 0.3 * math.exp(z)), abs=1e-6) and got[i][1] == int(got[i][0] >= 0.3)
    assert sum(got[i][1] == q for i, q in labels) >= 114
