"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is what stands between ends of sentences or lines. Its words and marks become symbols: insult, threat verb, target,
negation, verb of saying, modal or future, intensifier, quote mark, break, other. Five weighted transducers read them:

* insult: an insult counts more behind an intensifier,
* threat: a threat verb is meant behind a modal or future a few words before it, and counts little without one,
* target: a match is aimed if a target stands before it, or within the next few words (the machine guesses that one will come,
  and the guess has to come true),
* negation: what stands in the scope of a negation,
* reported speech: what follows a verb of saying, or stands in quotes that such a verb introduces or closes.

They are composed into one machine (all read the same symbols, weights multiplied). Where guesses leave several ways through
a clause, the one that explains most counts. A clause has one score: its strongest match, with a quarter of each further one, under the
kind and mark of the strongest. The scores of a text's clauses are summed by kind and mark; a logistic loss fitted on labelled rows weighs
these sums, held by a ridge near the weights of the grammar, so that kinds which the labels don't show keep these.

Insults are seed words and stems that a greedy cover of the toxic rows picks: a stem (a word or its first
four to nine letters) has to stand almost only in toxic rows and to explain rows that the seeds and the chosen stems
don't yet explain often enough. Words of the seeds give no stems, and words of one text that is copied many times add nothing.

Learning uses at most ``MAX_LABELLED`` rows (see labelled.py). Scoring reads every whole text: an automaton of
the stems finds the places, and the clauses around them are read by the machine.

Defined results: empty and null texts score the machine's value of no match; without labels of both
kinds the seeds and grammar weights stand alone; each repeated row gives a row; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.common import id_and_text, release, remainder, steps
from botsift.llm.labelled import MAX_LABELLED, evaluated, fit_logistic, training_sample
from botsift.session import small_batches

MODULUS = 5
# Fixed words of the grammar, by symbol.
INSULT = "idiot idiots stupid moron morons loser losers pathetic worthless scum trash clown disgusting dumb fool".split()
THREAT = "kill hurt destroy beat smash shoot stab töten verletzen schlagen tuer frapper détruire matar golpear".split()
TARGET = ("you your yours u he she they him her them these those people everyone du dich dir ihr euch sie "
          "tu toi vous ils elles eux tú te usted ustedes ellos ellas").split()
NEGATION = "not no never none neither nor without 't nicht kein keine nie ohne pas jamais non sans nunca sin jamás".split()
REPORT = "said says say wrote writes claimed claims called calls quoted quotes sagte sagt schrieb dit disait écrit dijo dice escribió".split()
MODAL = "will shall gonna going must should 'll werde wirst wird werden vais vas va allons voy vamos".split()
INTENSIFIER = "such total complete utter absolute really very völlig ganz tellement très tan muy".split()
#: insult, threat verb, target, negation, verb of saying, modal, intensifier, quote mark, break, other
SYMBOLS = "IHTNRMAQBO"
MATCHED = "IH"
KINDS = ("insult", "threat")
#: of several marks of a match the last in this order counts
MARKS = ("plain", "aimed", "reported", "negated")
#: words that a negation reaches, between a modal and its verb, up to a target behind a match, and from a quote to its verb of saying
NEGATED, MEANT, AHEAD, CLOSING = 3, 4, 3, 3
#: weights of the arcs
INTENSE, MEANT_THREAT, BARE_THREAT, AIMED, AIMED_THREAT, REPORTED, DENIED = 1.25, 1.5, 0.4, 1.3, 1.8, 0.4, 0.25
#: what a further match adds to its clause
FURTHER = 0.25
BASE, UNIT = -4.0, 1.5
#: a stem needs so many toxic rows, and so small a share of the others
LEAST_ROWS, MOST_OTHER, COVER = 4, 0.06, 6
#: rows that a stem has to explain for each other row it stands in
PRICE = 4
BEGINNINGS = range(4, 10)
#: counts that a task holds before it passes them on
HELD_STEMS = 100_000
#: a word, the end of a contraction, a quote mark or a break
_TOKEN = re.compile(r"[^\W\d_]+|['’](?:ll|t)\b|[\"«»“”„]|[,;:()\[\]]")
_WORD = re.compile(r"[^\W\d_]+")
ENDS = frozenset(".!?|\n\r")


# --- transducers: {(state, symbol): ways}, a way being (state, mark, weight, cost); a missing entry is a dead end --------------
# The cost of a way is 1 where a match is left unexplained; it only chooses among ways.

def insult_machine() -> tuple[dict, set]:
    """State: words that an intensifier still reaches ("such an idiot")."""
    arcs = {}
    for state in range(3):
        for x in SYMBOLS:
            after = 2 if x == "A" else 0 if x in "BQ" else max(0, state - 1)
            arcs[state, x] = [(after, "plain", INTENSE if x == "I" and state else 1.0, 0)]
    return arcs, {0, 1, 2}


def threat_machine(reach: int = MEANT) -> tuple[dict, set]:
    """State: words that a modal still reaches."""
    arcs = {}
    for state in range(reach + 1):
        for x in SYMBOLS:
            after = reach if x == "M" else max(0, state - 1)
            weight = (MEANT_THREAT if state else BARE_THREAT) if x == "H" else 1.0
            arcs[state, x] = [(0 if x == "H" else after, "plain", weight, 0)]
    return arcs, set(range(reach + 1))


def target_machine(ahead: int = AHEAD) -> tuple[dict, set]:
    """State: 0 none yet, 1 a target came before; 2 and up: one is promised within state - 1 words."""
    arcs = {}
    for state in range(ahead + 2):
        for x in SYMBOLS:
            if x == "T":
                arcs[state, x] = [(1, "plain", 1.0, 0)]
            elif x in MATCHED:
                weight = AIMED_THREAT if x == "H" else AIMED
                if state == 1:
                    arcs[state, x] = [(1, "aimed", weight, 0)]
                elif state == 0:
                    arcs[state, x] = [(0, "plain", 1.0, 1), (ahead + 1, "aimed", weight, 0)]
                elif state > 2:
                    arcs[state, x] = [(state - 1, "aimed", weight, 0)]
            elif state < 2:
                arcs[state, x] = [(state, "plain", 1.0, 0)]
            elif state > 2 and x not in "QB":
                arcs[state, x] = [(state - 1, "plain", 1.0, 0)]
    return arcs, {0, 1}


def negation_machine(scope: int = NEGATED) -> tuple[dict, set]:
    """State: words that a negation still reaches; a break ends it."""
    arcs = {}
    for state in range(scope + 1):
        for x in SYMBOLS:
            denied = x in MATCHED and state > 0
            after = scope if x == "N" else 0 if x in "BQ" else max(0, state - 1)
            arcs[state, x] = [(after, "negated" if denied else "plain", DENIED if denied else 1.0, 0)]
    return arcs, set(range(scope + 1))


def report_machine(closing: int = CLOSING) -> tuple[dict, set]:
    """State: 0 none, 1 a verb of saying came before, 2 in its quotes; 3 in quotes for which a verb of saying is promised, 4 and
    up: the quotes are closed and it has to come within state - 3 words."""
    arcs = {}
    for state in range(closing + 4):
        for x in SYMBOLS:
            told = [(state, "reported", REPORTED, 0)]
            stay = [(state, "plain", 1.0, 0)]
            if state == 0:
                ways = ([(1, "plain", 1.0, 0)] if x == "R" else [(0, "plain", 1.0, 0), (3, "plain", 1.0, 0)] if x == "Q"
                        else [(0, "plain", 1.0, 1)] if x in MATCHED else stay)
            elif state == 1:
                ways = [(2, "plain", 1.0, 0)] if x == "Q" else told if x in MATCHED else stay
            elif state == 2:
                ways = [(0, "plain", 1.0, 0)] if x == "Q" else told if x in MATCHED else stay
            elif state == 3:
                ways = [(closing + 3, "plain", 1.0, 0)] if x == "Q" else told if x in MATCHED else stay
            elif x == "R":
                ways = [(1, "plain", 1.0, 0)]
            elif x == "B":
                ways = stay
            else:
                ways = [(state - 1, "plain", 1.0, 0)] if state > 4 and x not in MATCHED + "Q" else []
            if ways:
                arcs[state, x] = ways
    return arcs, {0, 1, 2}


MACHINES = (insult_machine, threat_machine, target_machine, negation_machine, report_machine)


class Grammar:
    """The composed machine: states are one state of each, arcs are put together when they are first needed."""

    def __init__(self, machines=None):
        self.parts = [m() for m in MACHINES] if machines is None else machines
        self.start = (0,) * len(self.parts)
        self.known: dict[tuple, list] = {}

    def ways(self, state: tuple, symbol: str) -> list[tuple]:
        found = self.known.get((state, symbol))
        if found is None:
            found = []
            for one in product(*[arcs.get((s, symbol), ()) for (arcs, _), s in zip(self.parts, state)]):
                mark = max((w[1] for w in one), key=MARKS.index)
                weight, cost = 1.0, 0
                for w in one:
                    weight, cost = weight * w[2], cost + w[3]
                found.append((tuple(w[0] for w in one), mark, weight, cost))
            self.known[state, symbol] = found
        return found

    def accepts(self, state: tuple) -> bool:
        return all(s in last for (_, last), s in zip(self.parts, state))

    def read(self, symbols: str) -> list[tuple[str, float]]:
        """(mark, weight) of every insult and threat verb of a clause, on the way of least cost; of equal ways the first."""
        now = {self.start: (0, None)}
        for x in symbols:
            after: dict[tuple, tuple] = {}
            for state, (cost, path) in now.items():
                for to, mark, weight, more in self.ways(state, x):
                    if to not in after or cost + more < after[to][0]:
                        after[to] = (cost + more, (path, mark, weight) if x in MATCHED else path)
            now = after
        _, path = min((v for s, v in now.items() if self.accepts(s)), key=lambda v: v[0])
        out = []
        while path is not None:
            path, mark, weight = path
            out.append((mark, weight))
        return out[::-1]


# --- lexicon --------------------------------------------------------------------------------

def stems_of(word: str) -> list[str]:
    """The word itself and its beginnings, which are written with a star."""
    return [word] + [f"{word[:k]}*" for k in BEGINNINGS if len(word) > k]


def seed_lexicon() -> dict[str, tuple[str, float]]:
    return {w: ("I", 1.0) for w in INSULT} | {w: ("H", 1.0) for w in THREAT}


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[str, float]]:
    """Seeds and the stems of the greedy cover, each with its symbol and weight (log odds over 4, up to 2)."""

    lexicon = seed_lexicon()
    seeds = frozenset(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Counter(), Counter()

        def close():
            both = list(rows[0].keys() | rows[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([rows[1][s] for s in both], pa.int64()), pa.array([rows[0][s] for s in both], pa.int64())],
                names=["stem", "toxic", "other"])
            rows[0].clear()
            rows[1].clear()

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                words = set(_WORD.findall(text.as_py().lower()))
                rows[1 if y else 0].update({s for w in words for s in ([w] if w in seeds else stems_of(w))})
                if len(rows[0]) + len(rows[1]) > HELD_STEMS:
                    yield from close()
        yield from close()
        release()

    texts = sample.groupBy("text").agg(F.max("y").alias("y"))
    sizes = texts.agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)), F.sum(F.when(F.col("y") > 0, 0).otherwise(1))).first()
    toxic, other = sizes[0] or 0, sizes[1] or 0
    if not toxic or not other:
        return lexicon
    counts = texts.mapInArrow(count, "stem string, toxic long, other long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    rate = (F.col("toxic") / F.lit(toxic)) / ((F.col("other") + 0.5) / F.lit(other + 1.0))
    rare = F.col("other") <= F.col("toxic") * F.lit(MOST_OTHER)
    kept = counts.where((F.col("toxic") >= LEAST_ROWS) & rare | F.col("stem").isin(list(lexicon))).withColumn("rate", rate)
    kept = {r["stem"]: (r["toxic"], r["other"], r["rate"]) for r in kept.collect()}  # of the sample's toxic rows, each in LEAST_ROWS of them
    for seed in list(lexicon):  # a seed that the labels speak against is dropped
        t, o, r = kept.get(seed, (0, 0, 0))
        if t + o >= 5 and r < 2:
            del lexicon[seed]
    names = sorted(s for s, (t, o, _) in kept.items() if t >= LEAST_ROWS and o <= t * MOST_OTHER)

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {s: i for i, s in enumerate(names)}
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                words = set(_WORD.findall(t.lower()))
                found.append(sorted({number[s] for w in words for s in ([w] if w in seeds else stems_of(w)) if s in number}))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["stems"])

    rows = [r[0] for r in texts.where("y > 0").mapInArrow(holds, "stems array<int>").collect()]  # at most the sample's toxic rows
    by_stem: dict[int, list[int]] = {}
    for i, held in enumerate(rows):
        for s in held:
            by_stem.setdefault(s, []).append(i)
    covered = np.zeros(len(rows), np.int64)
    at = {s: np.array(v) for s, v in by_stem.items()}
    for s in [s for s in at if names[s] in lexicon]:  # rows of seeds are explained by them
        covered[at.pop(s)] += COVER
    while at:
        gain = {s: int((covered[v] < COVER).sum()) - PRICE * kept[names[s]][1] for s, v in at.items()}
        at = {s: v for s, v in at.items() if gain[s] >= max(LEAST_ROWS, toxic // 250)}
        if not at:
            break
        # of equal gains the longer stem: it says more
        best = max(at, key=lambda s: (gain[s], len(names[s]), names[s]))
        covered[at.pop(best)] += 1
        stem = names[best]
        lexicon[stem] = (lexicon.get(stem, ("I", 0))[0], min(2.0, float(np.log(kept[stem][2])) / 4))
    return lexicon


# --- reading texts --------------------------------------------------------------------------

class Reader:
    """Finds the clauses with a listed stem and reads them with the machine."""

    def __init__(self, lexicon: dict[str, tuple[str, float]]):
        import ahocorasick

        self.words = {s: v for s, v in lexicon.items() if not s.endswith("*")}
        self.starts = {s[:-1]: v for s, v in lexicon.items() if s.endswith("*")}
        lists = (("T", TARGET), ("N", NEGATION), ("R", REPORT), ("M", MODAL), ("A", INTENSIFIER), ("Q", '"«»“”„'), ("B", ",;:()[]"))
        self.symbols = {w: x for x, ws in lists for w in ws}
        self.grammar = Grammar()
        self.places = ahocorasick.Automaton()
        for s in {*self.words, *self.starts}:
            self.places.add_word(s, len(s))
        if lexicon:
            self.places.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        best = self.words.get(word, ("", 0.0))
        for k in BEGINNINGS:
            found = self.starts.get(word[:k]) if len(word) > k else None
            if found and found[1] > best[1]:
                best = found
        return best if best[0] else (self.symbols.get(word.replace("’", "'"), "O"), 0.0)

    def clause(self, text: str) -> list[tuple[str, str, float]]:
        """(kind, mark, weight) of every match in a clause, in order."""
        read = [self.symbol(w) for w in _TOKEN.findall(text)]
        kinds = [(KINDS[MATCHED.index(x)], w) for x, w in read if x in MATCHED]
        marks = self.grammar.read("".join(x for x, _ in read)) if kinds else []
        return [(kind, mark, lexical * arc) for (kind, lexical), (mark, arc) in zip(kinds, marks)]

    def matches(self, text: str) -> Iterator[tuple[int, int, list[tuple[str, str, float]]]]:
        """(start, stop, matches) of every clause of a whole text that has any."""
        low, done = text.lower(), 0
        if not self.words and not self.starts:
            return
        for end, length in self.places.iter(low):
            start = end - length + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            before = start
            while before > done and low[before - 1] not in ENDS:
                before -= 1
            stop = end + 1
            while stop < len(low) and low[stop] not in ENDS:
                stop += 1
            done = stop
            found = self.clause(low[before:stop])
            if found:
                yield before, stop, found

    def clauses(self, text: str) -> list[tuple[int, int, str, str, float]]:
        """(start, stop, kind, mark, score): the matched clauses of a whole text with their scores."""
        out = []
        for start, stop, found in self.matches(text):
            kind, mark, most = max(found, key=lambda m: m[2])
            out.append((start, stop, kind, mark, most + FURTHER * (sum(m[2] for m in found) - most)))
        return out

    def features(self, text: str) -> np.ndarray:
        """A one, then for each kind and mark the damped sum of the scores of its clauses."""
        sums = np.zeros((len(KINDS), len(MARKS)))
        for _, _, kind, mark, score in self.clauses(text):
            sums[KINDS.index(kind), MARKS.index(mark)] += score
        return np.concatenate([[1.0], np.log1p(sums).ravel() * UNIT * 2])


def prior() -> np.ndarray:
    """The weights of the grammar alone."""
    return np.concatenate([[BASE], np.full(len(KINDS) * len(MARKS), UNIT)])


def features_of(rows: DataFrame, reader_of: dict, keep: str) -> DataFrame:
    """(``keep`` column, x): features of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(reader_of)
        for batch in batches:
            for part in steps(batch, "text"):
                x = [reader.features(t).tolist() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(keep), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    kind = dict(rows.dtypes)[keep]
    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> tuple[dict, np.ndarray]:
    """The lexicon and the weights of the kinds."""
    with small_batches(docs.sparkSession):
        sample = training_sample(docs, labels, "toxic", MODULUS, bound)
        lexicon = learn_lexicon(sample)
        rows = sorted(features_of(sample, lexicon, "y").collect(), key=lambda r: (r["y"], r["x"]))  # at most ``bound`` rows of nine numbers
    if len({r["y"] > 0 for r in rows}) < 2:
        return lexicon, prior()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["y"] > 0) for r in rows])
    return lexicon, fit_logistic(x, y, prior(), ridge=1.0)


def score(docs: DataFrame, lexicon: dict, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, n_matches) of every whole text."""
    w = weights.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, v = Reader(lexicon), np.array(w)
        for batch in batches:
            for part in steps(batch, "text"):
                x = [reader.features(t) for t in part.column("text").to_pylist()]
                z = np.clip((np.stack(x) * v).sum(1), -35, 35)  # row by row: a product of matrices would round by the size of the batch
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(1 / (1 + np.exp(-z))), pa.array([int((r[1:] > 0).sum()) for r in x], pa.int32())],
                    names=["doc_id", "score", "n_kinds"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, n_kinds int")


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_kinds) of every document; ``learn_from`` gives the texts of
    the labels where these aren't in ``docs``."""
    lexicon, weights = fit(docs if learn_from is None else learn_from, labels, bound)
    out = evaluated(score(docs, lexicon, weights), "toxicity-scores")
    return out.select("doc_id", (remainder("doc_id", MODULUS) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_kinds")


def clean_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) whose score is under one half."""
    lexicon, weights = fit(docs, labels, bound)
    w = weights.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, v = Reader(lexicon), np.array(w)
        for batch in batches:
            for part in steps(batch, "text"):
                texts = part.column(part.schema.get_field_index("text"))
                yield part.filter(pa.array([float((reader.features(t.as_py() or "") * v).sum()) < 0 for t in texts], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
