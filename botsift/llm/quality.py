"""Quality by Bradley-Terry pairwise ranking.

Each text gives a few numbers about its words, signs, case, lines and repetition. Every labelled row of label 1 is preferred to every
one of label 0; the logistic loss on the difference of their numbers, summed over all these pairs in blocks, gives the weights, and the weighted sum is the document's strength. The strength is cut at the quantile of the labelled strengths
that parts the labels best (mean of both hit rates; the middle of equally good quantiles), and mapped to 0..1
so that this quantile has score ``THRESHOLD``.

Learning uses at most ``MAX_LABELLED`` rows, in an order of their own, so a score depends on the table alone, not on how it is
dealt; scoring reads every whole text.

Defined results: empty and null texts have all numbers 0 and are scored like any text; without labels of both kinds
every score is the share of label 1 (0.5 without labels); each repeated row gives a row; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.common import id_and_text, remainder, steps
from botsift.llm.labelled import MAX_LABELLED, evaluated, training_sample
from botsift.session import small_batches

MODULUS = 5
THRESHOLD = 0.3
#: pairs that are looked at together
PAIR_BLOCK = 1 << 20
NAMES = ("words", "word_length", "distinct", "doubled", "top_word", "upper_words", "ending_signs", "odd_signs", "bars", "digits",
         "sentence_words", "line_words", "repeated_lines", "other_letters", "marked_words")
_LINE = re.compile(r"[^\n]+")


def numbers(text: str) -> list[float]:
    """What the ranking knows of a text, in the order of NAMES."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = len(text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    doubled = sum(map(str.__eq__, words, words[1:]))
    upper = sum([w.isupper() and len(w) > 2 for w in words])
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ascii_only = raw[raw < 128]
    per = np.bincount(ascii_only, minlength=128)
    letters = per[65:91].sum() + per[97:123].sum()
    ends = per[33] + per[63]
    odd = per[[35, 36, 37, 38, 42, 64, 94, 126, 60, 62, 61, 43]].sum()
    lines = _LINE.findall(text)
    marked = sum([not w[-1].isalnum() and len(w) > 2 and not w[-2].isalnum() for w in words])
    return [
        float(np.log1p(n)), chars / n, len(counts) / n, doubled / n, max(counts.values()) / n, upper / n, float(ends) / n, float(odd) / n,
        float(per[124]) / n, float(per[48:58].sum()) / n, float(np.log1p(n / (1 + per[46]))), float(np.log1p(n / len(lines) if lines else n)),
        1 - len(set(lines)) / len(lines) if lines else 0.0, 1 - float(letters) / chars, marked / n,
    ]


def described(rows: DataFrame, keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                x = [numbers(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(keep), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    kind = dict(rows.dtypes)[keep]
    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<double>")


def expand(x: np.ndarray) -> np.ndarray:
    """The numbers and their squares and square roots, so that a strength needn't grow with a number."""
    return np.concatenate([x, x**2, np.sqrt(np.abs(x))], 1)


def _pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of the mean logistic loss of (good - bad) @ w over all pairs."""
    up, down = good @ w, bad @ w
    loss, pulled, pushed = 0.0, np.zeros(len(good)), np.zeros(len(bad))
    steep, flat, mixed = np.zeros(len(good)), np.zeros(len(bad)), np.zeros((len(w), len(w)))
    rows = max(1, PAIR_BLOCK // len(bad))
    for a in range(0, len(good), rows):
        z = up[a : a + rows, None] - down[None, :]
        loss += float(np.logaddexp(0, -z).sum())
        p = 1 / (1 + np.exp(np.clip(z, -35, 35)))          # chance of the wrong order
        pulled[a : a + rows] += p.sum(1)
        pushed += p.sum(0)
        p *= 1 - p
        steep[a : a + rows] += p.sum(1)
        flat += p.sum(0)
        mixed += good[a : a + rows].T @ (p @ bad)
    n = len(good) * len(bad)
    gradient = bad.T @ pushed - good.T @ pulled
    curve = (good * steep[:, None]).T @ good + (bad * flat[:, None]).T @ bad - mixed - mixed.T
    return loss / n, gradient / n, curve / n


def fit_pairs(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 40) -> np.ndarray:
    """Bradley-Terry weights: the mean logistic loss over all pairs of either label, by damped Newton steps."""
    good, bad = x[y > 0], x[y == 0]
    w = np.zeros(x.shape[1])
    loss, gradient, curve = _pair_sums(good, bad, w)
    now = loss
    for _ in range(steps):
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), gradient + ridge * w)
        rate = 1.0
        while rate > 1e-4:
            then = w - rate * step
            loss, gradient, curve = _pair_sums(good, bad, then)
            if loss + 0.5 * ridge * float(then @ then) <= now:
                break
            rate /= 2
        else:
            break
        moved, now, w = now - (loss + 0.5 * ridge * float(then @ then)), loss + 0.5 * ridge * float(then @ then), then
        if moved < 1e-9 * (1 + abs(now)):
            break
    return w


def best_quantile(strength: np.ndarray, y: np.ndarray) -> float:
    """The strength at the quantile that parts the labels best."""
    order = np.argsort(strength, kind="stable")
    s, t = strength[order], y[order]
    low, high = np.cumsum(t == 0), np.cumsum(t > 0)
    value = low / max(1, low[-1]) + 1 - high / max(1, high[-1])
    best = np.flatnonzero(value >= value.max() - 1e-12)
    level = (best[len(best) // 2] + 0.5) / len(s)
    at = int(level * len(s))
    return float((s[at] + s[min(at + 1, len(s) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> dict:
    """Scaling, weights, cut and width of the ranking."""
    with small_batches(docs.sparkSession):
        sample = training_sample(docs, labels, "quality", MODULUS, bound)
        rows = sorted(described(sample, "y").collect(), key=lambda r: (r["y"], r["x"]))  # at most ``bound`` rows of fifteen numbers
    y = np.array([float(r["y"] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.5}
    x = expand(np.array([r["x"] for r in rows]))
    mean, width = x.mean(0), x.std(0) + 1e-9
    x = np.clip((x - mean) / width, -8, 8)
    w = fit_pairs(x, y)
    strength = x @ w
    return {"mean": mean, "width": width, "w": w, "cut": best_quantile(strength, y), "unit": float(strength.std()) / 2 + 1e-9}


def strengths(model: dict, x: np.ndarray) -> np.ndarray:
    # row by row: a product of matrices would round by the size of the batch
    return (np.clip((expand(x) - model["mean"]) / model["width"], -8, 8) * model["w"]).sum(1)


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """0..1, THRESHOLD at the cut."""
    if "w" not in model:
        return np.full(len(x), model["share"])
    z = (strengths(model, x) - model["cut"]) / model["unit"]
    out = 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -35, 35)))
    return np.where((z >= 0) & (out < THRESHOLD), THRESHOLD, out)


def quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                x = np.array([numbers(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(model, x))], names=["doc_id", "score"])

    out = evaluated(id_and_text(docs).mapInArrow(run, "doc_id long, score double"), "quality-scores")
    return out.select("doc_id", (remainder("doc_id", MODULUS) == 0).alias("held_out"), "score",
                      (F.col("score") >= F.lit(THRESHOLD)).cast("int").alias("predicted"))
