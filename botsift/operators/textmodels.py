"""Text scorers trained and applied by Spark (G6, M6 and the fixed-coefficient style scorer).

Naive Bayes over term occurrences, fitted on the training split:

    weight(t) = ln((c1(t)+1)/(T1+V)) - ln((c0(t)+1)/(T0+V))
    bias      = ln(n1/n0)                       (posts per class)
    z         = bias + sum of weight over the post's term occurrences (unseen terms add 0)
    p         = sigmoid(z)                      (overflow-safe)

c = occurrences of t in the class, T = all occurrences in the class, V = distinct training terms.
The style scorer needs no training: z = (length(text) - 250) / 100.

Fitting is one explode + groupBy(term) (map-side combined); the term table is materialised in the
shared folder and its row count kept, so scoring can decide to broadcast it on a checked size.
Scoring all models is ONE pass over the posts: the terms of every model (tagged with a small model
index) come out of one explode, are joined to the union of the term tables and summed per post.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.config import DEFAULT_PROFILE, Profile
from botsift.functions.numeric import safe_sigmoid
from botsift.functions.terms import explode_terms
from botsift.operators.joins import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, ROW_OVERHEAD_BYTES, bitmap_blocks, hot_and_tail, join_terms, key_bitmap
from botsift.operators.rank import by_row
from botsift.session import materialize
from botsift.sources.rows import ROW

# Fixed values of the style scorer.
STYLE_CENTER, STYLE_SCALE = 250.0, 100.0


@dataclass
class Lookup:
    """The term tables of several models as :func:`score_models` joins them: (m, term, weight, n), ``m`` the model's place in
    ``names``, the most frequent terms, the others, and the bitmap of the others with its number of blocks."""
    names: tuple[str, ...]
    bounds: tuple[int, int]
    hot: DataFrame | None = field(repr=False)
    tail: DataFrame | None = field(repr=False)
    bitmap: tuple[DataFrame, int] | None = field(repr=False)


@dataclass
class TextModel:
    name: str
    kind: str                       # "nb" and "lr" (tables of terms), "style", or one that scores row by row: "head", "external"
    terms: str | None = None        # "word" / "bigram" / "trigram" for a table of terms
    bias: float = 0.0
    weights: DataFrame | None = field(default=None, repr=False)   # (term, weight, n = occurrences)
    n_terms: int = 0
    term_bytes: int | None = None   # summed UTF-8 length of the terms (None: not recorded)
    profile: Profile = DEFAULT_PROFILE
    source: DataFrame | None = field(default=None, repr=False)   # shared (model, term, c1, c0) table
    totals: tuple | None = None                                    # (T1, T0, V) of this model
    table: DataFrame | None = field(default=None, repr=False)    # shared (model, term, weight, n) table, see prepare()
    lookup: Lookup | None = field(default=None, repr=False)      # the cut of that table, see prepare()
    apply: Callable[[DataFrame, str], DataFrame] | None = field(default=None, repr=False)  # adds the named column
    inputs: tuple[str, ...] = ()                                   # columns besides the text that ``apply`` reads
    fitted: object = field(default=None, repr=False)             # what a row-by-row model is stored from


#: kinds that are a bias and a table of term weights
TERM_KINDS = ("nb", "lr")


def style_model(name: str = "style", profile: Profile = DEFAULT_PROFILE) -> TextModel:
    return TextModel(name=name, kind="style", profile=profile)


def _model_name(specs, names_extra=()) -> "F.Column":
    """Position ``m`` back to the model name (on aggregated rows only)."""
    return F.element_at(F.array(*[F.lit(n) for n, _ in specs], *[F.lit(n) for n in names_extra]),
                        F.col("m") + 1)


# pseudo-term counted once per post, so that posts per class come out of the same pass
_POSTS = "__posts__"


def term_counts(train: DataFrame, specs, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(model, term, c1, c0): occurrences per class for every model in ONE pass over the training
    rows, plus one (__posts__, '') row holding the number of posts per class. Partial aggregation
    runs before the shuffle, so a stop word costs one row per task."""
    posts = train.select(F.col(label_col).alias("_y"), text_col)
    ex = explode_terms(posts, text_col, [k for _, k in specs], ["_y"], per_text=True).filter(F.col("term").isNotNull())
    counts = ex.groupBy("m", "term").agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("bigint").alias("c1"),
        F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).cast("bigint").alias("c0"),
    )
    return counts.select(_model_name(specs, [_POSTS]).alias("model"), "term", "c1", "c0")


def _weight(t1: int, t0: int, v: int):
    return (F.log((F.col("c1") + 1) / F.lit(float(t1 + v)))
            - F.log((F.col("c0") + 1) / F.lit(float(t0 + v))))


def fit_naive_bayes_many(train: DataFrame, specs, text_col: str = "text", label_col: str = "label",
                         profile: Profile = DEFAULT_PROFILE) -> list[TextModel]:
    """Fit several naive-Bayes models (``specs`` = [(name, term kind)]) with one scan of ``train``.
    The count table is materialised once in the shared folder; per-model totals are a few rows."""
    specs = list(specs)
    if not specs:
        return []
    counts = materialize(term_counts(train, specs, text_col, label_col), "nb-counts")
    tots = {r["model"]: r for r in counts.groupBy("model").agg(
        F.sum("c1").alias("t1"), F.sum("c0").alias("t0"), F.count(F.lit(1)).alias("v"),
        F.sum(F.octet_length("term")).alias("b")).collect()}
    posts = tots.get(_POSTS)
    n1, n0 = (int(posts["t1"]), int(posts["t0"])) if posts else (0, 0)
    if n1 == 0 or n0 == 0:
        raise ValueError(f"naive Bayes needs both classes in the training data, got {n1} / {n0} posts")
    table = counts.filter(F.col("model") != _POSTS)
    out = []
    for name, kind in specs:
        r = tots.get(name)
        t1, t0, v = (int(r["t1"]), int(r["t0"]), int(r["v"])) if r else (0, 0, 0)
        weights = table.filter(F.col("model") == name).select(
            "term", _weight(t1, t0, v).alias("weight"), (F.col("c1") + F.col("c0")).alias("n"))
        out.append(TextModel(name=name, kind="nb", terms=kind, bias=math.log(n1 / n0), weights=weights,
                             n_terms=v, term_bytes=int(r["b"] or 0) if r else 0, profile=profile,
                             source=table, totals=(t1, t0, v)))
    return out


def fit_naive_bayes(train: DataFrame, kind: str, name: str | None = None, text_col: str = "text",
                    label_col: str = "label", profile: Profile = DEFAULT_PROFILE) -> TextModel:
    return fit_naive_bayes_many(train, [(name or f"nb_{kind}", kind)], text_col, label_col, profile)[0]


def weight_table(nb: list[TextModel]) -> DataFrame:
    """(model, term, weight) for several models: one scan with a per-model expression when they
    were fitted together (one shared count table), else a union of their own tables."""
    if nb[0].table is not None and all(m.table is nb[0].table for m in nb):
        return nb[0].table.filter(F.col("model").isin([m.name for m in nb]))
    src = nb[0].source
    if src is not None and all(m.source is src and m.totals for m in nb):
        w = None
        for m in nb:
            w = (F.when(F.col("model") == m.name, _weight(*m.totals)) if w is None
                 else w.when(F.col("model") == m.name, _weight(*m.totals)))
        return src.filter(F.col("model").isin([m.name for m in nb])).select(
            "model", "term", w.alias("weight"), (F.col("c1") + F.col("c0")).alias("n"))
    return reduce(lambda a, b: a.unionByName(b),
                  [m.weights.select(F.lit(m.name).alias("model"), "term", "weight", "n") for m in nb])


def lookup_of(nb: list[TextModel], max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> Lookup:
    """What is broadcast of the models' terms, and what is joined by shuffle."""
    # the term table keyed by the models' positions (an int instead of a name in the join key)
    idx = reduce(lambda acc, i: acc.when(F.col("model") == nb[i].name, F.lit(i)), range(1, len(nb)),
                 F.when(F.col("model") == nb[0].name, F.lit(0)))
    table = weight_table(nb).select(idx.alias("m"), "term", "weight", "n")
    known = all(m.term_bytes is not None for m in nb)
    rows = sum(m.n_terms for m in nb)
    total_bytes = sum(m.term_bytes for m in nb) + ROW_OVERHEAD_BYTES * rows if known else None
    hot, tail = hot_and_tail(table, "term", "n", max_rows, max_bytes, rows, total_bytes)
    blocks = bitmap_blocks(rows, max(1, max_bytes // 4))
    bitmap = (key_bitmap(tail, ["m", "term"], blocks), blocks) if tail is not None else None
    return Lookup(tuple(m.name for m in nb), (max_rows, max_bytes), hot, tail, bitmap)


def prepare(models: list[TextModel]) -> list[TextModel]:
    """The models with the cut of their weight table written, as it is joined, and the bitmap of its rare terms, for plans that are run
    many times: each reads the few most frequent terms and the others, and computes no weight again."""
    nb = [m for m in models if m.kind in TERM_KINDS]
    if not nb:
        return models
    if any(m.term_bytes is None for m in nb):
        table = materialize(weight_table(nb), "weights")
        sizes = {r["model"]: r["b"] for r in table.groupBy("model").agg(F.sum(F.octet_length("term")).alias("b")).collect()}
        nb = [replace(m, table=table, term_bytes=int(sizes.get(m.name) or 0)) for m in nb]
    lookup = lookup_of(nb)
    if lookup.hot is not None:
        lookup.hot = materialize(lookup.hot.select("m", "term", "weight"), "hot-terms")
    if lookup.tail is not None:
        lookup.tail = materialize(lookup.tail.select("m", "term", "weight"), "other-terms")
        blocks = lookup.bitmap[1]
        lookup.bitmap = (materialize(key_bitmap(lookup.tail, ["m", "term"], blocks), "term-bitmap"), blocks)
    ready = {m.name: replace(m, lookup=lookup) for m in nb}
    return [ready[m.name] if m.kind in TERM_KINDS else m for m in models]


def prob_col(name: str) -> str:
    return f"p_{name}"


def score_models(df: DataFrame, models: list[TextModel], key: str = "post_id", text_col: str = "text",
                 carry=("label",), max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES, profile: Profile | None = None) -> DataFrame:
    """Wide scores: one row per post with ``p_<model>`` for every model, in one pass over the posts. Terms are summed back
    per row: by the row's identity from the scan where ``df`` has it (column ``ROW``), else by a written number.
    ``profile``: how ``df`` was cleaned; a model fitted under another profile is an error."""
    if not models:
        raise ValueError("no models to score")
    if profile is not None:
        for m in models:
            m.profile.check_same(profile)
    carry = [c for c in carry if c in df.columns]
    nb = [m for m in models if m.kind in TERM_KINDS]
    row_models = [m for m in models if m.apply is not None]
    if row_models:
        inputs = [c for c in dict.fromkeys(c for m in row_models for c in m.inputs) if c not in (key, text_col, *carry)]
        kept = (key, *carry, *(c for c in (ROW,) if c in df.columns))
        df = df.select(*kept, text_col, *inputs)
        for m in row_models:
            df = m.apply(df, prob_col(m.name))
        df = df.select(*kept, text_col, *[prob_col(m.name) for m in row_models])
        carry = [*carry, *[prob_col(m.name) for m in row_models]]
    length = F.length(F.col(text_col)).alias("_len")
    if nb:
        # per input row, not per key: duplicated keys are scored row by row and a key repeated in many
        # rows never becomes one huge group
        rows = by_row(df, [key, *carry, text_col])
        by = ["_rid", key, *carry, "_len"]
        ex = explode_terms(rows.select("_rid", key, *carry, length, text_col), text_col, [m.terms for m in nb], by)
        cut = nb[0].lookup
        if cut is None or cut.names != tuple(m.name for m in nb) or cut.bounds != (max_broadcast_rows, max_broadcast_bytes) \
                or any(m.lookup is not cut for m in nb):
            cut = lookup_of(nb, max_broadcast_rows, max_broadcast_bytes)
        joined = join_terms(ex, cut.hot, cut.tail, ["m", "term"], "weight", ["_rid", "m"], sum_by=by, bitmap=cut.bitmap)
        sums = [F.sum(F.when(F.col("m") == i, F.col("weight"))).alias(f"_s_{m.name}") for i, m in enumerate(nb)]
        base = joined.groupBy(*by).agg(*sums)
    else:
        base = df.select(key, *carry, length)
    rows_of = {prob_col(m.name) for m in row_models}
    out = [F.col(key), *[F.col(c) for c in carry if c not in rows_of]]
    for m in models:
        if m.apply is not None:
            out.append(F.col(prob_col(m.name)))
            continue
        if m.kind in TERM_KINDS:
            z = F.lit(m.bias) + F.coalesce(F.col(f"_s_{m.name}"), F.lit(0.0))
        elif m.kind == "style":
            z = (F.col("_len").cast("double") - F.lit(STYLE_CENTER)) / F.lit(STYLE_SCALE)
        else:
            raise ValueError(f"model {m.name!r} of kind {m.kind!r} is not a text scorer")
        out.append(safe_sigmoid(z).alias(prob_col(m.name)))
    return base.select(*out)


def score_text(df: DataFrame, model: TextModel, **kw) -> DataFrame:
    """One model: adds ``p``."""
    return score_models(df, [model], **kw).withColumnRenamed(prob_col(model.name), "p")
