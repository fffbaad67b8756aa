"""Model registry: names -> how to fit, store and load them.

A store is a folder of versions, each written once and never changed:
``versions/<v>/meta``   one row per model: kind, terms, bias, sizes, the whole profile it was fitted under, and a digest of its weights
``versions/<v>/terms``  (model, term, weight, n) partitioned by model: the tables of the models of terms
``versions/<v>/head/<model>``  the head's weights
``CURRENT``             the name of the version that counts, replaced in one step when all of a version is written

So a reader sees the registry before a publication or after it, whenever the writer dies; what it has opened stays in place until the
next but one. Digests are computed from what was written, and again when a store is opened.

``nb``, ``lr`` and ``style`` read terms and lengths; ``head`` and ``external`` score row by row in the same pass
(``external``: any batch model given as a function, which is not stored: its function is given again when loading).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.config import DEFAULT_PROFILE, Profile
from botsift.operators.shared import SharedArrays
from botsift.operators.textmodels import TERM_KINDS, TextModel, fit_naive_bayes, fit_naive_bayes_many, style_model, weight_table
from botsift.sinks.publish import get, names, put, remove


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str                 # "nb" | "style" | "lr" | "head" | "external"
    terms: str | None = None
    options: tuple = ()       # (name, value) pairs for fitting, e.g. the steps of "lr"


DEFAULT_REGISTRY = (
    ModelSpec("nb_word", "nb", "word"),
    ModelSpec("nb_bigram", "nb", "bigram"),
    ModelSpec("nb_trigram", "nb", "trigram"),
    ModelSpec("style", "style"),
)
# A registry entry that is never fitted: exercises the "weights not found -> skipped" path.
MISSING_MODEL = ModelSpec("missing_model", "nb", "word")

META_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("terms", T.StringType(), True),
    T.StructField("bias", T.DoubleType(), False),
    T.StructField("n_terms", T.LongType(), False),
    T.StructField("term_bytes", T.LongType(), True),
    T.StructField("clean", T.StringType(), False),
    T.StructField("max_len", T.IntegerType(), False),
    T.StructField("threshold", T.DoubleType(), False),
    T.StructField("seed", T.LongType(), False),
    T.StructField("test_share", T.DoubleType(), False),
    T.StructField("digest", T.StringType(), True),
])
TERMS_SCHEMA = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType()),
                             T.StructField("n", T.LongType()), T.StructField("model", T.StringType())])
HEAD_SCHEMA = "param string, idx int, value double, d_in int, width int"
#: versions that stay beside the current one, for readers that have them open
KEPT = 1


def fit_model(train: DataFrame, spec: ModelSpec, profile: Profile = DEFAULT_PROFILE, **kw) -> TextModel:
    if spec.kind == "nb":
        return fit_naive_bayes(train, spec.terms, name=spec.name, profile=profile, **kw)
    if spec.kind == "style":
        return style_model(spec.name, profile)
    if spec.kind == "lr":
        from botsift.operators.logistic import fit_text_lr

        return fit_text_lr(train, spec.name, profile=profile, **dict(spec.options))
    raise ValueError(f"{spec.name}: a model of kind {spec.kind!r} is given, not fitted on texts; see head_model and external_model")


def head_model(name: str, weights, emb_col: str = "embedding", profile: Profile = DEFAULT_PROFILE) -> TextModel:
    """The two-layer head over a vector column as a registry model."""
    from botsift.operators.head import score_head

    return TextModel(name, "head", profile=profile, fitted=weights, inputs=(emb_col,),
                     apply=lambda df, out: df.withColumn(out, score_head(emb_col, weights)))


def external_model(name: str, make_predict_fn: Callable, inputs: tuple[str, ...], profile: Profile = DEFAULT_PROFILE,
                   input_tensor_shapes=None, weights: SharedArrays | None = None) -> TextModel:
    """Any batch model over columns (e.g. input_ids and attention_mask of an encoder) as a registry model. With ``weights``
    ``make_predict_fn`` is given the mapped arrays by name, so that a large model costs each machine one copy."""
    from botsift.operators.head import score_external

    if weights is not None:
        with_weights = make_predict_fn
        make_predict_fn = lambda: with_weights(weights.open())
    return TextModel(name, "external", profile=profile, inputs=tuple(inputs), apply=lambda df, out: df.withColumn(
        out, score_external(list(inputs), make_predict_fn, input_tensor_shapes=input_tensor_shapes)))


def fit_all_models(train: DataFrame, specs=DEFAULT_REGISTRY, profile: Profile = DEFAULT_PROFILE) -> list[TextModel]:
    """One model per registry entry on the same training split; all naive-Bayes entries are
    fitted together in one pass over the training rows. An entry that already is a model stays as it is."""
    nb = fit_naive_bayes_many(train, [(s.name, s.terms) for s in specs if s.kind == "nb" and isinstance(s, ModelSpec)], profile=profile)
    by_name = {m.name: m for m in nb}
    return [s if isinstance(s, TextModel) else by_name[s.name] if s.kind == "nb" else fit_model(train, s, profile) for s in specs]


def registry_frame(spark: SparkSession, specs) -> DataFrame:
    return spark.createDataFrame([(s.name, s.kind, s.terms) for s in specs], "model string, kind string, terms string")


def models_summary(models: list[TextModel], digests: dict[str, str]) -> list[tuple]:
    return [(m.name, m.kind, m.terms, float(m.bias), int(m.n_terms), m.term_bytes, m.profile.clean, int(m.profile.max_len),
             float(m.profile.threshold), int(m.profile.seed), float(m.profile.test_share), digests.get(m.name)) for m in models]


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that counts, None where nothing is published."""
    name = get(spark, f"{path}/CURRENT")
    return f"{path}/versions/{name}" if name else None


def _sum_of_hashes(*columns: str):
    """A digest that doesn't depend on the order of the rows."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string")


def stored_digests(spark: SparkSession, folder: str, heads) -> dict[str, str]:
    """Digest of each model's weights as they are stored in a version: the tables of terms in one pass, heads one by one."""
    terms = _read(spark, f"{folder}/terms", TERMS_SCHEMA).groupBy("model").agg(_sum_of_hashes("term", "weight", "n").alias("digest"))
    found = {r["model"]: r["digest"] for r in terms.collect()}      # a row per model
    for name in heads:
        rows = _read(spark, f"{folder}/head/{name}", T._parse_datatype_string(HEAD_SCHEMA))
        digest = rows.agg(F.count(F.lit(1)).alias("n"), _sum_of_hashes("param", "idx", "value", "d_in", "width").alias("digest")).first()
        if digest["n"]:
            found[name] = digest["digest"]
    return found


def save_models(spark: SparkSession, models: list[TextModel], path: str, kept: int = KEPT) -> str:
    """Publish the models as a new version: weights first, then the meta table with their digests, the pointer last. Returns the
    version's folder. Older versions, and what a failed publication left, are deleted after that, except for the ``kept`` newest."""
    from botsift.operators.head import write_head

    before = get(spark, f"{path}/CURRENT")
    number = max((int(n.split("-")[0]) for n in names(spark, f"{path}/versions")), default=0) + 1
    name = f"{number:06d}-{uuid.uuid4().hex[:12]}"
    folder = f"{path}/versions/{name}"
    of_terms = [m for m in models if m.kind in TERM_KINDS]
    heads = [m for m in models if m.kind == "head"]
    if of_terms:
        weight_table(of_terms).select("model", "term", "weight", F.col("n").cast("bigint").alias("n")) \
            .write.partitionBy("model").parquet(f"{folder}/terms")
    for m in heads:
        write_head(spark, m.fitted, f"{folder}/head/{m.name}")
    digests = stored_digests(spark, folder, [m.name for m in heads])
    spark.createDataFrame(models_summary(models, digests), META_SCHEMA).coalesce(1).write.parquet(f"{folder}/meta")
    put(spark, f"{path}/CURRENT", name)
    older = [n for n in names(spark, f"{path}/versions") if n not in (name, before)]
    for n in older[: max(0, len(older) - max(kept - 1, 0))]:
        remove(spark, f"{path}/versions/{n}")
    return folder


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_models(spark: SparkSession, path: str, verify: bool = True, version: str | None = None) -> DataFrame:
    """Meta rows of the current version's models whose weights are there, with a ``status``: 'available', or 'damaged' where the
    weights' digest isn't the one that was published. A model without its weights is left out; without a store the table is empty.
    ``verify=False`` reads no weights, and believes the pointer."""
    folder = version or current_version(spark, path)
    if folder is None:
        return spark.createDataFrame([], META_SCHEMA).withColumn("status", F.lit("available"))
    meta = _read(spark, f"{folder}/meta", META_SCHEMA)
    if not verify:
        return meta.withColumn("status", F.lit("available"))
    heads = [r["model"] for r in meta.where("kind = 'head'").select("model").collect()]
    found = spark.createDataFrame(list(stored_digests(spark, folder, heads).items()), "model string, _found string")
    both = meta.join(F.broadcast(found), "model", "left")                          # a row per model
    weightless = ~F.col("kind").isin(*TERM_KINDS, "head") | ((F.col("kind") != "head") & (F.col("n_terms") == 0))
    status = F.when(weightless | F.col("digest").eqNullSafe(F.col("_found")), F.lit("available")).otherwise(F.lit("damaged"))
    return both.where(weightless | F.col("_found").isNotNull()).withColumn("status", status).drop("_found")


def load_models(spark: SparkSession, path: str, names=None, external: dict[str, TextModel] | None = None, verify: bool = True) -> list[TextModel]:
    """Read the current version's meta rows (a handful) and point each model at its stored weights; term tables stay
    DataFrames (read lazily, pruned to one partition per model). ``external``: models that aren't stored, by name. Damaged
    weights are an error."""
    from botsift.operators.head import read_head

    folder = current_version(spark, path)
    meta = stored_models(spark, path, verify, folder)
    if names is not None:
        meta = meta.filter(F.col("model").isin(list(names)))
    out = []
    for r in meta.collect():
        if r["status"] != "available":
            raise ValueError(f"{folder}: the weights of {r['model']!r} aren't those that were published")
        prof = Profile(r["clean"], r["max_len"], r["threshold"], r["seed"], r["test_share"])
        if r["kind"] in TERM_KINDS:
            w = _read(spark, f"{folder}/terms", TERMS_SCHEMA).filter(F.col("model") == r["model"]).select("term", "weight", "n")
            out.append(TextModel(r["model"], r["kind"], r["terms"], r["bias"], w, int(r["n_terms"]), r["term_bytes"], prof))
        elif r["kind"] == "head":
            out.append(head_model(r["model"], read_head(spark, f"{folder}/head/{r['model']}"), profile=prof))
        elif r["kind"] == "external":
            if external and r["model"] in external:
                out.append(external[r["model"]])
        else:
            out.append(TextModel(r["model"], r["kind"], r["terms"], r["bias"], None, int(r["n_terms"]), profile=prof))
    order = {n: i for i, n in enumerate(names)} if names is not None else {}
    return sorted(out, key=lambda m: order.get(m.name, 0))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(model, n_terms, content): what the current version's tables of terms hold, counted from the tables: their terms and a sum
    of digests of (term, occurrences), which any engine with MD5 can compute."""
    folder = current_version(spark, path)
    terms = _read(spark, f"{folder}/terms", TERMS_SCHEMA)
    part = F.conv(F.substring(F.md5(F.concat("term", F.lit(":"), F.col("n").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)")
    return terms.groupBy("model").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(part).cast("string").alias("content"))


def available_models(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """(model, kind, terms, status): 'available' if the stored weights are whole, 'damaged' if they differ from what was
    published, 'skipped' if there are none."""
    status = F.coalesce("status", F.lit("skipped")).alias("status")
    return registry.join(F.broadcast(stored.select("model", "status")), "model", "left").select(*registry.columns, status)
