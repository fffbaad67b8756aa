"""Oracle SQL (DuckDB) for the registered queries; key -> SQL over the pre-registered tables."""

from __future__ import annotations

from checks import sqlparts as s
from checks.sqlparts import BASE, E, H, L, P, P0, with_

ORACLE: dict[str, str] = {}


def oracle(key: str, sql: str) -> None:
    ORACLE[key] = sql


NULL_WORDS_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))


def _nullword(c: str) -> str:
    return f'CASE WHEN {c} IN ({NULL_WORDS_SQL}) THEN NULL ELSE {c} END'


# ------------------------------------------------------------------ 2.2
oracle("normalize_columns", with_(P) + "SELECT * FROM p")
oracle("detect_columns", with_(P) + "SELECT * FROM p")
oracle("select_text_label", with_(P) + 'SELECT post_id, text, "account.type" AS label FROM p')
oracle("encode_label_ci", with_(P) + f'SELECT post_id, {s.encode_label_ci(chr(34) + "account.type" + chr(34))} AS label FROM p')
oracle("encode_label_cs", with_(P) + f'SELECT post_id, {s.encode_label_cs(chr(34) + "account.type" + chr(34))} AS label FROM p')
oracle("label_as_int", with_(L) + "SELECT post_id, label FROM l")
oracle("drop_incomplete", with_(P0) + f"""SELECT * FROM (
  SELECT post_id, text, {s.encode_label_ci('"account.type"')} AS label FROM p0)
WHERE post_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL""")
oracle("text_as_string", with_(P0) + "SELECT post_id, coalesce(text, 'nan') AS text FROM p0")
oracle("reject_blank", with_(P, H) + f"""SELECT * FROM (SELECT post_id, text FROM p UNION ALL SELECT post_id, text FROM h)
WHERE coalesce(length({s.strip_ws('text')}) > 0, false)""")

# ------------------------------------------------------------------ 2.1
oracle("schema_peek", with_(P) + "SELECT * FROM p ORDER BY post_id LIMIT 5")

# ------------------------------------------------------------------ 2.3
oracle("strip_urls", with_(H) + f"SELECT post_id, {s.strip_urls('text')} AS text FROM h")
oracle("strip_tags", with_(H) + f"SELECT post_id, {s.strip_tags('text')} AS text FROM h")
oracle("strip_non_letters", with_(P) + f"SELECT post_id, {s.strip_non_letters('text')} AS text FROM p")
oracle("lower_strip", with_(P) + f"SELECT post_id, {s.lower_strip('text')} AS text FROM p")
oracle("clean_strong", with_(P, H, L) + f"""SELECT source, post_id, {s.clean_strong('text')} AS text FROM (
  SELECT 'P' AS source, post_id, text FROM p UNION ALL SELECT 'H', post_id, text FROM h
  UNION ALL SELECT 'L', post_id, text FROM l)""")
oracle("clean_light", with_(P, H) + f"""SELECT source, post_id, {s.clean_light('text')} AS text FROM (
  SELECT 'P' AS source, post_id, text FROM p UNION ALL SELECT 'H', post_id, text FROM h)""")
oracle("clean_raw", with_(P) + "SELECT post_id, text FROM p")
_t1, _t2 = s.strip_urls("text"), None
oracle("clean_trace", with_(H, f"""st AS (SELECT post_id, text AS s0, {s.strip_urls('text')} AS s1 FROM h),
st2 AS (SELECT *, {s.strip_tags('s1')} AS s2 FROM st),
st3 AS (SELECT *, {s.strip_non_letters('s2')} AS s3 FROM st2),
st4 AS (SELECT *, {s.lower_strip('s3')} AS s4 FROM st3)""") + """
SELECT post_id, 1 AS step_no, 'original' AS step, s0 AS value FROM st4
UNION ALL SELECT post_id, 2, 'urls_removed', s1 FROM st4
UNION ALL SELECT post_id, 3, 'tags_removed', s2 FROM st4
UNION ALL SELECT post_id, 4, 'non_letters_removed', s3 FROM st4
UNION ALL SELECT post_id, 5, 'lowercased', s4 FROM st4""")

# ------------------------------------------------------------------ 2.4
oracle("split_stratified_exact", with_(*BASE) + "SELECT post_id, label, split FROM sp")
oracle("split_stratified_hash", with_(P, s.labelled()) + f"""SELECT post_id, label,
  CASE WHEN {s.hex_uniform("md5('42:' || post_id)")} < CAST(0.2 AS DOUBLE) THEN 'test' ELSE 'train' END AS split FROM lp""")
oracle("split_counts", with_(*BASE) + "SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM sp GROUP BY split, label")

# ------------------------------------------------------------------ 2.6 / 2.7 text models
_NB_WORD = [s.nb_fit("word", "nb_word", "tr"), s.nb_score("word", "nb_word", "te")]
oracle("fit_text_nb", with_(*BASE, s.nb_fit("word", "nb_word", "tr")) + "SELECT term, round(weight, 6) AS weight FROM nb_word_w")
oracle("fit_all_models", with_(*BASE, *[s.nb_fit(k, m, "tr") for m, k in s.REGISTRY]) + " UNION ALL ".join(
    [f"SELECT '{m}' AS model, 'nb' AS kind, CAST((SELECT count(*) FROM {m}_w) AS BIGINT) AS n_terms, "
     f"round((SELECT bias FROM {m}_b), 6) AS bias" for m, _ in s.REGISTRY]
    + ["SELECT 'style', 'style', CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE)"]))
_ZW = "(SELECT te.post_id, te.label, z.z FROM te JOIN nb_word_z z ON te.post_id = z.post_id)"
oracle("score_text", with_(*BASE, *_NB_WORD) + f"SELECT post_id, label, round({s.sigmoid('z')}, 6) AS p FROM {_ZW}")
oracle("score_large_vocabulary", with_(*BASE, s.nb_fit("bigram", "nb_bigram", "tr"), s.nb_score("bigram", "nb_bigram", "te"))
       + f"SELECT te.post_id, te.label, round({s.sigmoid('z.z')}, 6) AS p FROM te JOIN nb_bigram_z z ON te.post_id = z.post_id")
oracle("predict_threshold", with_(*BASE, *_NB_WORD)
       + f"SELECT post_id, label, CAST({s.sigmoid('z')} > 0.5 AS INTEGER) AS predicted FROM {_ZW}")
oracle("decode_label", with_(*BASE, *_NB_WORD)
       + f"SELECT post_id, CASE WHEN {s.sigmoid('z')} > 0.5 THEN 'Bot' ELSE 'Human' END AS prediction FROM {_ZW}")
oracle("predict_one_model", with_(*BASE, "allp AS (SELECT post_id, " + s.clean_strong("text")
                                  + f" AS text FROM p WHERE coalesce(length({s.strip_ws('text')}) > 0, false))",
                                  s.nb_fit("word", "nb_word", "tr"), s.nb_score("word", "nb_word", "allp"))
       + f"SELECT post_id, 'nb_word' AS model, CASE WHEN {s.sigmoid('z')} > 0.5 THEN 'Bot' ELSE 'Human' END AS prediction FROM nb_word_z")
_RAW = [P, s.labelled("raw"), s.split_ctes(), "tr AS (SELECT * FROM sp WHERE split = 'train')"]
oracle("predict_one_raw", with_(*_RAW, f"allp AS (SELECT post_id, text FROM p WHERE coalesce(length({s.strip_ws('text')}) > 0, false))",
                                s.nb_fit("word", "nb_word", "tr"), s.nb_score("word", "nb_word", "allp"))
       + f"SELECT post_id, 'nb_word' AS model, CASE WHEN {s.sigmoid('z')} > 0.5 THEN 'Bot' ELSE 'Human' END AS prediction FROM nb_word_z")
_WIDE = [*BASE, s.all_models_wide()]
oracle("predict_all_models", with_(*_WIDE, s.long_from_wide()) + """SELECT post_id, model,
  CASE WHEN predicted = 1 THEN 'Bot' ELSE 'Human' END AS prediction, round(p, 3) AS confidence FROM lg""")
oracle("score_batched", with_(*_WIDE, s.long_from_wide())
       + "SELECT post_id, label, model, round(p, 6) AS p, predicted FROM lg")
oracle("ensemble_mean", with_(*_WIDE, s.long_from_wide(ensemble=True))
       + "SELECT post_id, label, round(p, 6) AS p, predicted FROM lg WHERE model = 'ENSEMBLE'")
oracle("choose_model", with_(*BASE, s.nb_fit("bigram", "nb_bigram", "tr"), s.nb_score("bigram", "nb_bigram", "te"))
       + f"""SELECT z.post_id, 'nb_bigram' AS model, round({s.sigmoid('z.z')}, 6) AS p,
  CAST({s.sigmoid('z.z')} > 0.5 AS INTEGER) AS predicted FROM nb_bigram_z z""")

# ------------------------------------------------------------------ 2.8 metrics
oracle("label_distribution", with_(P, s.labelled()) + "SELECT label, CAST(count(*) AS BIGINT) AS n FROM lp GROUP BY label")
oracle("class_balance", with_(P, s.labelled()) + """SELECT label, n, round(n / sum(n) OVER (), 6) AS share FROM (
  SELECT label, CAST(count(*) AS BIGINT) AS n FROM lp GROUP BY label)""")
_CNT = f"cnt AS ({s.counts_by('lg')})"
_MET = with_(*_WIDE, s.long_from_wide(), _CNT)
_MET_E = with_(*_WIDE, s.long_from_wide(ensemble=True), _CNT)
for _m in ("accuracy", "precision", "recall", "f1"):
    oracle(_m, _MET + f"SELECT model, {_m} FROM (SELECT {s.metrics_select()} FROM cnt)")
oracle("compare_models", _MET + f"SELECT {s.metrics_select()} FROM cnt")
_POSITION = ("list_position(['" + "', '".join([*s.MODEL_NAMES, "ENSEMBLE"]) + "'], model)")
oracle("compare_with_ensemble", _MET_E + f"SELECT CAST({_POSITION} AS INTEGER) AS position, {s.metrics_select()} FROM cnt")
oracle("metrics_report", _MET_E + f"""SELECT model, printf('%.4f', {s.ratio('tp + tn', 'tp + fp + fn + tn')}) AS accuracy,
  printf('%.4f', {s.ratio('tp', 'tp + fp')}) AS precision, printf('%.4f', {s.ratio('tp', 'tp + fn')}) AS recall,
  printf('%.4f', {s.ratio('2 * tp', '2 * tp + fp + fn')}) AS f1 FROM cnt""")
oracle("rank_models", _MET_E + f"""SELECT model, f1, CAST(rank() OVER (ORDER BY f1 DESC) AS INTEGER) AS rank
FROM (SELECT {s.metrics_select()} FROM cnt)""")
oracle("confusion_matrix", _MET + """SELECT model, actual, predicted, n FROM (
  SELECT model, 0 AS actual, 0 AS predicted, tn AS n FROM cnt UNION ALL SELECT model, 0, 1, fp FROM cnt
  UNION ALL SELECT model, 1, 0, fn FROM cnt UNION ALL SELECT model, 1, 1, tp FROM cnt)""")
oracle("confusion_labeled", _MET + """SELECT model, actual, predicted, n FROM (
  SELECT model, 'Human' AS actual, 'Human' AS predicted, tn AS n FROM cnt UNION ALL SELECT model, 'Human', 'Bot', fp FROM cnt
  UNION ALL SELECT model, 'Bot', 'Human', fn FROM cnt UNION ALL SELECT model, 'Bot', 'Bot', tp FROM cnt)""")
oracle("metrics_by_domain", with_(*BASE, L, "tgt AS (SELECT 'P' AS dataset, post_id, text, label FROM te UNION ALL "
                                  f"SELECT 'L', post_id, {s.clean_strong('text')}, label FROM l)",
                                  s.all_models_wide(target="tgt", extra=", t.dataset"),
                                  s.long_from_wide(extra=", dataset"),
                                  f"cnt AS ({s.counts_by('lg', 'dataset, model')})")
       + f"SELECT dataset, {s.metrics_select()} FROM cnt")

# ------------------------------------------------------------------ 2.1 sources
_PN = f"SELECT {_nullword('post_id')} AS post_id, {_nullword('text')} AS text, " \
      f"{_nullword(chr(34) + 'account.type' + chr(34))} AS \"account.type\" FROM p"
oracle("read_posts_semicolon", with_(P) + _PN)
oracle("read_posts_comma", with_(P) + _PN)
oracle("read_prepared_test", with_(L) + f"SELECT post_id, coalesce({_nullword('text')}, 'nan') AS tweet, label FROM l")
oracle("post_stream_source", with_(P) + "SELECT * FROM p")
_CONTENT = "CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(CAST(CAST('0x' || substr(md5(term || ':' || CAST(c1 + c0 AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS content"
oracle("available_models", with_(*BASE, *[s.nb_fit(kind, m) for m, kind in s.REGISTRY],
                                 "held AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {_CONTENT} FROM {m}_c" for m, _ in s.REGISTRY) + ")")
       + """SELECT r.model, CASE WHEN h.n_terms > 0 OR r.model = 'style' THEN 'available' ELSE 'skipped' END AS status, h.n_terms, h.content
FROM (VALUES ('nb_word'), ('nb_bigram'), ('nb_trigram'), ('style'), ('missing_model')) r(model) LEFT JOIN held h ON h.model = r.model""")
oracle("available_none", with_(P, s.labelled()) + """SELECT model, 'skipped' AS status, n_posts FROM
  (VALUES ('nb_word'), ('nb_bigram'), ('nb_trigram'), ('style'), ('missing_model')) t(model),
  (SELECT CAST(count(*) AS BIGINT) AS n_posts FROM lp)""")

# ------------------------------------------------------------------ 2.5 encoding
def _vocab(train: str = "tr") -> str:
    return f"""vtok AS (SELECT unnest({s.words('text')}) AS token FROM {train}),
vcnt AS (SELECT token, count(*) AS n FROM vtok GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id, CAST(n AS BIGINT) AS n FROM vcnt)"""


def _encode(src: str = "sp", max_len: int | None = None) -> str:
    cut = "" if max_len is None else f"[1:{max_len - 2}]"
    return f"""ews AS (SELECT post_id, {s.words('text')}{cut} AS ws FROM {src}),
etok AS (SELECT post_id, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS pos FROM ews),
eid AS (SELECT t.post_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM etok t LEFT JOIN vocab v ON t.token = v.token
        GROUP BY t.post_id),
enc AS (SELECT s.post_id, CAST([2] || coalesce(eid.ids, []) || [3] AS INTEGER[]) AS input_ids
        FROM {src} s LEFT JOIN eid ON s.post_id = eid.post_id)"""


oracle("build_vocab", with_(*BASE, _vocab()) + "SELECT * FROM vocab")
oracle("encode_ids", with_(*BASE, _vocab(), _encode()) + "SELECT post_id, input_ids FROM enc")
_BASE_LIGHT = [P, s.labelled("light"), s.split_ctes(), "tr AS (SELECT * FROM sp WHERE split = 'train')"]
oracle("truncate_ids", with_(*_BASE_LIGHT, _vocab(), _encode(max_len=256))
       + "SELECT post_id, input_ids, CAST(len(input_ids) AS INTEGER) AS n_ids FROM enc")
oracle("pad_and_mask", with_(*BASE, _vocab(), _encode(max_len=128)) + """SELECT post_id,
  CAST(input_ids || list_transform(range(128 - len(input_ids)), lambda x: 0) AS INTEGER[]) AS input_ids,
  CAST(list_transform(range(len(input_ids)), lambda x: 1) || list_transform(range(128 - len(input_ids)), lambda x: 0)
       AS INTEGER[]) AS attention_mask FROM enc""")
oracle("length_profile", with_(P, s.labelled()) + f"""SELECT CAST(count(*) AS BIGINT) AS n_posts,
  CAST(sum(CASE WHEN t > 126 THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated, CAST(max(t) AS BIGINT) AS max_tokens,
  round(avg(i), 6) AS avg_ids, round(sum(128 - i) / (count(*) * 128), 6) AS pad_share
FROM (SELECT len({s.words('text')}) AS t, least(len({s.words('text')}), 126) + 2 AS i FROM lp)""")
oracle("assign_batches", with_(*BASE) + """SELECT post_id, rk AS rank, CAST((rk - 1) // 16 AS BIGINT) AS batch FROM (
  SELECT post_id, CAST(row_number() OVER (ORDER BY md5('42:' || post_id), post_id) AS BIGINT) AS rk FROM tr)""")

# ------------------------------------------------------------------ 2.6 head
_HEAD = [E, """x AS (SELECT post_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM e)""",
         """w1 AS (SELECT k // 128 AS i, k % 128 AS j, CAST(((k // 128) * 31 + (k % 128) * 17) % 101 - 50 AS DOUBLE) / 250.0 AS w
        FROM range(8192) t(k))""",
         """w2 AS (SELECT j, CAST((j * 13) % 29 - 14 AS DOUBLE) / 50.0 AS w FROM range(128) t(j))""",
         """hz AS (SELECT x.post_id, w1.j, sum(x.v * w1.w) AS z FROM x JOIN w1 ON x.i = w1.i GROUP BY x.post_id, w1.j)""",
         """hid AS (SELECT post_id, j, z, greatest(z, 0.0) AS h FROM hz)""",
         f"""pr AS (SELECT hid.post_id, {s.sigmoid('sum(hid.h * w2.w)')} AS p FROM hid JOIN w2 ON hid.j = w2.j
        GROUP BY hid.post_id)""",
         """pe AS (SELECT pr.post_id, e.label, pr.p FROM pr JOIN e ON pr.post_id = e.post_id)"""]
oracle("cls_pool", with_(E) + "SELECT post_id, embedding[1:16] AS cls FROM e")
oracle("dense_relu", with_(*_HEAD) + "SELECT post_id, list(round(h, 6) ORDER BY j) AS hidden FROM hid GROUP BY post_id")
def _keep(step: str) -> str:
    """Factor of unit j of a post in train mode (the generator of the head's dropout)."""
    seed = f"CAST(('0x' || substr(md5('42:' || {step} || ':' || CAST(post_id AS VARCHAR)), 1, 8)) AS BIGINT)"
    x = f"(({seed} + (j + 1) * 2654435761) % 4294967296)"
    return f"(CASE WHEN (({x} * 48271) % 2147483647 * 69621) % 2147483647 / 2147483647.0 < CAST(0.3 AS DOUBLE) THEN 0.0 ELSE {1 / (1 - 0.3)!r} END)"


oracle("dropout_mask", with_(*_HEAD) + f"""SELECT post_id, list(round(h * {_keep("'0'")}, 6) ORDER BY j) AS hidden
FROM hid GROUP BY post_id""")
oracle("dense_sigmoid", with_(*_HEAD) + "SELECT post_id, round(p, 6) AS p FROM pr")
oracle("score_head", with_(*_HEAD) + "SELECT post_id, label, round(p, 6) AS p, CAST(p > 0.5 AS INTEGER) AS predicted FROM pe")
oracle("score_external", with_(*_HEAD) + "SELECT post_id, round(p, 6) AS p FROM pr")
oracle("load_model", with_(*_HEAD) + "SELECT post_id, round(p, 6) AS p FROM pr")

_STYLE = s.sigmoid("(length(t) - 250.0) / 100.0")
_HALF = s.sigmoid("list_sum([CAST(x AS DOUBLE) FOR x IN embedding[1:32]])")
oracle("predict_mixed", with_(*_HEAD, f"""mx AS (SELECT pe.post_id, pe.label, pe.p AS p_head, {_STYLE} AS p_style, {_HALF} AS p_half
  FROM pe JOIN (SELECT *, array_to_string([CAST(floor(x * 10) AS BIGINT) FOR x IN embedding], ' ') AS t FROM e) e ON pe.post_id = e.post_id),
lg AS (SELECT post_id, label, 'head' AS model, p_head AS p FROM mx UNION ALL SELECT post_id, label, 'style', p_style FROM mx
  UNION ALL SELECT post_id, label, 'half', p_half FROM mx
  UNION ALL SELECT post_id, label, 'ENSEMBLE', (p_head + p_style + p_half) / 3.0 FROM mx)""")
       + "SELECT post_id, label, model, round(p, 6) AS p, CAST(p > 0.5 AS INTEGER) AS predicted FROM lg")

# ------------------------------------------------------------------ 2.7 head training
_BCE = "-(label * greatest(ln(p), -100.0) + (1 - label) * greatest(ln(1.0 - p), -100.0))"
oracle("bce_loss", with_(*_HEAD) + f"SELECT post_id, label, round({_BCE}, 6) AS loss FROM pe")
oracle("epoch_loss", with_(*_HEAD) + f"""SELECT round(avg(m), 6) AS epoch_loss, CAST(count(*) AS BIGINT) AS n_batches FROM (
  SELECT b, avg(loss) AS m FROM (SELECT (row_number() OVER (ORDER BY post_id) - 1) // 16 AS b, {_BCE} AS loss FROM pe)
  GROUP BY b)""")
_GRAD = [*_HEAD, "nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM e)",
         "d AS (SELECT post_id, p - label AS d2 FROM pe)",
         """dz AS (SELECT hid.post_id, hid.j, hid.h, d.d2, CASE WHEN hid.z > 0 THEN d.d2 * w2.w ELSE 0.0 END AS dh
        FROM hid JOIN d ON hid.post_id = d.post_id JOIN w2 ON hid.j = w2.j)""",
         """grad AS (
  SELECT 'W1' AS param, CAST(x.i * 128 + dz.j AS INTEGER) AS idx, sum(x.v * dz.dh) / max(nn.n) AS grad
    FROM x JOIN dz ON x.post_id = dz.post_id JOIN nn ON TRUE GROUP BY x.i, dz.j
  UNION ALL SELECT 'b1', CAST(j AS INTEGER), sum(dh) / max(nn.n) FROM dz JOIN nn ON TRUE GROUP BY j
  UNION ALL SELECT 'w2', CAST(j AS INTEGER), sum(h * d2) / max(nn.n) FROM dz JOIN nn ON TRUE GROUP BY j
  UNION ALL SELECT 'b2', 0, sum(d2) / max(nn.n) FROM d JOIN nn ON TRUE)"""]
oracle("head_gradient", with_(*_GRAD) + "SELECT param, idx, round(grad, 9) AS grad FROM grad")
_LR, _WD, _B1, _B2, _EPS = 2e-5, 0.01, 0.9, 0.999, 1e-8
_theta0 = """CASE WHEN param = 'W1' THEN CAST(((idx // 128) * 31 + (idx % 128) * 17) % 101 - 50 AS DOUBLE) / 250.0
  WHEN param = 'w2' THEN CAST((idx * 13) % 29 - 14 AS DOUBLE) / 50.0 ELSE 0.0 END"""
_m1 = f"({_B1!r} * 0.0 + {1 - _B1!r} * grad)"
_v1 = f"({_B2!r} * 0.0 + {1 - _B2!r} * grad * grad)"
_den = f"(sqrt({_v1}) / {float((1 - _B2) ** 0.5)!r} + {_EPS!r})"
oracle("adamw_step", with_(*_GRAD) + f"""SELECT param, idx,
  round(({_theta0}) * {1 - _LR * _WD!r} - {_LR / (1 - _B1)!r} * {_m1} / {_den}, 9) AS value FROM grad""")



def _fit_head(epochs: int = 2, steps: int = 2, lr: float = 1e-3) -> str:
    """The training run as a chain of steps: forward pass in train mode, gradient, AdamW."""
    parts = [E, """t0 AS MATERIALIZED (
  SELECT 'W1' AS param, k AS idx, CAST(((k // 128) * 31 + (k % 128) * 17) % 101 - 50 AS DOUBLE) / 250.0 AS val, 0.0 AS m, 0.0 AS v FROM range(8192) r(k)
  UNION ALL SELECT 'b1', k, 0.0, 0.0, 0.0 FROM range(128) r(k)
  UNION ALL SELECT 'w2', k, CAST((k * 13) % 29 - 14 AS DOUBLE) / 50.0, 0.0, 0.0 FROM range(128) r(k)
  UNION ALL SELECT 'b2', 0, 0.0, 0.0, 0.0)"""]
    for t in range(epochs * steps):
        ep, b = divmod(t, steps)
        bc1, bc2 = 1 - _B1 ** (t + 1), 1 - _B2 ** (t + 1)
        m, v = f"({_B1!r} * th.m + {1 - _B1!r} * g.g)", f"({_B2!r} * th.v + {1 - _B2!r} * g.g * g.g)"
        parts.append(f"""e{t} AS MATERIALIZED (SELECT * FROM e WHERE CAST(('0x' || substr(md5('42:{ep}:' || CAST(post_id AS VARCHAR)), 1, 8)) AS BIGINT) % {steps} = {b}),
x{t} AS MATERIALIZED (SELECT post_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM e{t}),
z{t} AS MATERIALIZED (SELECT post_id, j, z, {_keep(f"'{t}'")} AS keep FROM (
  SELECT x.post_id, w.idx % 128 AS j, sum(x.x * w.val) + max(b.val) AS z FROM x{t} x JOIN t{t} w ON w.param = 'W1' AND w.idx // 128 = x.i
  JOIN t{t} b ON b.param = 'b1' AND b.idx = w.idx % 128 GROUP BY x.post_id, w.idx % 128)),
p{t} AS MATERIALIZED (SELECT o.post_id, e.label, {s.sigmoid('o.z')} AS p FROM (
  SELECT z.post_id, sum(greatest(z.z, 0.0) * z.keep * w.val) + max(b.val) AS z FROM z{t} z JOIN t{t} w ON w.param = 'w2' AND w.idx = z.j
  JOIN t{t} b ON b.param = 'b2' GROUP BY z.post_id) o JOIN e{t} e ON e.post_id = o.post_id),
d{t} AS MATERIALIZED (SELECT z.post_id, z.j, greatest(z.z, 0.0) * z.keep AS h, p.p - p.label AS d2,
  CASE WHEN z.z > 0 THEN (p.p - p.label) * w.val * z.keep ELSE 0.0 END AS dh
  FROM z{t} z JOIN p{t} p ON p.post_id = z.post_id JOIN t{t} w ON w.param = 'w2' AND w.idx = z.j),
n{t} AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p{t}),
g{t} AS MATERIALIZED (
  SELECT 'W1' AS param, x.i * 128 + d.j AS idx, sum(x.x * d.dh) / (SELECT n FROM n{t}) AS g FROM x{t} x JOIN d{t} d ON d.post_id = x.post_id GROUP BY x.i, d.j
  UNION ALL SELECT 'b1', j, sum(dh) / (SELECT n FROM n{t}) FROM d{t} GROUP BY j
  UNION ALL SELECT 'w2', j, sum(h * d2) / (SELECT n FROM n{t}) FROM d{t} GROUP BY j
  UNION ALL SELECT 'b2', 0, sum(p - label) / (SELECT n FROM n{t}) FROM p{t}),
l{t} AS MATERIALIZED (SELECT avg({_BCE}) AS loss FROM p{t}),
t{t + 1} AS MATERIALIZED (SELECT th.param, th.idx, th.val * {1 - lr * _WD!r} - {lr / bc1!r} * {m} / (sqrt({v}) / {float(bc2 ** 0.5)!r} + {_EPS!r}) AS val,
  {m} AS m, {v} AS v FROM t{t} th JOIN g{t} g ON g.param = th.param AND g.idx = th.idx)""")
    rows = " UNION ALL ".join(f"SELECT CAST({t // steps} AS INTEGER) AS epoch, CAST({t % steps} AS INTEGER) AS step, round(loss, 6) AS batch_loss FROM l{t}"
                              for t in range(epochs * steps))
    return with_(*parts) + rows


oracle("fit_head", _fit_head())
def _fit_text_lr(steps: int = 5, rate: float = 0.05, reg: float = 1e-4) -> str:
    """Full-batch Adam steps on the log-loss of word counts, written out one after another."""
    b1, b2, eps = 0.9, 0.999, 1e-8
    parts = [*BASE, f"""occ AS MATERIALIZED (SELECT post_id, label, term, count(*) AS tf FROM (
  SELECT post_id, label, unnest({s.terms('text', 'word')}) AS term FROM tr UNION ALL SELECT post_id, label, '' FROM tr) GROUP BY post_id, label, term)""",
             "size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tr)",
             "w0 AS MATERIALIZED (SELECT DISTINCT term, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM occ)"]
    for t in range(1, steps + 1):
        parts.append(f"""r{t} AS MATERIALIZED (SELECT post_id, {s.sigmoid('z')} - label AS r FROM (
  SELECT o.post_id, o.label, sum(o.tf * w.w) AS z FROM occ o JOIN w{t - 1} w USING (term) GROUP BY o.post_id, o.label)),
g{t} AS MATERIALIZED (SELECT w.term, w.w, w.m, w.v, s.g + CASE WHEN w.term = '' THEN 0 ELSE {reg!r} * w.w END AS g FROM w{t - 1} w JOIN (
  SELECT o.term, sum(o.tf * r.r) / (SELECT n FROM size) AS g FROM occ o JOIN r{t} r USING (post_id) GROUP BY o.term) s USING (term)),
m{t} AS (SELECT term, w, {b1!r} * m + {1 - b1!r} * g AS m, {b2!r} * v + {1 - b2!r} * g * g AS v FROM g{t}),
w{t} AS MATERIALIZED (SELECT term, w - {rate / (1 - b1 ** t)!r} * m / (sqrt(v) / {(1 - b2 ** t) ** 0.5!r} + {eps!r}) AS w, m, v FROM m{t})""")
    return with_(*parts) + f"SELECT term, round(w, 6) AS weight FROM w{steps}"


oracle("fit_text_lr", _fit_text_lr())

# ------------------------------------------------------------------ 2.9 sinks
oracle("write_results_csv", ORACLE["compare_with_ensemble"])
oracle("save_model", ORACLE["fit_text_nb"])
oracle("write_predictions", ORACLE["score_batched"])

# ------------------------------------------------------------------ 2.10 streaming
_ALLP = f"""allp AS (SELECT post_id, {s.clean_strong('text')} AS text, {s.encode_label_ci('"account.type"')} AS label
  FROM p WHERE coalesce(length({s.strip_ws('text')}) > 0, false))"""
_STREAM = with_(*BASE, _ALLP, s.all_models_wide(target="allp"), s.long_from_wide())
oracle("stream_predict", _STREAM + """SELECT post_id, model, label, round(p, 6) AS p, predicted,
  CASE WHEN predicted = 1 THEN 'Bot' ELSE 'Human' END AS prediction FROM lg""")
oracle("stream_metrics", _STREAM.rstrip() + ",\nlab AS (SELECT * FROM lg WHERE label IS NOT NULL)\n"
       + s.counts_by("lab"))
