"""DuckDB SQL fragments for the oracle queries (same rules as the Spark Column functions).

The character classes are those of ``botsift.functions.text`` written in RE2 syntax.
Doubles are rounded to 6 digits on both sides; counts and sums are cast to BIGINT.
"""

from __future__ import annotations

# Python str.isspace() characters as an RE2 class body (same set as botsift WS).
WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip_urls(e: str) -> str:
    return f"regexp_replace({e}, 'http[^{WS}]+', '', 'g')"


def strip_tags(e: str) -> str:
    return f"regexp_replace({e}, '<[^\\n]*?>', '', 'g')"


def strip_non_letters(e: str) -> str:
    return f"regexp_replace({e}, '[^a-zA-Z{WS}]', '', 'g')"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lower_strip(e: str) -> str:
    return strip_ws(f"lower({e})")


def clean_strong(e: str) -> str:
    return lower_strip(strip_non_letters(strip_tags(strip_urls(e))))


def clean_light(e: str) -> str:
    return lower_strip(strip_tags(strip_urls(e)))


def clean(e: str, profile: str = "strong") -> str:
    return {"strong": clean_strong, "light": clean_light, "raw": lambda x: x}[profile](e)


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '[{WS}]+'), lambda x: x <> '')"


def bigrams_of(w: str) -> str:
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


def trigrams(e: str) -> str:
    return (f"list_filter(list_transform(range(1, length({e}) - 1), lambda i: substr({e}, i, 3)), "
            f"lambda g: regexp_matches(g, '[^{WS}]'))")


def terms(e: str, kind: str) -> str:
    if kind == "word":
        return words(e)
    if kind == "bigram":
        return bigrams_of(words(e))
    if kind == "trigram":
        return trigrams(e)
    raise ValueError(kind)


def sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1.0 / (1.0 + exp(-({z}))) ELSE exp({z}) / (1.0 + exp({z})) END)"


def encode_label_ci(e: str) -> str:
    return f"(CASE WHEN lower({e}) = 'human' THEN 0 WHEN lower({e}) = 'bot' THEN 1 END)"


def encode_label_cs(e: str) -> str:
    return f"(CASE WHEN {e} = 'human' THEN 0 WHEN {e} = 'bot' THEN 1 END)"


def hex_uniform(h: str) -> str:
    return f"(CAST(('0x' || substr({h}, 1, 8)) AS BIGINT) / 4294967296.0)"


# ---------------------------------------------------------------- views (FIXTURES §2)

P = """p AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS post_id, text,
         CASE WHEN role = 'user' THEN (CASE WHEN turn % 4 = 0 THEN 'Human' ELSE 'human' END)
              WHEN role = 'assistant' THEN (CASE WHEN conv_id % 7 = 0 THEN 'BOT' ELSE 'bot' END)
              ELSE role END AS "account.type"
  FROM conversations)"""

P0 = P + """,
p0 AS (SELECT post_id, CASE WHEN length(text) % 50 = 0 THEN NULL ELSE text END AS text, "account.type" FROM p)"""

H = """h AS (SELECT CAST(page_id AS VARCHAR) AS post_id, url || ' ' || html AS text FROM pages)"""

L = """l AS (SELECT CAST(d.doc_id AS VARCHAR) AS post_id, d.text, CAST(1 - lb.quality AS INTEGER) AS label
          FROM documents d JOIN labels lb ON d.doc_id = lb.doc_id)"""

E = """e AS (SELECT vec_id AS post_id, embedding, CAST(label >= 5 AS INTEGER) AS label FROM embeddings)"""


def labelled(profile: str = "strong", case_sensitive: bool = False, src: str = "p", name: str = "lp") -> str:
    enc = encode_label_cs if case_sensitive else encode_label_ci
    return f"""{name} AS (
  SELECT post_id, {clean('text', profile)} AS text, label FROM (
    SELECT post_id, text, {enc('"account.type"')} AS label FROM {src})
  WHERE post_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL)"""


def split_ctes(src: str = "lp", seed: int = 42, share: float = 0.2, name: str = "sp") -> str:
    """Exact stratified split by md5 order (the full-window form of the same contract)."""
    return f"""{name}_k AS (SELECT *, md5('{seed}:' || post_id) AS h FROM {src}),
{name}_cnt AS (SELECT label, count(*) AS n_c FROM {name}_k GROUP BY label),
{name}_tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST({share} AS DOUBLE) * sum(n_c)) AS BIGINT) AS t FROM {name}_cnt),
{name}_q0 AS (SELECT c.label, (tt.t * c.n_c) // tt.n AS fl, (tt.t * c.n_c) % tt.n AS rem, tt.t AS t
              FROM {name}_cnt c JOIN {name}_tot tt ON TRUE),
{name}_q1 AS (SELECT label, fl, t - sum(fl) OVER () AS r, row_number() OVER (ORDER BY rem DESC, label) AS rk
              FROM {name}_q0),
{name}_q AS (SELECT label, fl + CASE WHEN rk <= r THEN 1 ELSE 0 END AS q FROM {name}_q1),
{name} AS (SELECT k.* EXCLUDE (h),
             CASE WHEN row_number() OVER (PARTITION BY k.label ORDER BY k.h, k.post_id) <= qq.q
                  THEN 'test' ELSE 'train' END AS split
           FROM {name}_k k JOIN {name}_q qq ON k.label = qq.label)"""


def nb_fit(kind: str, name: str, train: str = "tr") -> str:
    """CTEs {name}_w(term, weight) and {name}_b(bias)."""
    return f"""{name}_t AS (SELECT label, unnest({terms('text', kind)}) AS term FROM {train}),
{name}_c AS (SELECT term, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS c1,
                    sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS c0 FROM {name}_t GROUP BY term),
{name}_tot AS (SELECT sum(c1) AS t1, sum(c0) AS t0, count(*) AS v FROM {name}_c),
{name}_w AS (SELECT term, ln((c1 + 1) / CAST(t1 + v AS DOUBLE)) - ln((c0 + 1) / CAST(t0 + v AS DOUBLE)) AS weight
             FROM {name}_c JOIN {name}_tot ON TRUE),
{name}_b AS (SELECT ln(CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE)
                       / sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)) AS bias FROM {train})"""


def nb_score(kind: str, name: str, target: str) -> str:
    """CTE {name}_z(post_id, z) over every post of ``target``."""
    return f"""{name}_x AS (SELECT post_id, unnest({terms('text', kind)}) AS term FROM {target}),
{name}_s AS (SELECT x.post_id, sum(w.weight) AS s FROM {name}_x x JOIN {name}_w w ON x.term = w.term GROUP BY x.post_id),
{name}_z AS (SELECT t.post_id, b.bias + coalesce(s.s, 0.0) AS z
             FROM {target} t LEFT JOIN {name}_s s ON t.post_id = s.post_id JOIN {name}_b b ON TRUE)"""


REGISTRY = (("nb_word", "word"), ("nb_bigram", "bigram"), ("nb_trigram", "trigram"))


def all_models_wide(target: str = "te", train: str = "tr", name: str = "wide", extra: str = "") -> str:
    """CTE {name}(post_id, label, p_nb_word, p_nb_bigram, p_nb_trigram, p_style) (unrounded)."""
    parts = []
    for m, kind in REGISTRY:
        parts.append(nb_fit(kind, m, train))
        parts.append(nb_score(kind, m, target))
    cols = ", ".join(f"{sigmoid(f'{m}_z.z')} AS p_{m}" for m, _ in REGISTRY)
    joins = " ".join(f"JOIN {m}_z ON {m}_z.post_id = t.post_id" for m, _ in REGISTRY)
    style = sigmoid("(length(t.text) - 250.0) / 100.0")
    parts.append(f"""{name} AS (SELECT t.post_id, t.label{extra}, {cols}, {style} AS p_style FROM {target} t {joins})""")
    return ",\n".join(parts)


MODEL_NAMES = [m for m, _ in REGISTRY] + ["style"]


def long_from_wide(wide: str = "wide", name: str = "lg", ensemble: bool = False, extra: str = "") -> str:
    names = MODEL_NAMES + (["ENSEMBLE"] if ensemble else [])
    ens = ""
    if ensemble:
        ens = f", ({' + '.join('p_' + m for m in MODEL_NAMES)}) / {float(len(MODEL_NAMES))} AS p_ENSEMBLE"
    sel = " UNION ALL ".join(
        f"SELECT post_id, label{extra}, '{m}' AS model, p_{m} AS p FROM {wide}_e" for m in names)
    return f"""{wide}_e AS (SELECT *{ens} FROM {wide}),
{name} AS (SELECT *, CAST(p > 0.5 AS INTEGER) AS predicted FROM ({sel}))"""


def counts_by(src: str, by: str = "model") -> str:
    return f"""SELECT {by},
  CAST(sum(CASE WHEN label = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label = 0 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND predicted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 0 AND predicted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM {src} GROUP BY {by}"""


def ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0.0), 0.0)"


def metrics_select(by: str = "model") -> str:
    return (f"{by}, round({ratio('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, "
            f"round({ratio('tp', 'tp + fp')}, 6) AS precision, round({ratio('tp', 'tp + fn')}, 6) AS recall, "
            f"round({ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# the standard chain: posts -> labelled -> split -> train/test parts
BASE = [P, labelled(), split_ctes(), "tr AS (SELECT * FROM sp WHERE split = 'train')",
        "te AS (SELECT * FROM sp WHERE split = 'test')"]
