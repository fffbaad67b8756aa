"""Column-name handling (P1-P3) and peeking (S4). All of it is metadata plus a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidate names, in priority order only as a tie-break rule of "first in table order".
TEXT_CANDIDATES = ("text", "tweet", "tweet_text", "content")
LABEL_CANDIDATES = ("account.type", "account_type", "type", "label", "class")


def q(name: str) -> str:
    """Back-quote a column name (names such as ``account.type`` contain a dot)."""
    return "`" + name.replace("`", "``") + "`"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip and lower-case every column name; two columns that end up equal are an error."""
    new = [c.strip().lower() for c in df.columns]
    seen = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {old!r} both normalise to {n!r}")
        seen[n] = old
    return df.toDF(*new)


def detect_columns(columns, text_candidates=TEXT_CANDIDATES, label_candidates=LABEL_CANDIDATES):
    """First column in table order that is a text name, and first that is a label name."""
    text_col = next((c for c in columns if c in text_candidates), None)
    label_col = next((c for c in columns if c in label_candidates), None)
    if text_col is None:
        raise ValueError(f"no text column among {list(columns)}; expected one of {text_candidates}")
    if label_col is None:
        raise ValueError(f"no label column among {list(columns)}; expected one of {label_candidates}")
    return text_col, label_col


def select_detected(df: DataFrame, keep=("post_id",)) -> DataFrame:
    """Project the key columns plus the detected text and label columns, names unchanged."""
    text_col, label_col = detect_columns(df.columns)
    keep = [k for k in keep if k in df.columns]
    return df.select(*[F.col(q(k)) for k in keep], F.col(q(text_col)), F.col(q(label_col)))


def select_text_label(df: DataFrame, text_col: str | None = None, label_col: str | None = None,
                      keep=("post_id",)) -> DataFrame:
    """Keep the two columns (detected unless named) and rename them to ``text`` and ``label``."""
    if text_col is None or label_col is None:
        t, lab = detect_columns(df.columns)
        text_col, label_col = text_col or t, label_col or lab
    keep = [k for k in keep if k in df.columns and k not in ("text", "label")]
    return df.select(*[F.col(q(k)) for k in keep],
                     F.col(q(text_col)).alias("text"), F.col(q(label_col)).alias("label"))


def schema_peek(df: DataFrame, n: int = 5, order_by=("post_id",)) -> DataFrame:
    """The first ``n`` rows in a repeatable order (a top-n, not a full sort)."""
    cols = [F.col(q(c)) for c in order_by if c in df.columns]
    return (df.orderBy(*cols) if cols else df).limit(n)
