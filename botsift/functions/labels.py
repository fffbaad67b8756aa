"""Label and text-type expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Author types and their numeric classes (positive class = machine-written).
HUMAN, BOT = "human", "bot"
HUMAN_ID, BOT_ID = 0, 1
# Names shown for a predicted class.
DISPLAY = {0: "Human", 1: "Bot"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_label_ci(c) -> Column:
    """Lower-case, then human -> 0, bot -> 1, anything else -> null. No strip: ' bot' -> null."""
    low = F.lower(_c(c))
    return F.when(low == HUMAN, F.lit(HUMAN_ID)).when(low == BOT, F.lit(BOT_ID)).cast("int")


def encode_label_cs(c) -> Column:
    """Case-sensitive variant: 'Bot' -> null."""
    v = _c(c)
    return F.when(v == HUMAN, F.lit(HUMAN_ID)).when(v == BOT, F.lit(BOT_ID)).cast("int")


def encode_label(c, case_sensitive: bool = False) -> Column:
    return encode_label_cs(c) if case_sensitive else encode_label_ci(c)


def label_as_int(c, name: str = "label") -> Column:
    """Numeric label to int; a null or a non-number stops the job (ANSI-style strict cast)."""
    v = _c(c)
    casted = F.try_cast(v, "int") if hasattr(F, "try_cast") else v.try_cast("int")
    return F.when(casted.isNull(), F.raise_error(F.concat(F.lit(f"{name}: not an integer: "),
                                                        F.coalesce(v.cast("string"), F.lit("null")))))\
        .otherwise(casted).cast("int")


NULL_TEXT_MODES = ("drop", "nan", "empty")


def text_as_string(c, null_text: str = "drop") -> Column:
    """Text to string. A missing text stays null, so that the row can be dropped; with 'nan' it becomes
    that word (what ``astype(str)`` gives a NaN), with 'empty' the empty text."""
    v = _c(c).cast("string")
    if null_text == "nan":
        return F.coalesce(v, F.lit("nan"))
    if null_text == "empty":
        return F.coalesce(v, F.lit(""))
    if null_text == "drop":
        return v
    raise ValueError(f"null_text must be one of {NULL_TEXT_MODES}")


def decode_label(c) -> Column:
    """1 -> Bot, 0 -> Human."""
    v = _c(c)
    return F.when(v == 1, F.lit(DISPLAY[1])).when(v == 0, F.lit(DISPLAY[0]))
