"""Vocabulary and id encoding.

Tokens are the words of the cleaned text. The vocabulary holds every training token, numbered by
(count desc, token asc) after the special ids (pad 0, unknown 1, start 2, end 3); a caller may ask for the
top ``size`` only. Encoding covers the whole post unless a ``max_len`` is given; ids are looked up by a
broadcast of the vocabulary within the checked bounds and by broadcast of its most frequent tokens plus a shuffle join beyond
them, and put back in order of position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.config import END_ID, MAX_LEN, N_SPECIAL, PAD_ID, START_ID, UNK_ID
from botsift.functions.terms import words
from botsift.operators.heavy import top_counts
from botsift.operators.joins import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, hot_and_tail, join_terms
from botsift.operators.rank import by_row, global_rank
from botsift.session import materialize


def build_vocab(train: DataFrame, size: int | None = None, text_col: str = "text") -> DataFrame:
    """(token, id, n) of every training token, or of the ``size`` most frequent ones (:mod:`botsift.operators.heavy`: the
    others aren't shuffled). Ids are ranks over range partitions (no single-partition window). Materialised once so
    every encoder reuses the same ids."""
    if size is not None:
        counts = top_counts(train, words(text_col), size)
    else:
        counts = (train.select(F.explode_outer(words(text_col)).alias("token")).filter(F.col("token").isNotNull())
                  .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = global_rank(counts, [F.desc("n"), F.asc("token")], "rank")
    return materialize(ranked.select("token", (F.col("rank") + N_SPECIAL - 1).cast("int").alias("id"),
                                     F.col("n").cast("bigint").alias("n")), "vocab")


def encode_ids(df: DataFrame, vocab: DataFrame, max_len: int | None = None, key: str = "post_id",
               text_col: str = "text", carry=(), max_rows: int = MAX_BROADCAST_ROWS,
               max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(key, input_ids): [start] + ids of the tokens (unknown id if not in the vocabulary) + [end];
    of all tokens, or of the first max_len-2. Unpadded; see :func:`pad_and_mask`."""
    carry = [c for c in carry if c in df.columns]
    tokens = words(text_col) if max_len is None else F.slice(words(text_col), 1, max_len - 2)
    rows = by_row(df, list(dict.fromkeys([key, *carry, text_col])))      # regroup per row, not per key
    toks = (rows.select("_rid", key, *carry, tokens.alias("_w"))
            .select("_rid", key, *carry, F.posexplode_outer("_w").alias("pos", "token")))
    hot, tail = hot_and_tail(vocab, "token", "n", max_rows, max_bytes)
    joined = join_terms(toks, hot, tail, ["token"], "id", ["_rid", "pos"])
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("id")))
    grouped = joined.groupBy("_rid", key, *carry).agg(F.array_sort(F.collect_list(item)).alias("_ids"))
    ids = F.concat(F.array(F.lit(START_ID)), F.col("_ids")["id"], F.array(F.lit(END_ID)))
    return grouped.select(key, *carry, ids.cast("array<int>").alias("input_ids"))


def pad_and_mask(ids_col: str = "input_ids", max_len: int = MAX_LEN):
    """(padded ids, attention mask): exactly ``max_len`` long, mask 1 = real, 0 = pad."""
    ids = F.col(ids_col)
    n_pad = F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))
    padded = F.concat(ids, F.array_repeat(F.lit(PAD_ID), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n_pad))
    return padded.alias("input_ids"), mask.alias("attention_mask")


def length_profile(df: DataFrame, max_len: int = MAX_LEN, text_col: str = "text") -> DataFrame:
    """How many posts are truncated and how much of the fixed length is padding."""
    n_tok = F.size(words(text_col))
    n_ids = F.least(n_tok, F.lit(max_len - 2)) + 2
    staged = df.select(n_tok.alias("_t"), n_ids.alias("_i"))
    return staged.agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum(F.when(F.col("_t") > max_len - 2, 1).otherwise(0)).cast("bigint").alias("n_truncated"),
        F.max("_t").cast("bigint").alias("max_tokens"),
        F.round(F.avg("_i"), 6).alias("avg_ids"),
        F.round(F.sum(F.lit(max_len) - F.col("_i")) / (F.count(F.lit(1)) * max_len), 6).alias("pad_share"),
    )
