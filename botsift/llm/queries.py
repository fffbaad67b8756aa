"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.llm import (
    context_tree,
    decontamination,
    lexical_search,
    packing,
    prefix_trie,
    quality,
    sentencepiece_codec,
    simhash,
    suffix_dedup,
    topk,
    toxicity,
    url_filter,
    warc,
)
from botsift.sources.tables import read_table, spread


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(spread(read_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.remove_repeats(spread(read_table(spark, sf_dir, "documents"))))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark")
    return decontamination.report(decontamination.contamination(docs, benchmark))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(spread(read_table(spark, sf_dir, "pages")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, vocabulary()))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spread(read_table(spark, sf_dir, "pages")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(read_table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(spread(read_table(spark, sf_dir, "documents")))
    return lexical_search.search(index, read_table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.conversation_trie(spread(read_table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree": op1_context_tree,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_topk": op5_topk,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_packing": op11_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op5_topk": topk.ORACLE,
    "op6_decontamination": decontamination.oracle(),
    "op7_warc": warc.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
