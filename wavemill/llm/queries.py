"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavemill.llm import audit, trie, warc
from wavemill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embeddings_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import covertree

    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op3_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, word_bpe_path()))


def op4_passages_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import passages

    return passages.find(table(spark, sf_dir, "documents"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op7_language_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op8_decontaminate_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark")))


def op9_shard_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import shards

    return shards.assign(table(spark, sf_dir, "documents"))


def op10_licence_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import licences

    return licences.scan(licences.with_path(table(spark, sf_dir, "documents")))


def op11_main_text_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.llm import main_text

    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_embeddings_cover_tree": op1_embeddings_cover_tree,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_bpe_forced_boundaries": op3_bpe_forced_boundaries,
    "op4_passages_collinear_chains": op4_passages_collinear_chains,
    "op5_quality_crf": op5_quality_crf,
    "op6_near_duplicates_superminhash": op6_near_duplicates_superminhash,
    "op7_language_naive_bayes": op7_language_naive_bayes,
    "op8_decontaminate_aho_corasick": op8_decontaminate_aho_corasick,
    "op9_shard_sampled_splitters": op9_shard_sampled_splitters,
    "op10_licence_tfidf": op10_licence_tfidf,
    "op11_main_text_lstm": op11_main_text_lstm,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_derivatives": warc.oracle_sql(),
    "op12_conversation_trie": trie.oracle_sql(),
    "op13_filter_audit": audit.oracle_sql(),
}
