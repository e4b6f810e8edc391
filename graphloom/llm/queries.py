"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, chat, ftrl_quality, grid_join, jaccard, packing, rules, shards, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file that the contracts name; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.as_tool_messages(table(spark, sf_dir, "conversations")), chat.SAY)


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), 3, 90).drop("mark")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_tool_calls": op2_tool_calls,
    "op3_ftrl_quality": op3_ftrl_quality,
    "op4_bpe": op4_bpe,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_quality_rules": op9_quality_rules,
    "op10_grid_order_join": op10_grid_order_join,
}
