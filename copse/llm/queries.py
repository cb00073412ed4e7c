"""One query for each operator of this subpackage, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm import anisotropic_ann, bpe_queue, chat_events, chosen_path, decontaminate, fill_in_middle, shard_store, source_mixing, substring_dedup, token_alignment, toxicity_fm, url_automaton, voronoi_knn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.voronoi_knn(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op3_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_wildcard_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.url_verdicts(_table(spark, sf_dir, "pages"))


def op5_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_ann.anisotropic_ann(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = source_mixing.domain_labels(_table(spark, sf_dir, "labels"))
    rates = source_mixing.mixing_rates(_table(spark, sf_dir, "documents"), labels, source_mixing.DOMAINS, source_mixing.TARGETS)
    return rates.select("doc_id", "tokens", *(F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(source_mixing.DOMAINS)), "rate")


def op7_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_queue.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.chosen_path_join(_table(spark, sf_dir, "documents")).drop("th", "component")


def op9_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_events.conversation_digests(_table(spark, sf_dir, "conversations"))


def op10_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_store.shard_digests(_table(spark, sf_dir, "documents"))


def op11_overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_broadcast_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_fingerprint_index": op2_fingerprint_index,
    "op3_factorization_machine": op3_factorization_machine,
    "op4_wildcard_automaton": op4_wildcard_automaton,
    "op5_anisotropic_ann": op5_anisotropic_ann,
    "op6_soft_membership_mixing": op6_soft_membership_mixing,
    "op7_rank_queue_bpe": op7_rank_queue_bpe,
    "op8_chosen_path_join": op8_chosen_path_join,
    "op9_chat_events": op9_chat_events,
    "op10_size_tiered_shards": op10_size_tiered_shards,
    "op11_overlapping_chunks": op11_overlapping_chunks,
    "op12_broadcast_ngrams": op12_broadcast_ngrams,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_voronoi_knn": voronoi_knn.ORACLE_SQL,
    "op4_wildcard_automaton": url_automaton.ORACLE_SQL,
    "op9_chat_events": chat_events.ORACLE_SQL,
    "op10_size_tiered_shards": shard_store.ORACLE_SQL,
    "op11_overlapping_chunks": fill_in_middle.ORACLE_SQL,
    "op12_broadcast_ngrams": decontaminate.ORACLE_SQL,
}
