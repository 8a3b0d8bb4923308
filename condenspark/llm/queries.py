"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condenspark.llm.chat_format import format_chats
from condenspark.llm.common import table
from condenspark.llm.decontamination import decontaminate
from condenspark.llm.jaccard_join import jaccard_components
from condenspark.llm.language_id import held_out as language_held_out
from condenspark.llm.language_id import identify
from condenspark.llm.license_scan import scan_licenses
from condenspark.llm.packing import pack
from condenspark.llm.prefix_trie import prefix_trie
from condenspark.llm.quality import classify_quality
from condenspark.llm.secret_scan import scan_secrets
from condenspark.llm.sharding import interleave
from condenspark.llm.topk_search import top_k
from condenspark.llm.toxicity import held_out, score_toxicity
from condenspark.llm.vector_codes import compress


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleave(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    c = "contamination"
    return found.select(
        "doc_id", f"{c}.n_words", f"{c}.n_hit", F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{c}.items", ",").cast("binary"), 256).alias("items_sha256"), f"{c}.contaminated",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", language_held_out().alias("held_out"), "lang_pred", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), graft=(100, 6))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"))
    return found.rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_license_scan, op4_decontamination, op5_quality, op6_packing, op7_secret_scan, op8_topk_search, op9_jaccard_join, op10_chat_format, op11_language_id, op12_prefix_trie, op13_vector_codes)}
