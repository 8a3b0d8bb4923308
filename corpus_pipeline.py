"""From raw documents to packed token sequences: STAGES, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condenspark.llm.common import materialise, table, unused
from condenspark.llm.decontamination import decontaminate
from condenspark.llm.jaccard_join import jaccard_components
from condenspark.llm.packing import pack
from condenspark.llm.secret_scan import redact
from condenspark.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; clean ones stay as they are. Null and empty texts have no toxic word and stay. Rows with equal texts go or stay
    together; repeated rows and null doc_ids stay. An empty table stays empty. Other columns stay too, also toxicity and toxic."""
    names = {c: f"__own_{c}" for c in ("toxicity", "toxic") if c in docs.columns}
    scored = score_toxicity(docs.withColumnsRenamed(names), table(spark, sf_dir, "labels")).where("not toxic").drop("toxicity", "toxic")
    return scored.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity of 0.8 or more) the row with the least doc_id stays; among rows of
    one doc_id the least text, and rows without doc_id come last. Rows with nothing in common all stay, also under one doc_id; of rows
    with no words, which have no copies, all stay."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        found = jaccard_components(docs, width=5, percent=80)
        return docs.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    row = unused(docs, "__row")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = jaccard_components(keyed.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80)
    rows = keyed.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text")
    least = F.struct(F.col("id").isNull(), "id", "text", "row")
    kept = found.select(F.col("doc_id").alias("row"), "component_id").join(rows, "row").groupBy("component_id").agg(F.min_by("row", least).alias(row))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; documents with a few hit words (less than one in 20) stay whole. Null and empty texts have no words and
    stay; repeated rows and null doc_ids stay or go by their text. Items without text or words count for nothing. Other columns stay."""
    names = {"contamination": "__own_contamination"} if "contamination" in docs.columns else {}
    found = decontaminate(docs.withColumnsRenamed(names), table(spark, sf_dir, "benchmark")).where("not contamination.contaminated").drop("contamination")
    return found.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows. Null and empty texts stay as they are; a null source
    counts as no path. Repeated rows are treated alike; order and other columns stay."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences, with their token ids. Null and empty texts are the end id alone; repeated rows and rows
    without doc_id are packed each for itself; an empty table gives no rows. Other columns than doc_id and text are not kept."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The learned stages (toxicity, secrets) and the tokenizer are beyond SQL: tests compare run() on the smallest tables with near duplicates,
#: contamination, redaction and ids by brute force (toxicity by its operator's own scores, which are held against labels).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
