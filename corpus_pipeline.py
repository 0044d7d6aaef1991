"""Training-data pipeline over ``documents``: five stages, each a table for the next.

1. quality: documents that the discriminant classifier rejects go.
2. near_dedup: one document of each class of near duplicates stays.
3. substring_dedup: passages of 50 words or more that stand in a document of smaller doc_id
   are cut out; a document that loses nothing keeps its text as it was.
4. decontamination: documents that hold a benchmark window go.
5. packing: what is left becomes token sequences.

All but the last return the columns of ``documents`` (n_chars follows the text). Cases are
those of the operators; null and empty texts pass stages 2 to 4 and give the end token in 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.session import broadcast_if_small, fresh_path
from lectern.llm import decontaminate, near_dup, packing, quality_qda, substring_dedup


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_qda.classify(docs, labels, keep=docs.columns)
    return judged.where("predicted = 1").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dup.classes(docs, keep=_others(docs)).kept_documents()
    return kept.select("doc.*", "text").select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(docs, keep=_others(docs), with_text=True)
    kept = found.select("doc.*", F.col("kept_text").alias("text"), "n_removed")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts stay out of the index: the few contaminated rows are named by doc_id and digest, and taken out."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.withColumn("_digest", F.sha2("text", 256))
    found = decontaminate.decontaminate(named.select("doc_id", "text", "_digest"), items, keep=("doc_id", "_digest"))
    hit = found.where("contaminated").select(F.col("doc.doc_id").alias("_id"), F.col("doc._digest").alias("_hit")).distinct()
    same = named["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_hit"))
    return named.join(broadcast_if_small(hit), same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = packing.pack(docs, keep=("doc_id",), added_tokens=True)
    return placed.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: no SQL can express the classifier, the sampling and the tokenizer; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
