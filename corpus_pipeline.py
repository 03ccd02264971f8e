"""From documents to packed sequences: each stage reads what the one before wrote.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. NULL texts are empty; repeated rows, ties, empty tables and extra columns are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontam, minhash, packing, pii, quality
from faultline.llm.common import materialise, read
from faultline.llm.encoding import library_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select(*COLUMNS, F.col("text").alias("_body")), model, text="_body").filter("predicted = 1").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id where ids are unique.

    Texts are what is compared: of repeated rows one stays, rows that share an id are judged by their own
    texts, and a row without an id goes like any other if its text has a class.
    """
    classes, _ = minhash.text_classes(docs)
    kept = materialise(classes.filter("stands").select("digest", F.col("id").alias("_id")), "kept")
    rows = docs.select(*COLUMNS, minhash.text_digest().alias("digest")).join(kept, "digest").filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    return rows.dropDuplicates(["digest"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark; texts are judged, so ids may be missing or repeated."""
    rows = docs.select(*COLUMNS, minhash.text_digest().alias("digest"))
    found = decontam.contaminated(rows, read(spark, sf_dir, "benchmark"), doc_id="digest").select(F.col("doc_id").alias("digest")).distinct()
    return rows.join(materialise(found, "contaminated"), "digest", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind in square brackets."""
    found = pii.personal_data(docs.select(*COLUMNS), keep_text=True)
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(pii.redacted(F.col("text"), F.col("spans")))
    return found.select("doc_id", clean.alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in the sequences."""
    return packing.pack(docs, library_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# A fitted classifier, signatures and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
