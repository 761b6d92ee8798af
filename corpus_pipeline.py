"""Training-data pipeline: documents -> packed sequences, one operator a stage.

Each stage reads what the one before wrote.  ``run`` writes every result as Parquet
in the shared checkpoint folder and returns the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabtrim.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup
from vocabtrim.llm.common import table, whole_row, written

#: Of the strings of 51 words that two given documents share, 99 % have 264 bytes or more; much
#: shorter strings also repeat by chance.
REPEAT_BYTES = 260


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class (3-word shingles, 3 bits): that of the smallest id,
    null last.  Rows are told apart by a number of their own, not by their id."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("doc")), "numbered")
    classes = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")),
                                      shingle=3, max_distance=3)
    named = classes.select(F.col("doc_id").alias("row"), "component_id").join(
        rows.select("row", F.col("doc.doc_id").alias("id")), "row")
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = named.groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.row").alias("row"))
    return rows.join(first, "row", "left_semi").select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of ``REPEAT_BYTES`` that also start elsewhere."""
    out = suffix_dedup.deduplicated(docs, length=REPEAT_BYTES)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates),
          ("suffix-array dedup", repeated_passages), ("benchmark decontamination", decontamination),
          ("best-fit packing", packed)]

#: SQL has neither the tokenizer nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
