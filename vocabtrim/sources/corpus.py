"""Corpus scans.

The labelled corpora of the reference (one table per task, split by name) are
stood in for by the driver tables:

* ``documents`` + ``labels`` -> single-text corpus; label = ``quality``, -1 when
  the document is not labelled; split = first hex digit of ``md5(doc_id)``
  (``0``-``d`` train, ``e`` validation, ``f`` test).
* ``conversations`` -> sentence-pair corpus: user turn *t* with the assistant
  turn *t+1* of the same conversation.

Schema: ``example_id LONG, split STRING, text_a STRING, text_b STRING, label DOUBLE``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_COLUMNS = ["example_id", "split", "text_a", "text_b", "label"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_split(id_col: Column) -> Column:
    """Deterministic, engine-portable split from the first md5 hex digit."""
    h = F.substring(F.md5(id_col.cast("string")), 1, 1)
    return (F.when(h < F.lit("e"), F.lit("train"))
             .when(h == F.lit("e"), F.lit("validation"))
             .otherwise(F.lit("test")))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_labels(spark, sf_dir, documents_texts(spark, sf_dir))


def documents_texts(spark: SparkSession, sf_dir: str, extra: Iterable[str] = ()) -> DataFrame:
    """The documents corpus without labels: what counting and encoding read, so that no
    join stands between the scan and the tokenizer.  ``extra`` columns come along."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"), hash_split(F.col("doc_id")).alias("split"), F.col("text").alias("text_a"),
        *extra)


GROUPS = ("lang", "source")


def lay_out(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the documents corpus with one folder a split, so that a scan of some splits
    reads no other file.  A table of fewer files than the session has cores is dealt over
    as many; larger ones are written as they are read, without a shuffle."""
    there = table(spark, sf_dir, "documents").columns
    docs = documents_texts(spark, sf_dir, [c for c in GROUPS if c in there])
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    docs.write.partitionBy("split").parquet(path)


def scan_layout(spark: SparkSession, path: str, groups: Iterable[str] = ()) -> DataFrame:
    """The corpus that :func:`lay_out` wrote, with some of its group columns; filters on
    ``split`` become partition filters."""
    schema = "example_id long, text_a string, " + "".join(f"{g} string, " for g in groups) + "split string"
    return spark.read.schema(schema).parquet(path)


def with_labels(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """Corpus rows of ``(example_id, split, text_a)`` with their label (see the module's head)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"), "quality")
    # labels is keyed by doc_id (at most one row per document): a left join keeps
    # every document exactly once; AQE broadcasts it when its runtime size is small.
    return (texts.join(labels, "example_id", "left")
                 .select("example_id", "split", "text_a", F.lit(None).cast("string").alias("text_b"),
                         F.coalesce(F.col("quality"), F.lit(-1)).cast("double").alias("label")))


def pair_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("text_a"))
    bot = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    ex = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    return (user.join(bot, ["conv_id", "turn"], "inner")
                .select(ex.alias("example_id"), hash_split(ex).alias("split"),
                        "text_a", "text_b", F.lit(-1.0).alias("label")))


def scan_corpus(corpus: DataFrame, splits: Iterable[str] | None = ("train",)) -> DataFrame:
    """Restrict a corpus to some splits (``None`` = all splits)."""
    if splits is None:
        return corpus
    return corpus.filter(F.col("split").isin(list(splits)))


def scan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows keyed by token id (``token_id INT, embedding ARRAY<FLOAT>``)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("token_id"), "embedding")


# Task registry of the reference (text columns, split names, label
# count, metric functions, size string) for the GLUE tasks it runs.
TASKS = [
    # task, dataset, text_a_col, text_b_col, train, valid, test, n_labels, metrics, size
    ("cola", "cola", "sentence", None, "train", "validation", "test", 2, ["matthews_corrcoef"], "8.5k"),
    ("sst2", "sst2", "sentence", None, "train", "validation", "test", 2, ["accuracy_score"], "67k"),
    ("mrpc", "mrpc", "sentence1", "sentence2", "train", "validation", "test", 2, ["accuracy_score", "f1_score"], "3.7k"),
    ("stsb", "stsb", "sentence1", "sentence2", "train", "validation", "test", 1, ["pearsonr", "spearmanr"], "7k"),
    ("qqp", "qqp", "question1", "question2", "train", "validation", "test", 2, ["f1_score", "accuracy_score"], "364k"),
    ("mnli-matched", "mnli", "premise", "hypothesis", "train", "validation_matched", "test_matched", 3, ["accuracy_score"], "393k"),
    ("mnli-mismatched", "mnli", "premise", "hypothesis", "train", "validation_mismatched", "test_mismatched", 3, ["accuracy_score"], "393k"),
    ("qnli", "qnli", "question", "sentence", "train", "validation", "test", 2, ["accuracy_score"], "105k"),
    ("rte", "rte", "sentence1", "sentence2", "train", "validation", "test", 2, ["accuracy_score"], "2.5k"),
    ("wnli", "wnli", "sentence1", "sentence2", "train", "validation", "test", 2, ["accuracy_score"], "634"),
]

TASK_SCHEMA = ("task string, dataset string, text_a_col string, text_b_col string, train string, "
               "valid string, test string, n_labels int, metrics array<string>, size string")


def task_metadata(spark: SparkSession) -> DataFrame:
    """The task registry as a small DataFrame (ten rows, broadcast in joins)."""
    return spark.createDataFrame(TASKS, TASK_SCHEMA)


def resolve_task(name: Column) -> Column:
    """S2 alias rule: ``mnli`` means ``mnli-matched`` (the dataset column maps ``mnli*`` to ``mnli``)."""
    lowered = F.lower(name)
    return F.when(lowered == "mnli", F.lit("mnli-matched")).otherwise(lowered)


def validation_split(task: Column) -> Column:
    """S3: name of the validation split (matched / mismatched / default)."""
    t = F.lower(task)
    return (F.when(t.contains("mismatched"), F.lit("validation_mismatched"))
             .when(t.startswith("mnli"), F.lit("validation_matched"))
             .otherwise(F.lit("validation")))
