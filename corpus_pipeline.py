"""The corpus pipeline: toxic documents go, near copies and benchmark passages go, personal data is replaced, and the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, pii, simhash, toxicity
from quillspark.llm.shared import new_path, numbered, read, stage_table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, by a model of the labelled ones among docs.

    Decided row by row: a null or empty text has no hits and stays, repeated rows go or stay together, a long text counts by its worst passage.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest id, of equal ids the first by its place in the files.

    Decided row by row, whatever ids are shared or null: repeated rows leave one; null and empty texts are copies of each other; ids come before no id.
    """
    rows, row = numbered(docs)
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    fps = stage_table(simhash.fingerprints(rows.select(id_.alias("id"), "text"), "id"), "pipeline-fps")
    classes = stage_table(simhash.classes_of(fps, F.min("id")), "pipeline-classes")
    copies = simhash.by_key(fps, classes, "fp", fps.count()).where(F.col("id")[row] != F.col("chosen")[row])
    return without(rows, row, copies.select(F.col("id")[row].alias(row))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item.

    Decided row by row, whatever ids are shared or null; null and empty texts hold nothing and stay; a long text goes as a whole.
    """
    rows, row = numbered(docs)
    found = decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"), id_col=row)
    return without(rows, row, found.select(F.col("doc_id").alias(row))).select(docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text, null with it. No row goes; equal texts are changed alike."""
    return pii.redact_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and digests by which the round trip can be checked; a null text has none, like an empty one."""
    return bpe.encode_documents(docs, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal),
    ("bpe", encode),
]

#: SQL cannot express the learned and iterative stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
