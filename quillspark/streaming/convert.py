"""Pages as they come: a file stream of recognitions to an append-only manifest, a page's outcome written before the next batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.workers import arrow_ready
from quillspark.operators.manifest import pending
from quillspark.plans.convert import outcomes

INPUT = "page INT, markup STRING, inventory_raw STRING, error STRING"


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_stream(pages: DataFrame, emit: Callable[[DataFrame], DataFrame], manifest: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop. A batch's outcomes, with their text, are a written table of its number before the manifest has them:
    a batch that a restart repeats replaces its own rows in both. Pages that other batches finished are left out, and pages
    with an error come again when they are sent again."""
    arrow_ready(pages.sparkSession)  # batches have a session of their own, with the settings that this one has when the stream starts
    table = f"{manifest}-outcomes"

    def write(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{table}/batch={number}"
        before = written(spark, table)
        if before is not None:
            batch = pending(batch, before.where(F.col("batch") != number).select("page", "error"))
        outcomes(emit(batch)).write.mode("overwrite").parquet(own)
        done = spark.read.parquet(own)
        done.drop("text").write.mode("overwrite").json(f"{manifest}/batch={number}")
        if on_batch:
            on_batch(done, number)

    query = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not be there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stream_outcomes(spark: SparkSession, manifest: str) -> DataFrame:
    """What a stream has written, with the pages' text."""
    return spark.read.parquet(f"{manifest}-outcomes")


def undecided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """A stream of findings (page, finding, line) without those that a written log has decided: a stream-static anti-join."""
    own = decisions.where("verdict <> 'skipped'").select(F.col("page").alias("p"), F.col("finding").alias("f"), F.col("line").alias("l")).distinct()
    return findings.join(own, (F.col("page") == F.col("p")) & (F.col("finding") == F.col("f")) & F.col("line").eqNullSafe(F.col("l")), "left_anti")


def effort_by_window(log: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """An extension: seconds of reviewing by event-time window, with a watermark. log: (at, verdict, seconds), at in epoch seconds."""
    timed = log.withColumn("t", F.timestamp_seconds("at")).withWatermark("t", late)
    return timed.groupBy(F.window("t", width), "verdict").agg(F.count(F.lit(1)).alias("rows"), F.sum("seconds").alias("seconds"))
