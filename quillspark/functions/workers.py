"""What workers share: the package, and a folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a slice that a Python stage works on at a time; a larger row is a slice by itself, so a worker's memory is bounded by these and by the longest row.
ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 1 << 20
#: Rows of the Arrow batches that carry texts between the JVM and Python.
ARROW_ROWS = 1000
#: Bytes of a plan's input for each partition where rows are dealt out anew, so a task doesn't grow with the input.
BYTES_PER_PART = 32 << 20
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_folder: list[str] = []


def importable() -> None:
    """Let workers on this machine import the package wherever the driver was started; clusters get it by --py-files or an image."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext.master.startswith("local"):
        root, own = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        if root not in own.get("PYTHONPATH", "").split(":"):
            own["PYTHONPATH"] = f"{root}:{own.get('PYTHONPATH', '')}".rstrip(":")


def arrow_ready(spark: SparkSession) -> None:
    """Let workers import the package, and have Arrow batches of ARROW_ROWS rows where the session has Spark's default: of long texts, ten thousand rows are too much for an executor."""
    importable()
    if spark.conf.get(_ARROW) == "10000":
        spark.conf.set(_ARROW, str(ARROW_ROWS))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of ROWS_PER_BATCH rows and BYTES_PER_BATCH bytes of texts and binaries at most, a larger row alone."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    until = np.cumsum(size)
    at, n = 0, batch.num_rows
    while at < n:
        before = int(until[at - 1]) if at else 0
        end = min(n, at + ROWS_PER_BATCH, max(at + 1, int(np.searchsorted(until, before + BYTES_PER_BATCH, "right"))))
        yield batch.slice(at, end - at)
        at = end


def parts(df: DataFrame, each: int | None = None) -> int:
    """How many partitions df needs if each gets so many bytes of what it is read from, BYTES_PER_PART by default; 0 if Spark doesn't know, as of rows that the driver sent. Joins don't count: Spark takes their sizes for products."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return 0 if size > 1 << 55 else max(1, -(-size // (each or BYTES_PER_PART)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local sessions without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return _own_folder[0]
