"""Helpers that the corpus operators share: the shared folder, written tables, row-wise Python."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions.workers import ARROW_ROWS, BYTES_PER_BATCH, ROWS_PER_BATCH, arrow_ready, shared_folder, slices  # noqa: F401

#: Rows of a file of a written table of a few numbers a row.
ROWS_PER_FILE = 1 << 16
#: Words of row numbers that are broadcast at most: 64 million rows, some 60 MB.
MOST_WORDS = 1 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_files(df: DataFrame, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """df, which has at most `rows` rows, in at most a partition for each per_file of them: a small table is not written as a file per partition of a shuffle."""
    return df.coalesce(max(1, -(-rows // per_file)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """df with one more column, and its name: a number (file, at) of each row that stays the same however often the table is read.

    The number is the row's place in its Parquet file, the file by a 64-bit hash of its path; a df that is no table of files is written first.
    """
    row = free_name(df, "row")

    def placed(table: DataFrame) -> DataFrame:
        own = table.metadataColumn("_metadata")
        out = table.withColumn(row, F.struct(F.xxhash64(own["file_path"]).alias("file"), own["row_index"].alias("at")))
        return out if out.columns else out  # resolves the names, or raises

    try:
        return placed(df), row
    except AnalysisException:
        return placed(stage_table(df, name)), row


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def without(df: DataFrame, row: str, away: DataFrame) -> DataFrame:
    """df, numbered by its column row, without the rows whose numbers are in the column row of away.

    The numbers become bits, a word for 64 rows that follow each other in a file. Up to MOST_WORDS words are broadcast, so
    texts stay where they are; beyond, rows and words are joined by shuffle.
    """
    of, bits = free_name(df, "of"), free_name(df, "bits")
    word = lambda at: F.floor(at / 64).cast("long")
    numbers = away.select(F.col(row)["file"].alias("file"), F.col(row)["at"].alias("at"))
    words = numbers.groupBy(F.struct("file", word(F.col("at")).alias("word")).alias(of)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias(bits))
    words = stage_table(in_files(words, df.count()), "rows-away")
    own = df.withColumn(of, F.struct(F.col(row)["file"].alias("file"), word(F.col(row)["at"]).alias("word")))
    joined = own.join(F.broadcast(words) if words.count() <= MOST_WORDS else words, of, "left")
    gone = F.col(bits).bitwiseAND(F.expr(f"shiftleft(1L, cast(`{row}`.at % 64 as int))")) != 0
    return joined.where(~F.coalesce(gone, F.lit(False))).select(df.columns)


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable], *, finish: bool = False) -> DataFrame:
    """Run Python over Arrow batches.

    make() runs once per task and returns a function from lists (one per input column) to
    lists (one per output column); with finish it is called once more with None at the end.
    """
    arrow_ready(df.sparkSession)
    out_type = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out_type)

    def batch(columns) -> pa.RecordBatch:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            for part in slices(b):
                got = step(*(c.to_pylist() for c in part.columns))
                if got is not None:
                    yield batch(got)
        if finish and (got := step(None)) is not None:
            for x in got:
                yield batch(x)

    return df.mapInArrow(run, out_type)


def _on_text(df: DataFrame, column: str, make: Callable[[], Callable], use: Callable) -> DataFrame:
    arrow_ready(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for b in batches:
            for part in slices(b):
                yield use(part, at, own(part.column(at).to_pylist()))

    return df.mapInArrow(run, df.schema)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows for whose value in column the function that make() gives is true; it takes and gives lists. Other columns pass as they are."""
    return _on_text(df, column, make, lambda part, _, kept: part.filter(pa.array(kept, pa.bool_())))


def replace_column(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """df with column replaced by what the function that make() gives makes of it; other columns pass as they are."""
    return _on_text(df, column, make, lambda part, at, new: part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type)))


_kept: dict = {}
_thresholds = gc.get_threshold()


def forget() -> None:
    """Free what an operator left in this worker process. Its objects may lead back to each other, and its thresholds may put off looking for such ones, so they are looked for now."""
    if _kept:
        _kept.clear()
        gc.set_threshold(*_thresholds)
        gc.collect()


def kept(name: tuple, make: Callable):
    """An object that this worker process keeps from task to task. Only the last one asked for is kept, so operators that follow each other don't add up."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)
