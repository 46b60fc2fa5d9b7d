"""Dimension tables made by rule."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.workers import importable


def unicode_names(spark: SparkSession) -> DataFrame:
    """(code, name) of every named character beyond ASCII: a table of fixed size, made where it is used."""

    importable()

    @F.pandas_udf("string")
    def name(codes: pd.Series) -> pd.Series:
        return pd.Series([unicodedata.name(chr(c), None) for c in codes], dtype=object)

    codes = spark.range(128, 0x110000, numPartitions=8).select(F.col("id").cast("int").alias("code"))
    return codes.select("code", name("code").alias("name")).where("name is not null")
