"""Structured Streaming over files that keep arriving: first copies only, progress, and stalled uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, form: str = "json", per_batch: int = 100) -> DataFrame:
    """Rows of files as they arrive in a folder; read files are left where they are."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def first_copies(rows: DataFrame, keys: Sequence[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once; keys are remembered as long as rows may be late."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def progress(rows: DataFrame, at: str, keys: Sequence[str], width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each key in each window of time."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n_rows"))


def stalled(rows: DataFrame, last: str, as_of: Column, seconds: int) -> DataFrame:
    """Rows without news for longer than ``seconds``."""
    return rows.withColumn("stalled", F.unix_timestamp(as_of) - F.unix_timestamp(last) > seconds)
