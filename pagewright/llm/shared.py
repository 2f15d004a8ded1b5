"""What the operators of this subpackage share: written intermediate tables and text in bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session without that setting gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: The folders named within the innermost ``only_last`` of this thread; None outside of any.
_named: ContextVar[list[str] | None] = ContextVar("named", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder."""
    path = f"{scratch_root(spark)}/pagewright-{name}-{uuid.uuid4().hex}"
    if (named := _named.get()) is not None:
        named.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder or file of the shared folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, files: int | None = None, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there, and its size is known to the planner.

    ``files`` bounds the files of a table that is small beside its input, so that many tasks don't leave many of them.
    ``by`` is a column of which each value gets a folder of its own.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    out = (df.coalesce(files) if files else df).write
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def only_last(spark: SparkSession) -> Iterator[list[str]]:
    """Of the folders named inside, by this thread, only the last one stays: whatever it was made of is removed when all is done.

    Gives the list of the folders; its last one is that which stays.

    If what runs inside fails, all of them are removed. Other threads' folders are their own.
    """
    outer, own = _named.get(), []
    token, kept = _named.set(own), 0
    try:
        yield own
        kept = 1
    finally:
        _named.reset(token)
        gone, stays = (own[:-1], own[-1:]) if kept else (own, [])
        if outer is not None:
            outer.extend(stays)
        for path in gone:
            remove(spark, path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop path or URI and the path within it, for tasks that stream files."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if re.match(r"\w+:", path) else f"file://{path}")


def utf8(text: str | Column) -> Column:
    """A text column's bytes as they stand, well-formed or not; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("binary"), F.lit(b""))


def valid(text: str | Column) -> Column:
    """A text column in which replacement characters stand for bytes that are no UTF-8; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its capitals."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
