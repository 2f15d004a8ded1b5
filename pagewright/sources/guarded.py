"""Tables that are overwritten partition by partition, only where nobody else changed them, and that can be put back.

A partition's digest is the same in whatever order its rows stand and however they are dealt to files. A change names the
digests it was made from: partitions that have others now are refused. What is overwritten is kept in a backup, with the
digests before and after, and ``restored`` puts back only partitions that still have the digest the change left. Partitions are
replaced by Spark's dynamic overwrite, whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import shared_folder


def digests(rows: DataFrame, by: str) -> DataFrame:
    """``by`` and ``digest`` of each partition: its number of rows, and the sum and exclusive or of the rows' hashes. Equal rows count each."""
    names = sorted(c for c in rows.columns if c != by)
    one = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    other = F.xxhash64(F.lit(1), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    parts = F.concat_ws(":", F.count("*").cast("string"), F.sum(one.cast("decimal(38,0)")).cast("string"), F.bit_xor(other).cast("string"))
    return rows.groupBy(by).agg(parts.alias("digest"))


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``rows`` has; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def overwritten(spark: SparkSession, path: str, schema: str, by: str, change: DataFrame, expected: DataFrame) -> tuple[DataFrame, str]:
    """Overwrites the partitions of ``change`` whose digest is still the ``expected`` one (by, digest; none for new partitions).

    Gives ``by``, ``action`` (written or refused), ``before`` and ``after``, written down, and the folder of the backup. The
    backup is whole before the first partition is replaced.
    """
    backup = shared_folder(spark, "backup")
    now = digests(read_partitions(spark, path, schema), by).withColumnRenamed("digest", "before")
    wanted = change.select(by).distinct().join(now, by, "left").join(expected.withColumnRenamed("digest", "_expected"), by, "left")
    verdict = wanted.select(by, F.when(F.col("before").eqNullSafe(F.col("_expected")), "written").otherwise("refused").alias("action"), "before")
    verdict.write.parquet(f"{backup}/verdict")
    verdict = spark.read.parquet(f"{backup}/verdict")
    ours = verdict.where("action = 'written'").select(by)
    read_partitions(spark, path, schema).join(ours, by, "left_semi").write.partitionBy(by).parquet(f"{backup}/rows")
    write_partitions(change.join(ours, by, "left_semi").select(*_columns(spark, path, schema)), path, by)
    after = digests(read_partitions(spark, path, schema), by).withColumnRenamed("digest", "after")
    verdict.join(after, by, "left").write.parquet(f"{backup}/journal")
    return spark.read.parquet(f"{backup}/journal"), backup


def restored(spark: SparkSession, path: str, schema: str, by: str, backup: str) -> DataFrame:
    """Puts back what a change replaced, where the partition still has the digest that the change left: ``by`` and ``action`` (restored, removed or refused).

    A partition that the change made new is removed: it stays as an empty one.
    """
    now = digests(read_partitions(spark, path, schema), by).withColumnRenamed("digest", "_now")
    journal = spark.read.parquet(f"{backup}/journal").where("action = 'written'")
    same = F.col("_now").eqNullSafe(F.col("after"))
    verdict = journal.join(now, by, "left").select(by, F.when(~same, "refused").when(F.col("before").isNull(), "removed").otherwise("restored").alias("action"))
    verdict.write.mode("overwrite").parquet(f"{backup}/undone")
    verdict = spark.read.parquet(f"{backup}/undone")
    write_partitions(read_partitions(spark, f"{backup}/rows", schema).join(verdict.where("action = 'restored'"), by, "left_semi"), path, by)
    for row in verdict.where("action = 'removed'").select(by).toLocalIterator():  # names of partitions, one after the other
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={row[0]}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return verdict


def _columns(spark: SparkSession, path: str, schema: str) -> list[str]:
    return read_partitions(spark, path, schema).columns
