"""Searches in nested JSON, on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_text(value: Column) -> Column:
    """A string or number of a variant as text without white space around it; null for anything else."""
    kind = F.schema_of_variant(value)
    scalar = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & ~kind.isin("BOOLEAN", "VOID")
    return F.when(scalar, F.trim(F.try_variant_get(value, "$", "string")))


def innermost_objects(rows: DataFrame, key: str, json: str, wanted: str, depth: int = 6) -> DataFrame:
    """key and ``place`` (a path) of the smallest objects that hold a value: those with it of which no object inside has it.

    A value is held by an object if it stands in it or in lists in it, at most ``depth`` levels down; objects deeper than
    ``depth`` are not looked at, what they hold belongs to the object above. Text that is no JSON holds nothing. ``key`` is
    unique. Levels are opened one after the other, ``2 * depth`` of them, scalars waiting as they are.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("_key"), F.trim(F.col(wanted).cast("string")).alias("_wanted"), F.try_parse_json(json).alias("_value")).where("_value IS NOT NULL AND _wanted <> ''")
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    level = level.select("*", F.lit("$").alias("_path"), F.lit(0).alias("_depth")).withColumns({"_object": F.when(is_object(F.col("_value")), "$"), "_object_depth": F.lit(0)})
    for at in range(1, 2 * depth + 1):
        inside = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_value").outer()))
        found = F.col("value").isNotNull()
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = inside.select("_key", "_wanted", F.when(found, F.col("value")).otherwise(F.col("_value")).alias("_value"), F.when(found, F.concat("_path", step)).otherwise(F.col("_path")).alias("_path"), F.when(found, at).otherwise(F.col("_depth")).alias("_depth"), "_object", "_object_depth")
        if at <= depth:
            own = (F.col("_depth") == at) & is_object(F.col("_value"))
            level = level.withColumns({"_object": F.when(own, F.col("_path")).otherwise(F.col("_object")), "_object_depth": F.when(own, at).otherwise(F.col("_object_depth"))})
    hits = level.where((scalar_text(F.col("_value")) == F.col("_wanted")) & F.col("_object").isNotNull() & (F.col("_depth") - F.col("_object_depth") <= depth))
    places = hits.groupBy("_key").agg(F.collect_set("_object").alias("_places"))  # of one document
    inner = F.filter("_places", lambda p: ~F.exists("_places", lambda q: q.startswith(F.concat(p, F.lit("."))) | q.startswith(F.concat(p, F.lit("[")))))
    return places.select(F.col("_key").alias(key), F.explode(inner).alias("place"))
