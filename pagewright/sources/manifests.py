"""Form templates and job manifests, JSON files below a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEMPLATE = "name string, version string, fields array<struct<id:string,type:string,required:boolean,x:double,y:double,w:double,h:double,regex:string,min_length:int,max_length:int,postprocess:string>>"
MANIFEST = "job string, batch string, part int, review boolean, stage string, pages array<struct<file:string,page:int,separator:boolean>>"


def template_fields(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a template: its fields with their place, in order, and rules; types default to ``ocr``, nothing is required.

    Ids that stand twice, boxes that leave the page and lengths below 0 are an error, as a field would overwrite another.
    """
    rows = spark.read.schema(TEMPLATE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    fields = rows.select(F.posexplode("fields").alias("place", "f")).select("place", "f.*")
    fields = fields.withColumns({"type": F.coalesce("type", F.lit("ocr")), "required": F.coalesce("required", F.lit(False))})
    seen = F.count("*").over(Window.partitionBy("id"))
    box = F.forall(F.array("x", "y"), lambda v: v.between(0, 1)) & F.forall(F.array("w", "h"), lambda v: (v > 0) & (v <= 1))
    sizes = (F.coalesce("min_length", F.lit(0)) >= 0) & (F.coalesce("max_length", F.lit(0)) >= 0)
    wrong = F.when(F.col("id").isNull(), "a field has no id").when(F.col("_seen") > 1, F.concat(F.lit("a field's id stands twice: "), "id")).when(~F.coalesce(box, F.lit(False)), F.concat(F.lit("a field's box is not on the page: "), "id")).when(~sizes, F.concat(F.lit("a field's length is below 0: "), "id"))
    checked = fields.withColumn("_seen", seen).withColumn("id", F.when(wrong.isNull(), F.col("id")).otherwise(F.raise_error(F.coalesce(wrong, F.lit("")))))
    return checked.drop("_seen")


def manifests(spark: SparkSession, root: str, name: str = "manifest*.json") -> DataFrame:
    """All manifests below a root, a row each with its path; files that can't be read, or name no job, are left out."""
    read = spark.read.schema(f"{MANIFEST}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    # the whole row is read before rows are dropped, as Spark doesn't look at what is broken alone
    return read.withColumn("path", F.input_file_name()).where("job IS NOT NULL AND _broken IS NULL").drop("_broken")


def delivery_parts(jobs: DataFrame, run: str) -> DataFrame:
    """The parts of each run in order of delivery (automatic ones by number, then those to review), numbered apart: index, of, and their pages without separators."""
    review = F.coalesce("review", F.lit(False))
    order = Window.partitionBy(run, "_review").orderBy(F.coalesce("part", F.lit(1)), "job")
    rows = jobs.withColumn("_review", review).withColumns({"index": F.row_number().over(order), "of": F.count("*").over(Window.partitionBy(run, "_review"))})
    pages = F.filter("pages", lambda p: ~F.coalesce(p["separator"], F.lit(False)))
    delivered = F.row_number().over(Window.partitionBy(run).orderBy("_review", F.coalesce("part", F.lit(1)), "job"))
    return rows.select(run, "job", F.col("_review").alias("review"), "index", "of", delivered.alias("place"), F.size(F.coalesce("pages", F.array())).alias("n_pages"), F.coalesce(F.size(pages), F.lit(0)).alias("n_logs"))
