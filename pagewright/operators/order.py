"""Operators over ordered rows: neighbours, fills, gaps, islands, rolling medians, sections and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = Window.unboundedFollowing
START = Window.unboundedPreceding


def bracket(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """A value between two equal neighbours that disagrees with them becomes theirs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    hit = (before == after) & (F.col(value) != before)
    return df.withColumns({"corrected": F.when(hit, before).otherwise(F.col(value)), "was_corrected": F.coalesce(hit, F.lit(False))})


def fill_between(df: DataFrame, keys: Sequence[str], number: str, value: str) -> DataFrame:
    """A missing value takes that of the nearest known rows before and after (by strictly smaller and larger numbers) if both agree."""
    w = Window.partitionBy(*keys).orderBy(number)
    before = F.last(value, ignorenulls=True).over(w.rangeBetween(START, -1))
    after = F.first(value, ignorenulls=True).over(w.rangeBetween(1, END))
    filled = F.when(F.col(value).isNull() & (before == after), before)
    return df.withColumns({"filled": F.coalesce(F.col(value), filled), "method": F.when(F.col(value).isNotNull(), "read").when(filled.isNotNull(), "between").otherwise("none")})


def extrapolate_edges(df: DataFrame, keys: Sequence[str], number: str, value: str, span: int = 10) -> DataFrame:
    """Rows before the first or after the last known one take its value within ``span`` if the two outermost known ones agree."""
    known = df.where(F.col(value).isNotNull())
    up, down = Window.partitionBy(*keys).orderBy(number), Window.partitionBy(*keys).orderBy(F.desc(number))
    ranked = known.withColumns({"up": F.row_number().over(up), "down": F.row_number().over(down)})
    pick = lambda side, k, c: F.max(F.when(F.col(side) == k, F.col(c)))
    edges = ranked.groupBy(*keys).agg(
        pick("up", 1, number).alias("first_n"), pick("up", 1, value).alias("first_v"), pick("up", 2, value).alias("first_v2"), pick("down", 1, number).alias("last_n"), pick("down", 1, value).alias("last_v"), pick("down", 2, value).alias("last_v2")
    )
    n = F.col(number)
    ahead = (n < F.col("first_n")) & (F.col("first_n") - n <= span) & (F.col("first_v") == F.col("first_v2"))
    behind = (n > F.col("last_n")) & (n - F.col("last_n") <= span) & (F.col("last_v") == F.col("last_v2"))
    filled = F.coalesce(F.col(value), F.when(ahead, F.col("first_v")).when(behind, F.col("last_v")))
    return df.join(edges, list(keys), "left").withColumn("filled", filled).drop("first_n", "first_v", "first_v2", "last_n", "last_v", "last_v2")


def regressions(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is less than that of the last row before that has one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(START, -1)
    before = F.last(value, ignorenulls=True).over(w)
    return df.withColumns({"before": before, "regressed": F.coalesce(F.col(value) < before, F.lit(False))})


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: first, last and size."""
    w = Window.partitionBy(*keys).orderBy(number)
    rows = df.select(*keys, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w))
    return rows.groupBy(*keys, "island").agg(F.min(number).alias("first_number"), F.max(number).alias("last_number"), F.count("*").alias("size")).drop("island")


def gaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """What lacks between consecutive numbers of a group."""
    w = Window.partitionBy(*keys).orderBy(number)
    rows = df.select(*keys, number).distinct().withColumn("next_number", F.lead(number).over(w))
    return rows.where(F.col("next_number") > F.col(number) + 1).select(*keys, (F.col(number) + 1).alias("gap_from"), (F.col("next_number") - 1).alias("gap_to"))


def rolling_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, half: int = 7) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("rolling_median", F.percentile(value, F.lit(0.5)).over(w))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Group cells that are empty on continuation rows take the last value above."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(START, 0)
    return df.withColumns({f"{v}_filled": F.last(v, ignorenulls=True).over(w) for v in values})


def sections(df: DataFrame, keys: Sequence[str], order: Sequence[str], separator: Column) -> DataFrame:
    """The number of the section each row is in; a separator opens one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(START, 0)
    return df.withColumn("section", F.sum(separator.cast("int")).over(w))


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Pieces of at most ``size`` rows of each group, and each row's place in its piece."""
    w = Window.partitionBy(*keys).orderBy(*order)
    k = F.row_number().over(w) - 1
    return df.withColumns({"chunk": F.floor(k / size).cast("int"), "place": (k % size + 1).cast("int")})


def spread_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows of each group spread evenly, both ends among them; all rows of smaller groups, the first if ``k`` is one."""
    group = Window.partitionBy(*keys)
    rows = df.withColumns({"i": F.row_number().over(group.orderBy(*order)) - 1, "n": F.count("*").over(group)})
    if k == 1:
        return rows.where("i = 0").drop("i", "n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("n") - 1) / (k - 1)).cast("long"))
    return rows.where((F.col("n") <= k) | F.array_contains(wanted, F.col("i").cast("long"))).drop("i", "n")


def spread_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int) -> DataFrame:
    """``k`` different values of each group, spread evenly over their first places: keys and value. Values are trimmed; empty ones and nulls don't count."""
    rows = df.withColumn(value, F.trim(F.col(value))).where(F.col(value) != "")
    first = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    return spread_sample(first, keys, ["_first"], k).drop("_first")


def numeric_text_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, descending: bool = False) -> DataFrame:
    """The place of each text: numbers by value before other texts without regard to case, blanks last in both directions."""
    text = F.coalesce(F.trim(value), F.lit(""))
    number = text.try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    turn = F.desc if descending else F.asc
    w = Window.partitionBy(*keys).orderBy((text == "").cast("int"), turn(number.isNull().cast("int")), turn(F.coalesce(number, F.lit(0.0))), turn(F.when(number.isNull(), F.lower(text)).otherwise("")), F.col(tie))
    return df.withColumn("place", F.row_number().over(w))


def first_last(df: DataFrame, keys: Sequence[str], number: str, value: str) -> DataFrame:
    """The values at the ends of each group."""
    return df.groupBy(*keys).agg(F.min_by(value, number).alias("first_value"), F.max_by(value, number).alias("last_value"))


def keep_oldest(df: DataFrame, keys: Sequence[str], date: str, tie: str) -> DataFrame:
    """The oldest row of each group is kept and the rest may go; with a missing date none may."""
    group = Window.partitionBy(*keys)
    oldest = F.row_number().over(group.orderBy(date, tie)) == 1
    return df.withColumn("deletable", F.bool_and(F.col(date).isNotNull()).over(group) & ~oldest)


def lost_tens(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str, gap: int = 7) -> DataFrame:
    """A one-digit day far from both neighbours may have lost its tens: the completion nearest to the neighbours' middle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(day).over(w), F.lead(day).over(w)
    options = F.filter(F.array(*[F.col(day) + t for t in (0, 10, 20, 30)]), lambda x: (x >= before) & (x <= after) & (x <= 31))
    nearest = F.array_min(F.transform(options, lambda x: F.struct(F.abs(x * 2 - before - after).alias("far"), x.alias("day"))))
    lost = (F.col(day) < 10) & (F.abs(F.col(day) - before) > gap) & (F.abs(F.col(day) - after) > gap) & (before <= after)
    return df.withColumn("completed", F.coalesce(F.when(lost, nearest.day), F.col(day)))


def fill_days_to_month_end(df: DataFrame, keys: Sequence[str], order: Sequence[str], month: str, day: str) -> DataFrame:
    """``df`` with ``filled_day``: a row with a month (its first day) but no day takes the last day that fits.

    That is not after the next dated row's, if it is in the same month, and not before the last day read or filled since
    the month began. What is filled counts for the rows after it; as all of them look at the same next dated row, the last
    day read in the month's unbroken run of rows is all that they need.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    read = F.when(F.col(month).isNotNull(), F.col(day))
    last_month = F.last(month, ignorenulls=True).over(w.rowsBetween(START, -1))
    opens = (F.col(month).isNotNull() & ~F.col(month).eqNullSafe(last_month)).cast("int")
    rows = df.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w.rowsBetween(START, 0)))
    after = F.first(F.when(read.isNotNull(), F.struct(F.col(month).alias("m"), F.col(day).alias("d"))), ignorenulls=True).over(w.rowsBetween(1, END))
    before = F.last(read, ignorenulls=True).over(Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(START, -1))
    rows = rows.withColumns({"_after": after, "_before": before})
    length = F.dayofmonth(F.last_day(month))
    latest = F.least(length, F.when(F.col("_after.m") == F.col(month), F.col("_after.d")))
    filled = F.coalesce(F.col(day), F.when(F.col(month).isNotNull(), F.least(length, F.greatest(latest, F.col("_before")))))
    return rows.withColumn("filled_day", filled).drop("_opens", "_run", "_after", "_before")


def strided_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 8) -> DataFrame:
    """Batches of at most ``size`` rows, each spread over the whole group: row i goes to batch i modulo the number of batches."""
    group = Window.partitionBy(*keys)
    rows = df.withColumns({"i": F.row_number().over(group.orderBy(*order)) - 1, "n": F.ceil(F.count("*").over(group) / size)})
    return rows.withColumn("batch", (F.col("i") % F.col("n")).cast("int")).drop("i", "n")


def delivery_order(df: DataFrame, keys: Sequence[str], number: str, tie: str, last: Column) -> DataFrame:
    """Each row's place in its delivery: by number, those without one after the others, and rows of the last section at the end."""
    w = Window.partitionBy(*keys).orderBy(last.cast("int"), F.coalesce(F.col(number), F.lit(1 << 30)), tie)
    return df.withColumns({"place": F.row_number().over(w), "section": F.when(last, "review").otherwise("main")})


def written_order(df: DataFrame, keys: Sequence[str], number: str, page: str, blank: str, day: str) -> DataFrame:
    """The numbered pages of each book that aren't blank, with their ``place`` by number and page, and ``day_place`` among those with a date (null without one)."""
    rows = df.where(F.col(number).isNotNull() & ~F.coalesce(F.col(blank), F.lit(False)))
    own = Window.partitionBy(*keys).orderBy(number, page)
    dated = F.col(day).isNotNull()
    upto = F.sum(dated.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"place": F.row_number().over(own), "day_place": F.when(dated, upto)})
