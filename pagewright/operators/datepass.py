"""The date pass over whole books: what a book's trusted readings say about the parts of its pages' dates.

Pages have the columns number, page, blank, aligned, and for each part (day, month, year) its value, ``_ok`` (a trusted
reading), ``_alts`` (other readings) and ``_how`` (what its value comes from). All steps are windows over a book in the order
of its numbers; books hold a bounded run of numbers. ``date_pass`` runs them in their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.order import END, START, fill_days_to_month_end
from pagewright.operators.sequences import best_dates_by_book, repair_days_by_book
from pagewright.session import stored

PARTS = ("day", "month", "year")
ORDER = ("number", "page")
#: Readings, votes and share that make a book's year; how far an edge reaches; days that a book seldom jumps.
LEAST_READINGS, LEAST_VOTES, SHARE = 3, 2, (3, 5)
SPAN, JUMP = 10, 7
DERIVED = ("consensus", "candidates", "bracket", "interval", "edge", "book", "registry", "sequence", "repaired", "tens", "month_end", "outlier")


def full_date(year: str | Column = "year", month: str | Column = "month", day: str | Column = "day") -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def put(df: DataFrame, part: str, hit: Column, value: Column, how: str) -> DataFrame:
    """``df`` with a part's value and origin where ``hit`` holds; what is put is no trusted reading."""
    hit = F.coalesce(hit, F.lit(False))
    rows = df.withColumns({"_hit": hit, "_put": value})
    changed = {part: F.when(F.col("_hit"), F.col("_put")).otherwise(F.col(part)), f"{part}_how": F.when(F.col("_hit"), how).otherwise(F.col(f"{part}_how")), f"{part}_ok": F.col(f"{part}_ok") & ~F.col("_hit")}
    return rows.withColumns(changed).drop("_hit", "_put")


def set_aside(df: DataFrame, as_of: Column) -> DataFrame:
    """Parts that lie after the run are no readings: a later year, a later month of its year, a later day of its month."""
    none = F.lit(None).cast("int")
    open_ = ~F.col("blank")
    rows = put(df, "year", open_ & (F.col("year") > F.year(as_of)), none, "out_of_window")
    rows = put(rows, "month", open_ & (F.col("year") == F.year(as_of)) & (F.col("month") > F.month(as_of)), none, "out_of_window")
    return put(rows, "day", open_ & (F.col("day_how") != "month_end") & (full_date() > as_of), none, "out_of_window")


def _majority(df: DataFrame, keys: Sequence[str], readings: Column, by_number: bool) -> DataFrame:
    """Books with a year that is theirs: keys, _major, and the votes of each of their years."""
    own = df.where(readings & F.col("year").isNotNull() & F.col("number").isNotNull() & ~F.col("blank"))
    votes = own.groupBy(*keys, "year").agg((F.count_distinct("number") if by_number else F.count("*")).alias("n"))
    rank = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("year"))
    best = votes.withColumns({"rn": F.row_number().over(rank), "second": F.lead("n").over(rank), "all": F.sum("n").over(Window.partitionBy(*keys))})
    enough = (F.col("n") >= LEAST_VOTES) & (F.col("n") > F.coalesce("second", F.lit(0))) & (F.col("n") * SHARE[1] >= F.col("all") * SHARE[0])
    if not by_number:
        enough = enough & (F.col("all") >= LEAST_READINGS)
    years = votes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("_votes"))
    return best.where((F.col("rn") == 1) & enough).select(*keys, F.col("year").alias("_major")).join(years, list(keys))


def year_consensus(df: DataFrame, keys: Sequence[str], outliers: bool = False) -> DataFrame:
    """Years that a book can't have become its year: all but it, the year before ahead of its first page, and the next one behind its last.

    With ``outliers`` only trusted origins vote, by different numbers, and a year that the book has twice stays.
    """
    readings = ~F.col("year_how").isin(*DERIVED) if outliers else F.lit(True)
    rows = df.join(_majority(df, keys, readings, outliers), list(keys), "left")
    place = F.when(F.col("number").isNotNull() & ~F.col("blank") & (F.col("year") == F.col("_major")), F.struct(*ORDER))
    book = Window.partitionBy(*keys)
    rows = rows.withColumns({"_first": F.min(place).over(book), "_last": F.max(place).over(book), "_at": F.struct(*ORDER)})
    delta = F.col("year") - F.col("_major")
    fits = ((delta == -1) & (F.col("_at") < F.col("_first"))) | ((delta == 1) & (F.col("_at") > F.col("_last")))
    hit = ~F.col("blank") & F.col("number").isNotNull() & (delta != 0) & ~fits
    if outliers:
        hit = hit & (F.coalesce(F.try_element_at("_votes", F.col("year")), F.lit(0)) < LEAST_VOTES)
    return put(rows, "year", hit, F.col("_major"), "outlier" if outliers else "consensus").drop("_major", "_votes", "_first", "_last", "_at")


def _around(df: DataFrame, keys: Sequence[str], what: Column) -> DataFrame:
    """``_left`` and ``_right``: ``what`` (a struct that begins with number and page, or null) of the nearest pages with a smaller and a larger number."""
    w = Window.partitionBy(*keys).orderBy("number")
    rows = df.withColumn("_what", what)
    return rows.withColumns({"_left": F.max("_what").over(w.rangeBetween(START, -1)), "_right": F.min("_what").over(w.rangeBetween(1, END))}).drop("_what")


def ambiguous_months(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A month with several readings is the only one of them that lies between the trusted dates around it."""
    trusted = F.col("aligned") & F.col("day_ok") & F.col("month_ok") & F.col("year_ok") & ~F.col("blank")
    date = full_date()
    rows = _around(df, keys, F.when(trusted & date.isNotNull(), F.struct(*ORDER, date.alias("date"))))
    fits = F.array_distinct(F.filter("month_alts", lambda m: full_date("year", m, "day").between(F.col("_left.date"), F.col("_right.date"))))
    rows = rows.withColumn("_fits", fits)
    hit = ~F.col("blank") & F.col("month").isNull() & (F.size("month_alts") > 1) & F.col("aligned") & F.col("day_ok") & F.col("year_ok") & (F.size("_fits") == 1)
    return put(rows, "month", hit, F.col("_fits")[0], "candidates").drop("_left", "_right", "_fits")


def bracketed_months(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A month that differs from the equal trusted months on both sides becomes theirs, if no two years meet there. Of months that alternate every second one is corrected, as a corrected month is no witness."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    known = F.when(F.col("month").isNotNull() & ~F.col("blank") & F.col("number").isNotNull(), F.struct("month", (F.col("month_ok") & F.col("aligned")).alias("ok"), "year"))
    rows = df.withColumn("_known", known)
    rows = rows.withColumns({"_left": F.last("_known", ignorenulls=True).over(w.rowsBetween(START, -1)), "_right": F.first("_known", ignorenulls=True).over(w.rowsBetween(1, END)), "_place": F.count("_known").over(w.rowsBetween(START, 0))})
    years = F.array_distinct(F.array_compact(F.array("year", "_left.year", "_right.year")))
    hit = F.col("_known").isNotNull() & F.col("_left.ok") & F.col("_right.ok") & (F.col("_left.month") == F.col("_right.month")) & (F.col("_left.month") != F.col("month")) & (F.size(years) <= 1)
    rows = rows.withColumn("_may", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("_run", F.when(F.col("_may"), F.col("_place") - F.count_if("_may").over(w.rowsBetween(START, 0))))
    turn = F.row_number().over(Window.partitionBy(*keys, "_may", "_run").orderBy(*ORDER)) % 2 == 1
    rows = rows.withColumn("_turn", F.col("_may") & turn)
    return put(rows, "month", F.col("_turn"), F.col("_left.month"), "bracket").drop("_known", "_left", "_right", "_place", "_may", "_run", "_turn")


def between_anchors(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """A part between two equal trusted readings is theirs, unless another trusted page of its own number says otherwise. Months need the same year on both sides."""
    ok = F.col(f"{part}_ok") & F.col("aligned") & F.col("number").isNotNull() & F.col(part).isNotNull()
    rows = _around(df, keys, F.when(ok, F.struct(*ORDER, F.col(part).alias("v"), F.col("year").alias("y"))))
    same = Window.partitionBy(*keys, "number")
    value = F.when(ok, F.col(part))
    others = F.count(value).over(same) - ok.cast("int")
    agree = F.count(F.when(value == F.col("_left.v"), 1)).over(same) - F.coalesce((value == F.col("_left.v")).cast("int"), F.lit(0))
    rows = rows.withColumns({"_others": others, "_agree": agree})
    equal = F.col("_left.v") == F.col("_right.v")
    if part == "month":
        equal = equal & F.col("_left.y").eqNullSafe(F.col("_right.y"))
    hit = F.col("aligned") & equal & (F.col("_others") == F.col("_agree")) & (F.col(part).isNull() | (F.col(part) != F.col("_left.v")))
    return put(rows, part, hit, F.col("_left.v"), "interval").drop("_left", "_right", "_others", "_agree")


def impossible_at_edge(part: str, anchor: Column, before: Column) -> Column:
    """Whether a part on the outer side of an anchor (a struct of v and y) contradicts the order of its book."""
    if part == "year":
        return (F.abs(F.col("year") - anchor.v) > 1) | F.when(before, F.col("year") > anchor.v).otherwise(F.col("year") < anchor.v)
    own, its = F.struct(F.col("year").alias("y"), F.col("month").alias("v")), F.struct(anchor.y.alias("y"), anchor.v.alias("v"))
    return F.col("year").isNotNull() & anchor.y.isNotNull() & F.when(before, own > its).otherwise(own < its)


def beyond_anchors(df: DataFrame, keys: Sequence[str], part: str, span: int = SPAN) -> DataFrame:
    """Ahead of the first or behind the last trusted reading a part is that reading's, within ``span`` numbers, if the two outermost agree and it is unread or impossible there."""
    ok = F.col(f"{part}_ok") & F.col("aligned") & F.col("number").isNotNull() & F.col(part).isNotNull()
    anchor = F.when(ok, F.struct(*ORDER, F.col(part).alias("v"), F.col("year").alias("y")))
    ends = df.select(*keys, anchor.alias("a")).where("a IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list("a")).alias("a")).where(F.size("a") > 1)
    a = F.col("a")
    ends = ends.select(*keys, a[0].alias("_f0"), a[1].alias("_f1"), F.element_at(a, -1).alias("_l0"), F.element_at(a, -2).alias("_l1"))
    rows = df.join(ends, list(keys), "left")
    ahead, behind = F.col("number") < F.col("_f0.number"), F.col("number") > F.col("_l0.number")
    near = F.when(ahead, (F.col("_f0.v") == F.col("_f1.v")) & (F.col("_f0.number") - F.col("number") <= span)).when(behind, (F.col("_l0.v") == F.col("_l1.v")) & (F.col("number") - F.col("_l0.number") <= span))
    rows = rows.withColumn("_edge", F.when(ahead, F.col("_f0")).when(behind, F.col("_l0"))).withColumn("_near", near)
    hit = F.col("aligned") & F.col("_near") & (F.col(part).isNull() | impossible_at_edge(part, F.col("_edge"), ahead))
    return put(rows, part, hit, F.col("_edge.v"), "edge").drop("_f0", "_f1", "_l0", "_l1", "_edge", "_near")


def sole_anchor_value(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Books whose trusted readings, two at least, all agree: keys and ``_sole``."""
    ok = df.where(F.col(f"{part}_ok") & F.col("aligned") & F.col("number").isNotNull() & F.col(part).isNotNull())
    return ok.groupBy(*keys).agg(F.min(part).alias("_sole"), F.max(part).alias("_most"), F.count("*").alias("_n")).where("_n > 1 AND _sole = _most").select(*keys, "_sole")


def fill_sole(df: DataFrame, keys: Sequence[str], part: str, sole: DataFrame) -> DataFrame:
    rows = df.join(sole, list(keys), "left")
    return put(rows, part, ~F.col("blank") & F.col(part).isNull() & F.col("_sole").isNotNull(), F.col("_sole"), "book").drop("_sole")


def fill_from_registry(df: DataFrame, keys: Sequence[str], registry: DataFrame) -> DataFrame:
    """Unread months and years between a book's two stored dates, where these leave one value; not where a trusted date of the run lies outside them.

    ``registry``: the keys, first_number, first_date, last_number and last_date.
    """
    rows = df.join(registry, list(keys), "left")
    inside = F.col("number").between(F.col("first_number"), F.col("last_number"))
    trusted = F.col("aligned") & F.col("day_ok") & F.col("month_ok") & F.col("year_ok") & ~F.col("blank")
    against = F.max(F.coalesce(inside & trusted & ~full_date().between(F.col("first_date"), F.col("last_date")), F.lit(False))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_use", inside & ~against & (F.year("first_date") == F.year("last_date")) & ~F.col("blank"))
    rows = put(rows, "year", F.col("_use") & F.col("year").isNull(), F.year("first_date"), "registry")
    rows = put(rows, "month", F.col("_use") & (F.month("first_date") == F.month("last_date")) & F.col("month").isNull(), F.month("first_date"), "registry")
    return rows.drop("_use", "first_number", "first_date", "last_number", "last_date")


def lost_tens(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A day of one digit more than a week from its book gets the tens that bring it nearest, if that fits between its neighbours of the month."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    dated = F.when(full_date().isNotNull() & ~F.col("blank") & F.col("number").isNotNull(), F.struct("year", "month", "day"))
    rows = df.withColumn("_dated", dated)
    rows = rows.withColumns({"_left": F.last("_dated", ignorenulls=True).over(w.rowsBetween(START, -1)), "_right": F.first("_dated", ignorenulls=True).over(w.rowsBetween(1, END))})
    near = lambda c: F.when((F.col(f"{c}.year") == F.col("year")) & (F.col(f"{c}.month") == F.col("month")), F.col(f"{c}.day"))
    rows = rows.withColumns({"_a": near("_left"), "_b": near("_right")})
    gap = lambda v: F.least(F.abs(v - F.col("_a")), F.abs(v - F.col("_b")))
    low, high = F.coalesce("_a", F.lit(1)), F.coalesce(F.col("_b"), F.dayofmonth(F.last_day(full_date("year", "month", F.lit(1)))))
    fits = F.filter(F.array(*[F.col("day") + t for t in (10, 20, 30)]), lambda v: v.between(low, high) & (gap(v) < gap(F.col("day"))))
    best = F.array_min(F.transform(fits, lambda v: F.struct(gap(v).alias("gap"), v.alias("v"))))
    rows = rows.withColumn("_best", best)
    hit = F.col("_dated").isNotNull() & (F.col("day") < 10) & ~F.col("day_how").isin(*DERIVED) & (gap(F.col("day")) > JUMP) & F.col("_best").isNotNull()
    return put(rows, "day", hit, F.col("_best.v"), "tens").drop("_dated", "_left", "_right", "_a", "_b", "_best")


def _sequence(df: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Dates chosen among the parts' readings by the book's order."""
    own = lambda p: F.array_distinct(F.array_compact(F.concat(F.array(p), F.when(~F.col(f"{p}_how").isin(*DERIVED), F.col(f"{p}_alts")).otherwise(F.array().cast("array<int>")))))
    changes = lambda y, m, d: (y != F.col("year")).cast("int") + (m != F.col("month")).cast("int") + (d != F.col("day")).cast("int")
    each = F.flatten(F.transform(own("day"), lambda d: F.flatten(F.transform(own("month"), lambda m: F.transform(own("year"), lambda y: F.struct(full_date(y, m, d).alias("date"), F.coalesce(changes(y, m, d), F.lit(3)).alias("c")))))))
    usable = F.col("number").isNotNull() & (F.col("month").isNotNull() | (F.size("month_alts") < 2))
    options = F.when(usable, F.filter(each, lambda o: o.date.isNotNull() & (o.date <= as_of))).otherwise(F.array().cast("array<struct<date:date,c:int>>"))
    years = lambda x: F.floor(F.greatest(F.datediff(F.add_months(F.trunc(as_of, "MM"), -1), x), F.datediff(x, as_of), F.lit(0)) / 365).cast("int")
    rows = df.withColumn("_o", options)
    rows = rows.withColumns({"_dates": F.transform("_o", lambda o: o.date), "_changes": F.transform("_o", lambda o: o.c), "_outside": F.transform("_o", lambda o: years(o.date))}).drop("_o")
    chosen = best_dates_by_book(rows, keys, ORDER, "_dates", "_changes", "_outside").where("chosen > 0").select(*keys, *ORDER, F.get("_dates", F.col("chosen")).alias("_date"))
    rows = rows.drop("_dates", "_changes", "_outside").join(chosen, [*keys, *ORDER], "left")
    for part, value in (("year", F.year("_date")), ("month", F.month("_date")), ("day", F.dayofmonth("_date"))):
        rows = put(rows, part, value.isNotNull() & ~value.eqNullSafe(F.col(part)), value, "sequence")
    return rows.drop("_date")


def _repaired(df: DataFrame, keys: Sequence[str], strength: str) -> DataFrame:
    """Days of dates that fall within their book repaired at the least cost."""
    dated = df.where(~F.col("blank") & F.col("number").isNotNull()).withColumn("_date", full_date())
    tens = F.when(F.col("day") < 10, F.transform(F.array(F.lit(10), F.lit(20), F.lit(30)), lambda t: F.col("day") + t)).otherwise(F.array().cast("array<int>"))
    named = F.concat(F.filter("day_alts", lambda a: ~((a < 10) & (F.col("day") >= 10))), tens)
    got = repair_days_by_book(dated.withColumn("_named", named), keys, ORDER, "_date", strength, "_named").where("repaired_day != day").select(*keys, *ORDER, "repaired_day")
    rows = df.join(got, [*keys, *ORDER], "left")
    return put(rows, "day", F.col("repaired_day").isNotNull(), F.col("repaired_day"), "repaired").drop("repaired_day")


def _month_ends(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unread days filled with the last one that fits."""
    month = F.when(~F.col("blank"), full_date("year", "month", F.lit(1)))
    rows = df.withColumns({"_month": month, "_number": F.coalesce(F.col("number"), F.lit(1 << 30)), "_day": F.when(~F.col("blank"), F.col("day"))})
    rows = fill_days_to_month_end(rows, keys, ["_number", "page"], "_month", "_day")
    return put(rows, "day", F.col("day").isNull() & F.col("filled_day").isNotNull(), F.col("filled_day"), "month_end").drop("_month", "_number", "_day", "filled_day")


def date_pass(pages: DataFrame, keys: Sequence[str], as_of: Column, strength: str = "strength", registry: DataFrame | None = None) -> DataFrame:
    """All steps over each book: ``pages`` with repaired parts, their origins, ``date``, ``regressed`` and ``unresolved``.

    A number may stand on several pages; keys, number and page name a row. Between steps the pages are written to the
    shared folder, so that no step works out the ones before it again.
    """
    rows = pages.withColumns({f"{p}_how": F.when(F.col(p).isNotNull(), "read").otherwise("none") for p in PARTS})
    rows = stored(set_aside(rows, as_of), "dates-read")
    rows = stored(ambiguous_months(year_consensus(rows, keys), keys), "dates-years")
    rows = stored(bracketed_months(rows, keys), "dates-months")
    for part in ("year", "month"):
        sole = sole_anchor_value(rows, keys, part)
        between = stored(between_anchors(rows, keys, part), f"dates-{part}-between")
        rows = stored(fill_sole(beyond_anchors(between, keys, part), keys, part, sole), f"dates-{part}")
    if registry is not None:
        rows = stored(fill_from_registry(rows, keys, registry), "dates-registry")
    rows = stored(_sequence(rows, keys, as_of), "dates-sequence")
    rows = stored(_repaired(rows, keys, strength), "dates-repaired")
    rows = stored(_month_ends(lost_tens(rows, keys), keys), "dates-filled")
    rows = stored(year_consensus(rows, keys, outliers=True), "dates-outliers")
    rows = _month_ends(set_aside(rows, as_of), keys)
    before = F.last("_date", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(START, -1))
    rows = rows.withColumn("date", F.when(~F.col("blank"), full_date())).withColumn("_date", F.when(F.col("number").isNotNull(), F.col("date")))
    return rows.withColumns({"regressed": F.coalesce(F.col("_date") < before, F.lit(False)), "unresolved": ~F.col("blank") & F.col("date").isNull()}).drop("_date")
