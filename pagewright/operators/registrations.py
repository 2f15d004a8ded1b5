"""A book's registration: weighted evidence, the vote by digits, and imposing its winner on the book's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.fuzzy import best_window_cost, char_cost, compacted
from pagewright.operators.groups import vote_of_sums, weight_sums
from pagewright.operators.joins import confident_match, nearest_numbers, numbers_at
from pagewright.session import stored

#: How much a reading counts by its quality, the least confidence that counts, and what confirms a weak one.
QUALITY = {"clean": 1.0, "ambiguous": 0.8, "weak": 0.25}
LEAST, CONFIRM_VOTES, CONFIRM_CONFIDENCE = 0.05, 2, 0.5


def evidence_weight(confidence: str, quality: str) -> Column:
    """A whole number, so that equal evidence ties exactly whatever order it is summed in."""
    factor = F.lit(0.0)
    for name, value in QUALITY.items():
        factor = F.when(F.col(quality) == name, value).otherwise(factor)
    return F.bround(F.greatest(F.col(confidence), F.lit(LEAST)) * factor * 1_000_000).cast("long")


def unique_evidence(df: DataFrame, book: str, log: str, number: str, confidence: str, quality: str, order: str) -> DataFrame:
    """One reading for each log number: the heaviest, the first of equals. Numbers that can't be read are no evidence."""
    rows = df.where(F.col(log).isNotNull() & F.col(number).rlike("^[0-9]{4}$")).withColumn("weight", evidence_weight(confidence, quality))
    best = Window.partitionBy(book, log).orderBy(F.desc("weight"), order)
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def book_winners(evidence: DataFrame, book: str, number: str, fleet: DataFrame | None = None) -> DataFrame:
    """Each book's winner and its votes; if any evidence names a number of ``fleet`` (column number), only such evidence votes."""
    return winners_of_sums(weight_sums(evidence, book, number, "weight"), book, number, fleet)


def winners_of_sums(sums: DataFrame, book: str, number: str, fleet: DataFrame | None = None) -> DataFrame:
    """``book_winners`` of evidence that is summed up by number."""
    rows = sums
    if fleet is not None:
        known = fleet.select(F.col("number").alias(number)).distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, number, "left").withColumn("any_known", F.max("known").over(Window.partitionBy(book))).where("known OR any_known IS NULL").drop("known", "any_known")
    return vote_of_sums(rows, book, number, 4)


def impose(pages: DataFrame, winners: DataFrame, book: str, number: str, confidence: str) -> DataFrame:
    """The winner on every page of its book, and how: confirmed, kept, filled or overwritten; pages of other books keep what they have."""
    rows = pages.join(winners, book, "left")
    same, empty = F.col(number) == F.col("winner"), F.coalesce(F.col(number), F.lit("")) == ""
    how = (
        F.when(F.col("winner").isNull(), "no_vote")
        .when(empty, "filled")
        .when(same & (F.col("support") >= CONFIRM_VOTES) & (F.col(confidence) >= CONFIRM_CONFIDENCE), "confirmed")
        .when(same, "kept")
        .otherwise("overwritten")
    )
    return rows.withColumns({"value": F.coalesce("winner", number), "method": how, "status": F.when(how == "overwritten", "WARNING").when(how == "no_vote", "ERROR").otherwise("OK")})


def ranked_names(wanted: DataFrame, names: DataFrame, name: str, base: str, size: str) -> DataFrame:
    """For each wanted name the one row that fits best: its exact name before its base name, then an equal size; null if several fit alike.

    Candidates are counted by name and by base, with and without their size, so that no pairs are made.
    """
    want = wanted.select(F.col(name).alias("wanted"), F.col(base).alias("_base"), F.col(size).alias("_size")).distinct()
    for k, (own, sized) in enumerate((("wanted", True), ("wanted", False), ("_base", True), ("_base", False))):
        keys = {own: F.col(name if own == "wanted" else base)} | ({"_size": F.col(size)} if sized else {})
        counts = names.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.struct(F.count("*").alias("n"), F.min(name).alias("found")).alias(f"_fit{k}"))
        want = want.join(counts, list(keys), "left")
    best = F.coalesce(*[F.col(f"_fit{k}") for k in range(4)])
    return want.select("wanted", F.when(best.n == 1, best.found).alias("found"))


def claims(plans: DataFrame, book: str) -> DataFrame:
    """What books hold for their own: value, how many books claim it, and the first of them. ``plans``: book, stored, winner, strong."""
    own = plans.select(book, F.explode(F.array_distinct(F.array_compact(F.array("stored", F.when(F.col("strong"), F.col("winner")))))).alias("claimed"))
    return own.groupBy("claimed").agg(F.count_distinct(book).alias("claimants"), F.min(book).alias("claimant"))


def misread(reading: Column, value: Column, foreign: Column, known: Column | None) -> Column:
    """Whether a reading can be ``value`` misread: not another book's, and no known number or at most one digit apart. ``known`` is null without a list."""
    apart = sum(((F.substring(reading, k, 1) != F.substring(value, k, 1)).cast("int") for k in range(1, 5)), F.lit(0))
    return ~foreign & ((apart <= 1) if known is None else (~known | (apart <= 1)))


def correct_by_book(pages: DataFrame, book: str, log: str, page: str, number: str, confidence: str, quality: str, status: str, registry: DataFrame, fleet: DataFrame | None = None) -> DataFrame:
    """One registration for each book's pages, from the votes of this run and what earlier runs stored (``registry``: book, stored).

    A strong vote against the stored number is imposed and marks the whole book; otherwise a stored number is imposed, else
    the vote's winner. A reading that differs is only taken for a misreading if no other book claims it and it is near
    enough (or, with a ``fleet``, no number of it); else its page is a discrepancy. Adds value, new_status, method, votes
    and conflict.

    Pages are read twice, for the evidence and to be corrected, and don't move where they come partitioned by book; the
    books' sums, plans and claims are tables.
    """
    evidence = unique_evidence(pages, book, log, number, confidence, quality, page)
    sums = stored(weight_sums(evidence, book, number, "weight"), "evidence")
    winners = winners_of_sums(sums, book, number, fleet)
    matched = sums.join(winners.select(book, F.col("winner").alias(number)), [book, number]).select(book, F.bround(F.col("w") / F.col("n") / 1_000_000, 3).alias("vote_confidence"))
    voted = winners.join(matched, book).withColumn("strong", (F.col("support") >= CONFIRM_VOTES) & (F.col("vote_confidence") >= CONFIRM_CONFIDENCE))
    plans = stored(voted.join(registry.select(book, "stored"), book, "full").withColumn("strong", F.coalesce("strong", F.lit(False))).select(book, "winner", "support", "strong", "stored"), "plans")
    rows = pages.join(plans, book, "left").join(stored(claims(plans, book), "claims"), F.col(number) == F.col("claimed"), "left")
    known = None
    if fleet is not None:
        rows = rows.join(fleet.select(F.col("number").alias("_fleet")).distinct(), F.col(number) == F.col("_fleet"), "left")
        known = F.col("_fleet").isNotNull()
    against = F.col("stored").isNotNull() & F.col("winner").isNotNull() & (F.col("winner") != F.col("stored")) & F.col("strong")
    foreign = F.coalesce((F.col("claimants") > 1) | (F.col("claimant") != F.col(book)), F.lit(False))
    rows = rows.withColumns({"_read": F.coalesce(F.col(number), F.lit("")), "_against": F.coalesce(against, F.lit(False)), "_foreign": foreign, "_listed": F.lit(None).cast("boolean") if known is None else known})
    rows = rows.withColumn("_stored", F.col("stored").isNotNull() & ~F.col("_against")).withColumn("_value", F.when(F.col("_stored"), F.col("stored")).otherwise(F.col("winner")))
    read, value, by_registry, strong = F.col("_read"), F.col("_value"), F.col("_stored"), F.coalesce(F.col("strong"), F.lit(False))
    near = misread(read, value, F.col("_foreign"), None if known is None else F.col("_listed"))
    rows = rows.withColumns({"_same": read == value, "_canonical": read.rlike("^[0-9]{4}$"), "_near": near})
    same, canonical = F.col("_same"), F.col("_canonical")
    differs, confirms = canonical & ~same, same & (F.col(status) != "OK") & strong
    vote_status = F.when(same, F.when(confirms, "OK").otherwise(F.col(status))).otherwise(F.when(~canonical & strong, "OK").otherwise("WARNING"))
    new_status = F.when(value.isNull(), F.col(status)).when(F.col("_against"), "WARNING").when(by_registry, F.when(differs, "WARNING").otherwise("OK")).otherwise(vote_status)
    method = F.when(value.isNull(), "no_vote").when(by_registry, "stored").when(confirms, "confirmed").when(same, "kept").otherwise("digit_vote")
    votes = F.when(by_registry, F.lit(CONFIRM_VOTES)).when(value.isNotNull() & (confirms | ~same), F.col("support")).cast("int")
    conflict = F.col("_against") | (differs & ~(F.col("_near") & (by_registry | strong)))
    out = {"value": F.coalesce(value, F.col(number)), "new_status": new_status, "method": method, "votes": votes, "conflict": F.coalesce(conflict, F.lit(False))}
    return rows.select(*pages.columns, *[c.alias(n) for n, c in out.items()])


def reading_costs(asked: DataFrame, pages: DataFrame, book: str, value: str, option: str, reading: str, size: int = 4) -> DataFrame:
    """What all readings of a book cost against each number asked for (``asked``: book, value, option), by ``best_window_cost``; adds _cost.

    A reading of just ``size`` characters has one window, whose cost is a sum over places; so a book's such readings are
    added up once, by place and digit, and each number looks up its own digits. Only longer readings meet every number.
    """
    texts = pages.where(F.col(book).isNotNull()).groupBy(book, F.col(reading).alias("_text")).agg(F.count("*").alias("_times")).withColumn("_compact", compacted("_text"))
    chars = texts.where(F.length("_compact") == size).select(book, "_times", F.posexplode(F.array(*[F.substring("_compact", k, 1) for k in range(1, size + 1)])).alias("_place", "_char"))
    counted = chars.groupBy(book, "_place", "_char").agg(F.sum("_times").alias("_times"))
    digits = counted.groupBy(book, "_place").agg(F.array(*[F.sum(char_cost(F.col("_char"), F.lit(str(n))) * F.col("_times")) for n in range(10)]).alias("_costs"))
    tables = digits.groupBy(book).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_costs"))).alias("_table"))  # ``size`` places
    at = lambda k: F.get(F.col("_table")[k], F.substring(option, k + 1, 1).cast("int"))
    one = asked.join(tables, book, "left").select(book, value, option, F.coalesce(sum((at(k) for k in range(1, size)), at(0)), F.lit(0)).alias("_cost"))
    long = texts.where(F.length("_compact") > size).select(book, "_text", "_times")
    more = asked.join(long, book).select(book, value, option, (best_window_cost("_text", option, size) * F.col("_times")).alias("_cost"))
    return one.unionByName(more).groupBy(book, value, option).agg(F.sum("_cost").alias("_cost"))


def against_fleet(pages: DataFrame, book: str, value: str, reading: str, fleet: DataFrame, number: str) -> DataFrame:
    """Values that are no known number become the nearest one; ties go to the number that the book's readings cost least, if just one does; else there is none.

    Adds fleet_value and fleet_method: known, nearest, by_readings or unconfirmed.
    """
    known = fleet.select(F.col(number).alias(value)).distinct().withColumn("_known", F.lit(True))
    rows = pages.join(known, value, "left")
    odd = rows.where("_known IS NULL").select(value)
    near = stored(nearest_numbers(odd, value, fleet, number), "nearest")
    options = numbers_at(near.where("ties > 1").select(value, F.col("cost").alias("_least")), value, "_least", fleet, number).withColumnRenamed(number, "_option")
    asked = rows.where("_known IS NULL").where(F.col(book).isNotNull()).select(book, value).distinct().join(options, value)
    costs = reading_costs(asked, pages, book, value, "_option", reading).groupBy(book, value, "_cost").agg(F.count("*").alias("_n"), F.min("_option").alias("_chosen"))
    alone = costs.groupBy(book, value).agg(F.min(F.struct("_cost", "_n", "_chosen")).alias("_best")).where("_best._n = 1").select(book, value, "_best._chosen")
    rows = rows.join(near.where("ties = 1").select(value, F.col(number).alias("_near")), value, "left").join(alone, [book, value], "left")
    method = F.when(F.col("_known"), "known").when(F.col("_near").isNotNull(), "nearest").when(F.col("_chosen").isNotNull(), "by_readings").otherwise("unconfirmed")
    return rows.select(*pages.columns, F.when(F.col("_known"), F.col(value)).otherwise(F.coalesce("_near", "_chosen")).alias("fleet_value"), method.alias("fleet_method"))


def snap_to_fleet(pages: DataFrame, value: str, reading: str, fleet: DataFrame, number: str) -> DataFrame:
    """Before a vote: a value that is no known number takes the one that its raw reading points to without rival. Adds snapped and snap_cost."""
    known = fleet.select(F.col(number).alias(value)).distinct().withColumn("_known", F.lit(True))
    rows = pages.join(known, value, "left")
    match = confident_match(rows.where(F.col("_known").isNull() & (F.col(reading) != "")), reading, fleet, number)
    rows = rows.join(match, reading, "left")
    hit = F.col("_known").isNull() & F.col("match").isNotNull()
    return rows.select(*pages.columns, F.when(hit, F.col("match")).otherwise(F.col(value)).alias("snapped"), F.when(hit, F.col("match_cost")).alias("snap_cost"))
