"""Joins by nearness, time, fallback, interval and merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.fuzzy import CONFUSED, MARGIN, MAX_COST, as_digits, best_window_cost, compacted, weighted_hamming
from pagewright.session import stored

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def asof_nearest(df: DataFrame, keys: Sequence[str], number: str, date: str) -> DataFrame:
    """Dates rows without one by their group's dated rows, without a join.

    The same number's latest date; between two the nearer one's, ties to the later number; after the last the end of its
    month; before the first the first's.
    """
    w = Window.partitionBy(*keys).orderBy(number)
    same = F.max(date).over(Window.partitionBy(*keys, number))
    known = F.when(F.col(date).isNotNull(), F.struct(F.col(number).alias("n"), F.col(date).alias("d")))
    rows = df.withColumn("known", known)
    left = F.max("known").over(w.rangeBetween(START, -1))
    right = F.min("known").over(w.rangeBetween(1, END))
    rows = rows.withColumns({"same": same, "left_known": left, "right_known": right})
    nearer = F.when(F.col(number) - F.col("left_known.n") < F.col("right_known.n") - F.col(number), F.col("left_known.d")).otherwise(F.col("right_known.d"))
    has = lambda c: F.col(c).isNotNull()
    value = F.coalesce(F.col(date), F.col("same"), F.when(has("left_known") & has("right_known"), nearer).when(has("left_known"), F.last_day("left_known.d")).otherwise(F.col("right_known.d")))
    method = F.when(has(date), "read").when(has("same"), "same_number").when(has("left_known") & has("right_known"), "between").when(has("left_known"), "month_end").when(has("right_known"), "between").otherwise("none")
    return rows.withColumns({"dated": value, "method": method}).drop("known", "same", "left_known", "right_known")


def worked_out_once(rows: DataFrame, given: Sequence[str], made: dict[str, Column]) -> DataFrame:
    """Columns ``made`` of the columns ``given`` alone, worked out once for each distinct combination of these and joined to all rows; nulls are values."""
    found = rows.select(*given).distinct().select(*[F.col(c).alias(f"_{c}") for c in given], *[c.alias(n) for n, c in made.items()])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in given])
    return rows.join(stored(found, "once"), same, "left").select(*rows.columns, *made)


def distinct_digits(df: DataFrame, c: str, size: int) -> DataFrame:
    return df.select(c).where(F.col(c).rlike(f"^[0-9]{{{size}}}$")).distinct()


def meeting(readings: DataFrame, reading: str, numbers: DataFrame, number: str, size: int) -> DataFrame:
    """Pairs of digits that agree in all but two places."""
    kept = list(combinations(range(1, size + 1), max(size - 2, 0)))
    keys = lambda c: F.array(*[F.concat(F.lit(f"{k}:"), *[F.substring(c, p, 1) for p in places]) for k, places in enumerate(kept)])
    split = lambda rows, c: rows.select(c, F.explode(keys(c)).alias("_key"))
    return split(readings, reading).join(split(numbers, number), "_key").select(reading, number).distinct()


def numbers_at(costs: DataFrame, reading: str, cost: str, known: DataFrame, number: str, size: int = 4) -> DataFrame:
    """All known numbers at the cost that ``nearest_numbers`` gives a reading: its ties. They meet as there."""
    numbers, near = distinct_digits(known, number, size), F.col(cost) < 3 * CONFUSED
    met = meeting(costs.where(near).select(reading), reading, numbers, number, size).join(costs, reading)
    pairs = met.unionByName(costs.where(~near).join(F.broadcast(numbers)))  # at most 10 to the power of size short texts
    return pairs.where(weighted_hamming(reading, number, size) == F.col(cost)).select(reading, number)


def nearest_numbers(df: DataFrame, reading: str, known: DataFrame, number: str, size: int = 4) -> DataFrame:
    """The nearest known number of each distinct reading by ``weighted_hamming``, how many tie, and its cost.

    Readings and numbers that aren't ``size`` digits don't take part, so there are at most 10 to that power of either. They
    meet where they agree in all but two places. A number that differs in more costs at least three confusions, so a
    reading with a cheaper match is settled; only the others are compared with all numbers.
    """
    readings, numbers = distinct_digits(df, reading, size), distinct_digits(known, number, size)
    met = meeting(readings, reading, numbers, number, size)

    def nearest(pairs: DataFrame) -> DataFrame:
        costs = pairs.withColumn("cost", weighted_hamming(reading, number, size)).groupBy(reading, "cost").agg(F.count("*").alias("ties"), F.min(number).alias(number))
        best = costs.groupBy(reading).agg(F.min(F.struct("cost", number, "ties")).alias("best"))
        return best.select(reading, F.col(f"best.{number}").alias(number), F.col("best.cost").alias("cost"), F.col("best.ties").cast("int").alias("ties"))

    close = nearest(met).where(F.col("cost") < 3 * CONFUSED)
    far = readings.join(close, reading, "left_anti")
    return close.unionByName(nearest(far.join(F.broadcast(numbers))))  # at most 10 to the power of size short texts


def confident_match(df: DataFrame, text: str, known: DataFrame, number: str, size: int = 4) -> DataFrame:
    """The known number a reading points to without rival: cost within bounds and clearly below the next; null otherwise.

    What can match, or come near enough to a match to rival it, differs from some window of the reading in one place at
    most, as two confusions cost more than both bounds together. So windows and numbers meet where all but one place agree.
    """
    distinct = df.select(text).distinct()
    window = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_compact") - size + 1, F.lit(1))), lambda k: F.substr(F.col("_compact"), k, F.lit(size)))
    windows = distinct.withColumn("_compact", compacted(text)).select(text, F.explode(window).alias("_window")).where(F.length("_window") == size).distinct()
    keys = lambda c: F.array(*[F.concat(F.lit(f"{k}:"), F.substring(c, 1, k), F.substr(c, F.lit(k + 2), F.lit(size))) for k in range(size)])
    left = windows.select(text, "_window", F.explode(keys(as_digits(F.col("_window")))).alias("_key"))
    right = known.select(number).distinct().select(number, F.explode(keys(F.col(number))).alias("_key"))
    costs = left.join(right, "_key").withColumn("cost", best_window_cost("_window", number, size)).groupBy(text, number).agg(F.min("cost").alias("cost"))
    best = costs.groupBy(text).agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", number))), 1, 2).alias("best"))
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    ok = (first.cost <= MAX_COST) & F.coalesce(second.cost - first.cost >= MARGIN, F.lit(True))
    return distinct.join(best, text, "left").select(text, F.when(ok, first[number]).alias("match"), F.when(ok, first.cost).alias("match_cost"))


def fallback_join(left: DataFrame, right: DataFrame, steps: Sequence[tuple[str, Sequence[tuple[str, str]]]], payload: str) -> DataFrame:
    """A left join by the first step that finds a row: steps have a name and pairs of left and right columns.

    Right keys must be unique for each step; those that aren't are left out of it.
    """
    found, how = F.lit(None), F.lit(None)
    out = left
    for k, (_, pairs) in enumerate(steps):
        names = [f"_k{k}_{i}" for i in range(len(pairs))]
        side = right.groupBy(*[F.col(b).alias(n) for n, (_, b) in zip(names, pairs, strict=True)]).agg(F.count("*").alias("_n"), F.min(payload).alias(f"_p{k}")).where("_n = 1").drop("_n")
        on = [F.col(a) == F.col(n) for n, (a, _) in zip(names, pairs, strict=True)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        out = out.join(side, cond, "left").drop(*names)
    found = F.coalesce(*[F.col(f"_p{k}") for k in range(len(steps))])
    how = F.coalesce(*[F.when(F.col(f"_p{k}").isNotNull(), F.lit(n)) for k, (n, _) in enumerate(steps)])
    return out.withColumns({payload: found, "matched_by": F.coalesce(how, F.lit("missing"))}).drop(*[f"_p{k}" for k in range(len(steps))])


def interval_lookup(rows: DataFrame, key: str, number: str, spans: DataFrame, low: str, high: str, value: str) -> DataFrame:
    """The value of the one interval of a row's key that holds its number; null if none or several do."""
    met = rows.select(key, number).distinct().join(spans, key).where(F.col(number).between(F.col(low), F.col(high)))
    one = met.groupBy(key, number).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return rows.join(one, [key, number], "left")


def semi_repeats(rows: DataFrame, ledger: DataFrame, key: str, folder: str, own: str) -> DataFrame:
    """Rows whose key the ledger has from another folder than the row's own."""
    sent = ledger.select(F.col(key).alias("_key"), F.col(folder).alias("_folder")).distinct()
    return rows.join(sent, (F.col(key) == F.col("_key")) & (F.col(own) != F.col("_folder")), "left_semi")


def coverage(parts: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """How each part is covered: not, once, or by several owners."""
    counts = owners.groupBy(key).agg(F.count("*").alias("owners"))
    n = F.coalesce(F.col("owners"), F.lit(0))
    return parts.join(counts, key, "left").withColumns({"owners": n, "state": F.when(n == 0, "gap").when(n == 1, "covered").otherwise("repeated")})


def full_compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides by key with what to do: confirm, learn (left only), keep (right only) or conflict."""
    a, b = left.select(key, F.col(value).alias("observed")), right.select(key, F.col(value).alias("stored"))
    action = F.when(F.col("stored").isNull(), "learn").when(F.col("observed").isNull(), "keep").when(F.col("observed") == F.col("stored"), "confirm").otherwise("conflict")
    return a.join(b, key, "full").withColumn("action", action)


def three_way_merge(base: DataFrame, local: DataFrame, server: DataFrame, key: str, value: str) -> DataFrame:
    """Merges two changed copies of a base.

    Missing on the server: pushed again, never a deletion; dropped locally with the server unchanged: skipped; one side
    changed: that side; both: the server.
    """
    side = lambda df, n: df.select(key, F.col(value).alias(n))
    rows = side(local, "l").join(side(server, "s"), key, "full").join(side(base, "b"), key, "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    has = lambda x: F.col(x).isNotNull()
    how = (
        F.when(has("l") & ~has("s"), "push")
        .when(~has("l") & has("s") & has("b") & same("s", "b"), "skip")
        .when(~has("l") & has("s"), "pull")
        .when(~has("l") & ~has("s"), "gone")
        .when(same("l", "s"), "same")
        .when(same("l", "b"), "server")
        .when(same("s", "b"), "local")
        .otherwise("server_wins")
    )
    rows = rows.withColumn("decision", how)
    merged = F.when(F.col("decision").isin("push", "local", "same"), F.col("l")).when(F.col("decision").isin("pull", "server", "server_wins"), F.col("s"))
    return rows.select(key, merged.alias("merged"), "decision")


def insert_only(stored: DataFrame, learned: DataFrame, key: str) -> DataFrame:
    """What is stored, and what is learned for keys that aren't."""
    return stored.unionByName(learned.join(stored.select(key), key, "left_anti").select(*stored.columns))


def upsert_ledger(rows: DataFrame, keys: Sequence[str], done: str, at: str) -> DataFrame:
    """One entry for each key: done once done, and its first time."""
    return rows.groupBy(*keys).agg(F.bool_or(done).alias(done), F.min(at).alias(at), F.count("*").alias("events"))


def pending_with_headers(rows: DataFrame, done: DataFrame, key: str, section: str, header: Column) -> DataFrame:
    """Rows that aren't done; a section's header stays only while the section has any other."""
    left = rows.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left").withColumn("_open", F.col("_done").isNull() & ~header)
    keep = F.col("_open") | (header & F.max("_open").over(Window.partitionBy(section)))
    return left.withColumn("_keep", keep).where("_keep").drop("_done", "_open", "_keep")


def remote_plan(local: DataFrame, remote: DataFrame, key: str, fields: Sequence[str], valid: str) -> DataFrame:
    """What to do with each local row: write it, leave it (the same already), skip it (valid remotely), or report it missing; and the fields that differ."""
    there = remote.select(F.col(key), F.col(valid).alias("_valid"), *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    rows = local.join(there, key, "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    action = F.when(F.col("_there").isNull(), "missing").when(F.size(changed) == 0, "same").when(F.col("_valid"), "skip").otherwise("write")
    return rows.withColumns({"action": action, "changed": F.when(F.col("_there").isNull(), "").otherwise(F.array_join(changed, ","))}).drop("_there", "_valid", *[f"_{f}" for f in fields])


def correction_plan(exceptions: DataFrame, key: str, kind: str, copies: str) -> DataFrame:
    """Per number: delete all but one copy of duplicates; reindex what is misfiled, unless it is a duplicate too."""
    rows = exceptions.groupBy(key).agg(F.max(F.when(F.col(kind) == "duplicate", F.col(copies))).alias("n"), F.bool_or(F.col(kind) == "misfiled").alias("misfiled"))
    action = F.when(F.col("n") > 1, "delete").when(F.col("misfiled"), "reindex").otherwise("none")
    return rows.select(key, action.alias("action"), F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0).cast("long").alias("rows"))


def same_content(left: DataFrame, right: DataFrame, key: str, position: str, value: str, least: int = 2) -> DataFrame:
    """Whether two copies of a title hold the same: yes with enough agreeing samples and no other, no with more differing than agreeing, else unclear."""
    met = left.select(key, position, F.col(value).alias("a")).join(right.select(key, position, F.col(value).alias("b")), [key, position])
    counts = met.groupBy(key).agg(F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count_if(F.col("a") != F.col("b")).alias("differ"))
    return counts.withColumn("verdict", F.when((F.col("agree") >= least) & (F.col("differ") == 0), "same").when(F.col("differ") > F.col("agree"), "other").otherwise("unclear"))


def exact_or_partial(rows: DataFrame, cell: Column, text: str) -> DataFrame:
    """Rows whose cell is ``text``; only if there are none, those whose cell holds it. ``exact`` says which."""
    hits = rows.withColumns({"exact": cell == text, "_in": cell.contains(text)}).where("_in").drop("_in")
    any_exact = hits.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("_any"))
    return hits.join(F.broadcast(any_exact)).where(F.col("exact") | ~F.col("_any")).drop("_any")  # one row


def copies_of(grid: DataFrame, wanted: DataFrame, number: str, images: str) -> DataFrame:
    """The rows of a grid that are one of the wanted numbers, without white space around them; empty numbers are none.

    A count of images that isn't digits alone is null: it never allows a deletion.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    asked = wanted.select(clean(number).alias("_number")).where("_number <> ''").distinct()
    met = grid.withColumn("_number", clean(number)).join(asked, "_number", "left_semi")
    counted = F.when(clean(images).rlike("^[0-9]+$"), clean(images).try_cast("long"))
    return met.withColumns({number: F.col("_number"), images: counted}).drop("_number")
