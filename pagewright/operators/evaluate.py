"""Scores of verdicts against labels."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.sequences import by_book


def verdict(score: str | Column, absent: float, present: float) -> Column:
    """Present from one threshold, absent up to another, unsure between."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= present, "present").when(c <= absent, "absent").otherwise("unsure")


def confusion(df: DataFrame, label: str, said: str) -> DataFrame:
    return df.groupBy(label, said).agg(F.count("*").alias("n"))


def cost_grid(df: DataFrame, score: str, label: str, absent: Sequence[float], present: Sequence[float], false_present: float, false_absent: float, unsure: float) -> DataFrame:
    """Counts and weighted cost of each pair of thresholds, in one pass over the rows."""
    grid = [(a, p) for a in absent for p in present if a < p]
    entries = F.array(*[F.struct(F.lit(a).alias("absent"), F.lit(p).alias("present"), verdict(score, a, p).alias("said")) for a, p in grid])
    rows = df.select(label, F.explode(entries).alias("g")).select(label, "g.*")
    wrong_present, wrong_absent = F.count_if((F.col("said") == "present") & (F.col(label) == 0)), F.count_if((F.col("said") == "absent") & (F.col(label) == 1))
    left = F.count_if(F.col("said") == "unsure")
    return rows.groupBy("absent", "present").agg(wrong_present.alias("false_present"), wrong_absent.alias("false_absent"), left.alias("unsure"), ((wrong_present * false_present + wrong_absent * false_absent + left * unsure) / F.count("*")).alias("cost"))


def stratified_folds(df: DataFrame, strata: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Round-robin folds within each stratum."""
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1) % k).cast("int"))


def component_matches(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """How many rows agree in each component, and in all."""
    same = {n: F.col(a).eqNullSafe(F.col(b)) for n, (a, b) in pairs.items()}
    whole = F.lit(True)
    for c in same.values():
        whole = whole & c
    return df.agg(F.count("*").alias("n_rows"), F.count_if(whole).alias("exact"), *[F.count_if(c).alias(n) for n, c in same.items()])


def confident_bands(df: DataFrame, key: str, score: str, label: str, width: Column, least: int = 3, outliers: int = 2) -> DataFrame:
    """key, ``low`` and ``high`` of each key's band of doubt between its labelled scores, and ``why`` (``wide``, ``narrow``, ``few``, ``overlap``).

    Up to ``outliers`` of the lowest true scores and of the highest false ones are dropped, as few together as make the band
    ``width`` wide (of as many, fewer true ones first); if none is, the widest that keeps the classes apart. ``least`` scores
    of each class must stay. ``label`` is a boolean; null labels, null scores and NaN take no part; a null key is a key. Only
    the extremes of a class are ranked: a bounded number for each key, cut in each task before they meet.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(F.col(key).alias("_key"), F.col(score).alias("_score"), F.col(label).alias("_label"))
    inward = F.when(F.col("_label"), F.col("_score")).otherwise(-F.col("_score"))
    extremes = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_key", "_label").orderBy(inward))).where(F.col("_rn") <= outliers + 1)
    nth = lambda side, k: F.max(F.when((F.col("_label") == side) & (F.col("_rn") == k + 1), F.col("_score"))).alias(f"_{'t' if side else 'f'}{k}")
    heaps = extremes.groupBy("_key").agg(*[nth(side, k) for side in (True, False) for k in range(outliers + 1)])
    sizes = rows.groupBy("_key").agg(F.count_if("_label").alias("_n_true"), F.count_if(~F.col("_label")).alias("_n_false"))
    choices = sorted(((t, f) for t in range(outliers + 1) for f in range(outliers + 1)), key=lambda c: (sum(c), c))
    bands = F.array(*[F.struct((F.col(f"_t{t}") - F.col(f"_f{f}")).alias("wide"), F.lit(-k).alias("rank"), F.col(f"_f{f}").alias("low"), F.col(f"_t{t}").alias("high"), ((F.col("_n_true") - t >= least) & (F.col("_n_false") - f >= least)).alias("ok")) for k, (t, f) in enumerate(choices)])
    apart = F.filter(bands, lambda b: b.ok & (b.high > b.low))
    first = F.get(F.filter(apart, lambda b: b.wide >= width), F.lit(0))
    out = heaps.join(sizes, heaps["_key"].eqNullSafe(sizes["_key"])).drop(sizes["_key"]).withColumn("_band", F.coalesce(first, F.array_max(apart)))
    few = (F.col("_n_true") < least) | (F.col("_n_false") < least)
    why = F.when(few, "few").when(F.col("_band").isNull(), "overlap").when(F.col("_band.wide") >= width, "wide").otherwise("narrow")
    return out.select(F.col("_key").alias(key), "_band.low", "_band.high", why.alias("why"))


def _best_pair(scores: Sequence, neg: Sequence[int], pos: Sequence[int], false_present: int, false_absent: int, unsure: int, share: tuple[int, int]) -> list[float]:
    """absent, present, false_present, false_absent, unsure and rows of the best pair of one group's distinct scores in order.

    What is present depends on one threshold, what is absent on the other, so a pair's cost is a sum of two; for each present
    threshold the absent ones that resolve enough are a range whose ends only move up, and its minimum is held in a queue. Some
    pair always resolves enough: with the lowest score as present threshold nothing is unsure.
    """
    m, total = len(scores), sum(neg) + sum(pos)
    below, lost = [0], [0]  # rows and true rows among the first scores
    for a, b in zip(neg, pos, strict=True):
        below.append(below[-1] + a + b)
        lost.append(lost[-1] + b)
    false_below = [b - p for b, p in zip(below, lost, strict=True)]
    cost = lambda j, i: false_present * (false_below[m] - false_below[j]) + false_absent * lost[i] + unsure * (below[j] - below[i])  # noqa: E731  rows from j on are present, the first i absent
    g = [false_absent * x - unsure * n for x, n in zip(lost, below, strict=True)]
    best = (cost(0, 0), 0, 0)
    queue: deque[int] = deque()
    for j in range(1, m):
        i = j  # the first j scores absent: the next candidate
        while queue and g[queue[-1]] > g[i]:
            queue.pop()
        queue.append(i)
        while queue and (below[queue[0]] + total - below[j]) * share[1] < share[0] * total:
            queue.popleft()
        if queue:
            best = min(best, (cost(j, queue[0]), j, queue[0]))
    _, j, i = best
    return [float(x) for x in (scores[max(i - 1, 0)], scores[j], false_below[m] - false_below[j], lost[i], below[j] - below[i], total)]


def best_thresholds(df: DataFrame, key: str, score: str, label: str, false_present: int, false_absent: int, unsure: int, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The cheapest pair of thresholds of each key that leaves at most 1 - ``share`` of its rows unsure: absent, present, the counts and the cost.

    The grid is all of the key's distinct scores; absent is not above present, and a score that is both is present. Of equal
    costs the lowest present threshold wins, then the lowest absent one. The rows are read once, into counts for each score;
    a key's counts (not its rows) are held by one task. Null scores and labels take no part; ``label`` is 0 or 1.
    """
    counted = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.col(score).cast("double").alias("_score")).agg(F.count_if(F.col(label) == 0).alias("_neg"), F.count_if(F.col(label) == 1).alias("_pos"))
    kernel = lambda scores, neg, pos: [_best_pair(scores, neg, pos, false_present, false_absent, unsure, share)] + [None] * (len(scores) - 1)
    best = by_book(counted, [key], ["_score"], ["_score", "_neg", "_pos"], "_best array<double>", kernel).where("_best IS NOT NULL")
    whole = lambda k: F.col("_best")[k].cast("long")
    counts = [whole(2).alias("false_present"), whole(3).alias("false_absent"), whole(4).alias("unsure"), whole(5).alias("n_rows")]
    cost = (whole(2) * false_present + whole(3) * false_absent + whole(4) * unsure) / whole(5)
    return best.select(key, F.col("_best")[0].alias("absent"), F.col("_best")[1].alias("present"), *counts, cost.alias("cost"))


def vector_medians(df: DataFrame, key: str, vector: str, least: int = 3) -> DataFrame:
    """key and ``medians``: the median of each element over a key's vectors of whole numbers (the mean of the middle two).

    Vectors may differ in length: an element is that of the vectors that have it, and null if fewer than ``least`` do. Null
    vectors and elements take no part; a null key is a key. Each level of an element is counted, partly in each task, so what
    meets is bounded by levels, not by rows.
    """
    elements = df.select(F.col(key).alias("_key"), F.posexplode(vector).alias("_place", "_level")).where("_level IS NOT NULL")
    counts = elements.groupBy("_key", "_place", F.col("_level").cast("long").alias("_level")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_key", "_place").orderBy("_level")
    upto = counts.withColumns({"_upto": F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_all": F.sum("_n").over(Window.partitionBy("_key", "_place"))})
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    at = lambda rank: F.max(F.when(holds(rank), F.col("_level")))
    middle = upto.groupBy("_key", "_place").agg(F.when(F.max("_all") >= least, (at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias("_median"))
    return middle.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_median"))), lambda x: x["_median"]).alias("medians")).select(F.col("_key").alias(key), "medians")


def tallies(df: DataFrame, keys: Sequence[str], label: str, said: str) -> DataFrame:
    """Of each group's labelled rows (``label`` is a boolean), how often the verdict (``present``, ``absent`` or anything else) was right, wrong or unsure."""
    yes, no = F.col(said) == "present", F.col(said) == "absent"
    there = F.col(label)
    unsure = ~F.coalesce(yes | no, F.lit(False))
    counts = {"correct": (there & yes) | (~there & no), "false_present": ~there & yes, "false_absent": there & no, "unsure_present": there & unsure, "unsure_absent": ~there & unsure}
    return df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])


def reviewed_by_band(df: DataFrame, key: str, score: str, said: str, width: Column, may_be_absent: Column | None = None) -> DataFrame:
    """``df`` with ``reviewed``: verdicts that are neither present nor absent, decided by the band that the key's other verdicts leave.

    From the band's high end a score is present, up to its low end absent (where ``may_be_absent``); within it, or without a
    band, the verdict stays.
    """
    known = F.when(F.col(said) == "present", True).when(F.col(said) == "absent", False)
    bands = confident_bands(df.withColumn("_known", known), key, score, "_known", width).select(F.col(key).alias("_k"), "low", "high")
    met = df.join(bands, F.col(key).eqNullSafe(F.col("_k")), "left")
    absent = (F.col(score) <= F.col("low")) & (F.lit(True) if may_be_absent is None else may_be_absent)
    open_ = ~F.coalesce(F.col(said).isin("present", "absent"), F.lit(False))
    reviewed = F.when(open_ & (F.col(score) >= F.col("high")), "present").when(open_ & absent, "absent").otherwise(F.col(said))
    return met.withColumn("reviewed", reviewed).drop("_k", "low", "high")
