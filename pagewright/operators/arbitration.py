"""Which of two numbers a page has, by the books that the rest of its batch proves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arbitrated(disputed: DataFrame, own_pages: DataFrame, other_pages: DataFrame, batch: str, key: str, plane: str, own: str, other: str, book: Callable[[Column], Column]) -> DataFrame:
    """``disputed`` with ``verdict``: ``own``, ``other`` or null, and ``why``.

    Evidence are the planes of each book of the batch: those of ``own_pages`` (key, number, plane), and of ``other_pages``
    (key, number, plane; pages the other side vouches for) the books of which only one plane is known there. Pages in dispute
    are no evidence, so none speaks for itself. A number is supported if its book is known to be of the page's plane alone,
    and excluded if its book is known to be of others or the number is that of an undisputed own page. A verdict takes
    exactly one supported, not excluded number. Null planes and numbers give none; batches and keys may be null.
    """
    names = dict(batch=F.col(batch), key=F.col(key))
    marked = disputed.select(*[c.alias(f"_{n}") for n, c in names.items()]).distinct()
    free = lambda rows: rows.join(marked, F.col(batch).eqNullSafe(F.col("_batch")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    mine = free(own_pages).where("number IS NOT NULL").select(F.col(batch).alias("_batch"), "number", F.col(plane).alias("_plane"), book(F.col("number")).alias("_book"))
    theirs = free(other_pages).where(F.col("number").isNotNull() & F.col(plane).isNotNull()).groupBy(F.col(batch).alias("_batch"), book(F.col("number")).alias("_book")).agg(F.min(plane).alias("_plane"), F.max(plane).alias("_last"))
    pairs = mine.where("_plane IS NOT NULL").select("_batch", "_book", "_plane").unionByName(theirs.where("_plane = _last").select("_batch", "_book", "_plane")).distinct()
    books = pairs.groupBy("_batch", "_book").agg(F.count("*").alias("_planes"))
    firm = mine.select("_batch", F.col("number").alias("_number")).distinct().withColumn("_firm", F.lit(True))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("number")) for s, c in (("own", own), ("other", other))]))
    asked = disputed.select(F.col(batch).alias("_b"), F.col(key).alias("_k"), F.col(plane).alias("_p"), sides.alias("x")).select("*", "x.side", F.col("x.number").alias("_n"), book(F.col("x.number")).alias("_bk")).drop("x")
    here = F.col("_b").eqNullSafe(F.col("_batch"))
    met = asked.join(books, here & (F.col("_bk") == F.col("_book")), "left").drop("_batch", "_book")
    met = met.join(pairs.withColumn("_known", F.lit(True)), here & (F.col("_bk") == F.col("_book")) & (F.col("_p") == F.col("_plane")), "left").drop("_batch", "_book", "_plane")
    met = met.join(firm, here & (F.col("_n") == F.col("_number")), "left").drop("_batch", "_number")
    known = F.col("_known").isNotNull()
    good = known & (F.col("_planes") == 1) & F.col("_firm").isNull()
    says = lambda side: F.bool_or((F.col("side") == side) & good).alias(f"_{side}")
    found = met.groupBy("_b", "_k").agg(says("own"), says("other"))
    out = disputed.join(found, F.col(batch).eqNullSafe(F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    unread = F.col(plane).isNull()
    missing = F.col(own).isNull() | F.col(other).isNull()
    why = F.when(unread, "no plane").when(missing, "no number").when(F.col("_own") & F.col("_other"), "both").when(F.col("_own") | F.col("_other"), "book").otherwise("neither")
    verdict = F.when(why == "book", F.when(F.col("_own"), "own").otherwise("other"))
    return out.withColumns({"verdict": verdict, "why": why}).drop("_b", "_k", "_own", "_other")
