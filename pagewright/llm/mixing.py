"""Mixing sources to target weights through a tree of domains, languages and sources.

A node's budget is dealt among its children in proportion to integer weights; a child can take no more than its supply
(its tokens times ``max_epochs``), and what it can't take goes to its siblings. Only what a whole subtree lacks moves up, as
subtrees are dealt their budgets by the same rule first. What whole tokens leave over goes to the largest remainders, so
that every budget is dealt to the token. Each leaf then reads whole epochs and, for the rest, the token-prefix of one more
epoch in which the leaf's rows stand in an order drawn from the seed, the epoch and the id; of the row in which the rest
runs out the first tokens are read. Prefixes are found from token sums by slices of that order, so that only the slice in
which the rest runs out is sorted row by row. What counts as a token is a parameter: words, or a vocabulary's tokens.

Defined cases: null keys are the key ``(none)``; a null or empty text has no tokens and is drawn with every whole epoch and
with a prefix that reaches it; a null id orders as ``none``; repeated rows are drawn one by one; a weight of zero gives
nothing; an empty table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import tokens
from pagewright.llm.shared import free_name, written

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order's key in a coarse slice; a fine one has twice as many.
SLICE_DIGITS = 2
#: Into so many parts a leaf's rows are dealt where they meet its plan, as one leaf may hold a third of all rows.
SALTS = 64
FILES = 8

#: Fixed values of the production mix: weights of the children by name; any other child counts 1.
WEIGHTS = {"domain": {"d0": 3, "d1": 3, "d2": 2, "d3": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}


#: Counts a text column's tokens, and gives the text of its first n.
Tokens = tuple[Callable[[str], Column], Callable[[str, str], Column]]


def n_words(text: str | Column) -> Column:
    """A text's words as its tokens."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: str, n: str) -> Column:
    """The text up to the end of its ``n``-th word."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        import re

        ends = lambda x: [m.end() for m in re.finditer(WORD, x)]
        return pd.Series([x and x[: (ends(x)[: int(k)] or [0])[-1]] for x, k in zip(texts, sizes, strict=True)], dtype=object)

    return cut(F.make_valid_utf8(text), n)


WORDS: Tokens = (n_words, first_words)


def vocabulary_tokens(spark: SparkSession, path: str = tokens.VOCABULARY) -> Tokens:
    return (lambda text: tokens.token_count(spark, text, path)), (lambda text, n: tokens.token_prefix(spark, text, n, path))


def domain_of(source: str | Column) -> Column:
    """Four domains by the number that ends a source's name; ``other`` without one."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(digits.try_cast("int"), F.lit(4)).cast("string")))


def leaf_columns(text_col: str = "text", lang_col: str = "lang", source_col: str = "source", count: Tokens = WORDS) -> dict[str, Column]:
    """The keys of a document's leaf, and its tokens."""
    none = lambda c: F.coalesce(F.col(c), F.lit("(none)"))
    return {"domain": domain_of(source_col), "lang": none(lang_col), "source": none(source_col), "n_tokens": count[0](text_col)}


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    named = weights.get(level) or {}
    out = F.lit(1).cast("long")
    for name, w in named.items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def deal(children: DataFrame, parents: list[str], name: str, out: str = "budget") -> DataFrame:
    """Deals each parent's ``given`` among its children by weight, up to their supply; columns name, supply, weight, given and the parents' keys.

    A window holds one parent's children: names of a level, not rows.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf"))), name)
    df = children.withColumns(
        {
            "before": F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "after": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("full", (F.col("weight") > 0) & (F.col("supply") * F.col("after") <= (F.col("given") - F.col("before")) * F.col("weight")))
    df = df.withColumns({"rest": F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(group), F.lit(0)), "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)})
    df = df.withColumn(out, F.when(F.col("full"), F.col("supply")).otherwise(F.coalesce(F.expr("rest * weight div nullif(open, 0)"), F.lit(0))))
    df = df.withColumns({"part": F.when(~F.col("full"), F.expr("rest * weight % nullif(open, 0)")), "over": F.col("rest") - F.sum(F.when(~F.col("full"), F.col(out))).over(group)})
    one_more = (F.col("part") > 0) & (F.row_number().over(group.orderBy(F.desc_nulls_last("part"), name)) <= F.col("over"))
    return df.withColumn(out, F.col(out) + F.coalesce(one_more, F.lit(False)).cast("long")).drop("before", "after", "full", "rest", "open", "weight", "given", "part", "over")


def leaf_budgets(leaves: DataFrame, share: tuple[int, int], max_epochs: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """Each leaf's budget in tokens; ``leaves`` has the keys and tokens. The root is given ``share`` (a fraction) of all tokens."""
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    given = leaves.agg((F.least(F.expr(f"sum(tokens) * {share[0]}L div {share[1]}L"), F.sum("supply"))).alias("given"))
    done: list[str] = []
    for k, level in enumerate(LEVELS):
        own = [*done, level]
        nodes = leaves.groupBy(*own).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(given, done) if k else nodes.join(F.broadcast(given))  # one row
        dealt = written(deal(nodes, done, level), "mixing-level", FILES)
        given, done = dealt.select(*own, F.col("budget").alias("given")), own
    return dealt


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("none"))))


def slice_of(key: Column) -> Column:
    """The fine slice of a key."""
    return F.substring(key, 1, 2 * SLICE_DIGITS)


def mix_plan(rows: DataFrame, share: tuple[int, int], max_epochs: int, seed: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """Per leaf: epochs read whole, the rest of the budget, and the slice of the next epoch in which it runs out. ``rows``: doc_id, the keys, n_tokens."""
    keys = list(LEVELS)
    leaves = written(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "mixing-leaves", FILES)
    plan = leaf_budgets(leaves, share, max_epochs, weights).select(*keys, "budget", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(max_epochs)).alias("epochs"), F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).alias("rest"))
    plan = written(plan, "mixing-plan", FILES)
    keyed = _by_leaf(rows, plan, keys).select(*keys, "doc_id", "n_tokens", order_key(seed, F.col("epochs") + 1, F.col("doc_id")).alias("key"))
    keyed = written(keyed, "mixing-keyed")
    cut = written(_crossing(keyed, plan.select(*keys, "rest", F.lit("").alias("cut_slice"), F.lit(0).cast("long").alias("cut_before")), 1), "mixing-cuts", FILES)
    cut = written(_crossing(keyed, cut, 2), "mixing-cuts", FILES)
    return written(plan.join(cut.drop("rest"), keys, "left"), "mixing-cuts", FILES)


def _by_leaf(rows: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their leaf's row, joined on the leaf and a salt."""
    (salt,) = free_name(rows, "salt")
    dealt = leaves.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")).join(dealt, [*keys, salt]).drop(salt)


def _crossing(keyed: DataFrame, cuts: DataFrame, depth: int) -> DataFrame:
    """The slice, ``SLICE_DIGITS`` finer than that of ``cuts``, in which each leaf's rest runs out, and the tokens before it. A leaf has at most 256 slices in a slice."""
    keys = list(LEVELS)
    inside = _by_leaf(keyed, cuts, keys).where(F.col("key").startswith(F.col("cut_slice")))
    slices = inside.groupBy(*keys, "rest", "cut_before", F.substring("key", 1, SLICE_DIGITS * depth).alias("slice")).agg(F.sum("n_tokens").alias("tokens"))
    until = F.col("cut_before") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy("slice"))
    crossed = slices.withColumn("until", until).where("until > rest").groupBy(*keys, "rest").agg(F.min(F.struct("slice", (F.col("until") - F.col("tokens")).alias("before"))).alias("cut"))
    return crossed.select(*keys, "rest", F.col("cut.slice").alias("cut_slice"), F.col("cut.before").alias("cut_before"))


def draw(
    docs: DataFrame, plan: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", out: str = "n_draws", prefix: str = "prefix_tokens", count: Tokens = WORDS
) -> DataFrame:
    """``docs`` with how often each row is drawn, and for the row in which its leaf's rest runs out how many tokens the last draw has (else null).

    Only the rows of the slices that are cut are sorted.
    """
    cols = leaf_columns(text_col, lang_col, source_col, count)
    d, g, s, t, p, k, until, salt = free_name(docs, "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_plan", "mix_key", "mix_until", "mix_salt")
    packed = plan.select(F.col("domain").alias(d), F.col("lang").alias(g), F.col("source").alias(s), F.struct("epochs", "rest", "cut_slice", "cut_before").alias(p), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    rows = docs.withColumns({d: cols["domain"], g: cols["lang"], s: cols["source"], salt: F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")}).join(packed, [d, g, s, salt])
    rows = rows.withColumn(k, order_key(seed, F.col(f"{p}.epochs") + 1, F.col(id_col)))
    whole, at, cut, rest = F.col(f"{p}.epochs").cast("int"), slice_of(F.col(k)), F.col(f"{p}.cut_slice"), F.col(f"{p}.rest")
    clear = rows.where(cut.isNull() | (at != cut)).withColumns({out: whole + F.when((rest > 0) & (cut.isNull() | (at < cut)), 1).otherwise(0), prefix: F.lit(None).cast("long")})
    order = Window.partitionBy(d, g, s).orderBy(k, t).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(at == cut).withColumn(t, cols["n_tokens"]).withColumn(until, F.sum(t).over(order) + F.col(f"{p}.cut_before"))
    left = rest - (F.col(until) - F.col(t))
    edge = edge.withColumns({out: whole + F.when((rest > 0) & ((F.col(until) <= rest) | (left > 0)), 1).otherwise(0), prefix: F.when((F.col(until) > rest) & (left > 0), left)})
    return clear.select(*docs.columns, out, prefix).unionByName(edge.select(*docs.columns, out, prefix))


def mix(
    docs: DataFrame, share: tuple[int, int], max_epochs: int, seed: int = 7, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, out: str = "n_draws", prefix: str = "prefix_tokens", count: Tokens = WORDS
) -> DataFrame:
    """``docs`` with the columns ``out``, how often each row is drawn (0 to ``max_epochs``), and ``prefix``, the tokens of its last draw if that is cut."""
    rows = written(docs.select("doc_id", *[c.alias(n) for n, c in leaf_columns(count=count).items()]), "mixing-rows")
    return draw(docs, mix_plan(rows, share, max_epochs, seed, weights), seed, out=out, prefix=prefix, count=count)


def mixed(
    docs: DataFrame, share: tuple[int, int], max_epochs: int, seed: int = 7, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, count: Tokens = WORDS, text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """The drawn rows of ``docs``, as often as drawn; a last draw that is cut holds the text of its first tokens. ``length_col`` counts a text's characters and is counted again where it is cut."""
    n, prefix, copy = free_name(docs, "n_draws", "prefix_tokens", "copy")
    drawn = mix(docs, share, max_epochs, seed, weights, n, prefix, count).where(F.col(n) > 0)
    drawn = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))) if max_epochs > 1 else drawn.withColumn(copy, F.lit(1))
    is_cut = F.coalesce((F.col(copy) == F.col(n)) & F.col(prefix).isNotNull(), F.lit(False))
    cut = drawn.where(is_cut).withColumn(text_col, count[1](text_col, prefix))
    if length_col:
        cut = cut.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return drawn.where(~is_cut).select(docs.columns).unionByName(cut.select(docs.columns))
