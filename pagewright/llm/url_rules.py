"""URL filters: fixed host and path rules, and token combinations mined from labels by FP-growth.

A URL's tokens are its scheme, its host's last one and two labels, each label before them whole and in its parts between
hyphens, path segments with their digits blotted out, the path's extension and query keys. Spark's FP-growth finds the
combinations that labelled URLs share; those that imply the label with enough support and confidence become rules.
Each rule is filed in an inverted index under its rarest token; a URL looks up its tokens and is matched by the rules of
which it has all tokens. Everything is DataFrame functions; the index is broadcast only if Spark finds its table small.

Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens and the verdict allow; labels without
an id are left out, and a page with any blocking label is labelled so; without labels nothing is mined; repeated rows get
the same verdict; an empty table gives an empty result; other columns pass through ``judge`` whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import free_name, written

#: Host, path and verdict of the rules that always hold.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label=block"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
MIN_ROWS = 20


def url_part(url: str | Column, k: int) -> Column:
    """Group ``k`` of ``PARTS``, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))


def host_of(url: str | Column) -> Column:
    return F.translate(url_part(url, 2), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    return url_part(url, 3)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: str | Column) -> Column:
    """A URL's distinct tokens."""
    marked = lambda mark, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    host, path = host_of(url), path_of(url)
    names = F.split(host, r"\.")
    labels = F.slice(names, F.lit(1), F.greatest(F.size(names) - 2, F.lit(0)))
    parts = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    extension = F.array(F.regexp_extract(path, r"(?s)[^/]\.([^./]*)$", 1))
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, r"[0-9]+", "#"))
    keys = F.transform(F.split(url_part(url, 4), "&"), lambda x: F.split(x, "=")[0])
    suffixes = F.array(F.substring_index(host, ".", -1), F.substring_index(host, ".", -2))
    tokens = F.concat(F.array(F.concat(F.lit("scheme:"), url_part(url, 1))), marked("suffix:", suffixes), marked("label:", labels), marked("part:", parts), marked("path:", segments), marked("extension:", extension), marked("key:", keys))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rules from ``labelled`` (url, blocked): anchor (the rarest token), tokens, confidence, support. A rule holds for ``min_rows`` rows at least."""
    items = written(labelled.select(F.when(F.col("blocked"), F.array_append(url_tokens("url"), F.lit(LABEL))).otherwise(url_tokens("url")).alias("items")).where(F.size("items") > 0), "url-items")
    least = min(1.0, max(min_support, min_rows / max(1, items.count())))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == LABEL).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rare = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = rules.select("tokens", F.explode("tokens").alias("token")).join(rare, "token").groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    return written(rules.join(anchors, "tokens").select("anchor", "tokens", "confidence", "support"), "url-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct URLs of ``urls`` (column url) that a rule matches, with the highest confidence."""
    looked_up = urls.select("url", url_tokens("url").alias("has")).select("url", "has", F.explode("has").alias("anchor")).join(rules, "anchor")
    return looked_up.where(F.size(F.array_except("tokens", "has")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and blocked (low quality or toxic) of the pages that have a label."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.coalesce(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)), F.lit(False)).alias("blocked"))
    return pages.select("page_id", "url").join(known, "page_id").select("url", "blocked")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict, named so that they clash with no column."""
    host, path, rule, verdict = free_name(pages, "host", "path", "rule", "verdict")
    key, fixed, sure = free_name(pages, "url_key", "url_fixed", "url_confidence")
    rows = pages.withColumns({host: host_of(url_col), path: path_of(url_col)})
    rows = rows.withColumn(fixed, F.struct(*[c.alias(n) for c, n in zip(fixed_rule(F.col(host), F.col(path)), ("rule", "verdict"), strict=True)]))
    open_urls = rows.where(F.col(f"{fixed}.verdict").isNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"))
    found = written(matches(open_urls, rules), "url-matches").select(F.col("url").alias(key), F.col("confidence").alias(sure))
    joined = rows.join(found, F.col(url_col) == F.col(key), "left")
    said = F.coalesce(F.col(f"{fixed}.verdict"), F.when(F.col(sure).isNotNull(), "block").otherwise("allow"))
    return joined.select(*pages.columns, host, path, F.col(f"{fixed}.rule").alias(rule), said.alias(verdict))


def filter_pages(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    rules = mine(labelled_pages(pages, labels), min_support, min_confidence, min_rows)
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
