"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components become integers, floor(64 x). Candidates are dealt into blocks of about ``BLOCK`` rows; a block's index has a
posting segment for each dimension and integer level: the rows at that level, so a query's impact on a segment is its own
component times the level, positive or negative. Segments are processed in bands of descending impact, adding to
accumulators. Once all segments with an impact above t are done, a row's score is at most its accumulator plus t for each
dimension it was not yet met in; negative impacts count too, so this bound falls below the accumulators. The first band's
short segments are read from posting lists, and the rows they put first give the k-th best exact score so far; a later band
holds much of every dimension and is read from columns. Rows whose bound is below the k-th best exact score are out, by proof. Processing stops when at most ``FEW`` of the rows are left,
and those are scored exactly, so the result is exact whatever was skipped.

The first block is searched for all queries before the others, which begin with its k-th best scores. A group of a task is
one block and at most ``QUERY_BLOCK`` queries; it returns k rows for each query.

Rows with an integer of ``FAR`` or more in size stay out of a block's postings and are all scored exactly, in Python integers
where 64 bits may not hold a sum.

Defined cases: null vectors and those with null or non-finite components take no part; a score beyond a long counts as the
nearest long, and a component whose 64-fold is beyond a double as the nearest double; null ids are no queries and no
candidates; vectors of other lengths are filled up with zeros; rows with the query's id are its own, copies too; repeated
rows are candidates of their own; a query id with different vectors gets a list for each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import written

SCALE = 64
BLOCK = 16384
QUERY_BLOCK = 1024
#: Shares of a block's postings after which rows are ruled out.
SHARES = (0.05, 0.45, 0.55, 0.65, 1.0)
FEW = 0.1
#: An accumulator holds the sum of a row's impacts times this, plus the number of dimensions it was met in.
PLACE = 4096
FAR = 2**24
FOUND = "query_id long, query_key long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v (integers, as doubles so that any finite component fits) of the rows that take part."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    most = F.lit(sys.float_info.max)

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, most), -most))

    return embeddings.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), whole).alias("v"))


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact scores, clipped to longs."""
    if vectors.shape[1] * np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) < 2**53:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([min(max(sum(a * int(b) for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1) for v in vectors.tolist()], np.int64)


class Index:
    """The posting segments of a block of integer vectors (held as doubles)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = vectors.astype(float)
        far = np.abs(vectors).max(axis=1, initial=0) >= FAR
        self.far_ids, self.far, self.ids, self.vectors = ids[far], vectors[far], ids[~far], np.ascontiguousarray(vectors[~far])
        n, dims = self.vectors.shape
        self.order = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.levels = np.take_along_axis(self.vectors.T, self.order, axis=1)
        new = np.ones((dims, n), bool)
        new[:, 1:] = self.levels[:, 1:] != self.levels[:, :-1]
        start = np.flatnonzero(new.ravel())
        self.size = np.diff(np.append(start, n * dims))
        self.dim = start // max(n, 1)
        self.level = self.levels.ravel()[start]
        self.first = np.searchsorted(self.dim, np.arange(dims))
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.columns = np.ascontiguousarray(self.vectors.T, np.float32)
        self.rescored = self.seen = 0

    def top(self, query_id: int, query: np.ndarray, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to smaller ids. With ``least``, rows that score lower may be left out."""
        query = query.astype(float)
        left = self.possible(query_id, query, k, least)
        self.rescored, self.seen = self.rescored + len(left), self.seen + len(self.ids)
        far = np.flatnonzero(self.far_ids != query_id)
        ids, score = np.append(self.ids[left], self.far_ids[far]), np.append(_scores(self.vectors[left], query), _scores(self.far[far], query))
        best = np.lexsort((ids, ~score))[:k]
        return ids[best], score[best]

    def possible(self, query_id: int, query: np.ndarray, k: int, least: int | None) -> np.ndarray:
        """The rows that may be among the k best."""
        n, dims = self.vectors.shape
        other = self.ids != query_id
        if not n or dims >= PLACE or dims * PLACE * self.largest * np.abs(query).max(initial=0) >= 2**53:
            return np.flatnonzero(other)  # accumulators would not be exact
        impact = query[self.dim] * self.level
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.size[order])
        ends = [impact[order[min(int(np.searchsorted(done, share * done[-1], "left")), len(order) - 1)]] for share in SHARES]
        below = [impact[impact < t].max(initial=-np.inf) for t in ends]
        sums, met = self._accumulate(query, np.where(impact >= ends[0], self.size, 0))
        seeds = np.flatnonzero(other)
        seeds = seeds[np.argpartition(-sums[seeds], 4 * k)[: 4 * k]] if len(seeds) > 4 * k else seeds
        found = np.sort(_scores(self.vectors[seeds], query))[::-1][:k]
        if len(found) < k and least is None:
            return np.flatnonzero(other)
        least = max((int(x) for x in (found[-1] if len(found) == k else None, least) if x is not None))
        left = np.flatnonzero(other & (sums + (dims - met) * max(below[0], -1e300) >= least))
        impacts = None
        for t in below[1:]:
            if len(left) <= max(4 * k, FEW * n):
                break
            impacts = self._impacts(query) if impacts is None else impacts
            left = np.flatnonzero(other & (_bounds(impacts, t) >= least))
        return left

    def _accumulate(self, query: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the impacts that the first segments (by size) have for each row, and in how many dimensions a row was met."""
        n, dims = self.vectors.shape
        rows, adds = [], []
        for d, x, m in zip(range(dims), query.tolist(), np.add.reduceat(sizes, self.first).tolist(), strict=True):
            if m:
                part = slice(n - m, n) if x > 0 else slice(0, m)
                rows.append(self.order[d, part])
                adds.append(self.levels[d, part] * (x * PLACE) + 1)
        both = np.bincount(np.concatenate(rows), np.concatenate(adds), n)
        sums = np.floor(both / PLACE)
        return sums, both - sums * PLACE

    def _impacts(self, query: np.ndarray) -> np.ndarray:
        """The impact of each dimension on each row, from the columns."""
        small = len(query) * self.largest * np.abs(query).max(initial=0) < 2**24  # exact in either kind
        return self.columns * query.astype(np.float32)[:, None] if small else self.vectors.T * query[:, None]


def _bounds(impacts: np.ndarray, t: float) -> np.ndarray:
    """What each row can score at most once all segments above ``t`` are done: the bands down to ``t`` are added for all rows at once."""
    return np.ones(len(impacts), impacts.dtype) @ (np.maximum(impacts, impacts.dtype.type(t)) if t > -np.inf else impacts)


def _vectors(v: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A matrix from lists of doubles, filled up with zeros."""
    lists = v.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _search(k: int, dims: int):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, keys, least = asks.column("query_id").to_numpy(), asks.column("query_key").to_numpy(), asks.column("least").to_pylist()
        index = Index(rows.column("vec_id").to_numpy(), _vectors(rows.column("v"), dims)) if rows.num_rows else None
        found = [index.top(q, v, k, b) for q, v, b in zip(ids.tolist(), _vectors(asks.column("v"), dims), least, strict=True)] if index else []
        sizes = [len(a) for a, _ in found]
        none = np.zeros(0, np.int64)
        cols = [np.repeat(ids[: len(sizes)], sizes), np.repeat(keys[: len(sizes)], sizes), np.concatenate([none, *[a for a, _ in found]]), np.concatenate([none, *[b for _, b in found]])]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "query_key", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each query. Both sides: vec_id and v."""
    asks = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), "v").distinct()
    asks = written(asks, "topk-queries")
    seen = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    asked = asks.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks, dims = max(1, -(-seen.n // block)), max(1, seen.d or 1, asked.d or 1)
    busy = 2 * candidates.sparkSession.sparkContext.defaultParallelism  # fewer queries a group while there are few groups
    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    rows = written(candidates.select("vec_id", "v", dealt.alias("block")), "topk-rows")

    def search(own: DataFrame, asking: DataFrame, first: int, last: int) -> DataFrame:
        """The ``k`` best of each query in each of the blocks from ``first`` to ``last``."""
        parts = max(1, -(-asked.n // query_block), min(-(-asked.n // 32), busy // (last - first + 1)))
        each = own.select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        met = asking.select("query_id", "query_key", "v", "least", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(first), F.lit(last)).cast("array<long>")).alias("block"))
        return each.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInArrow(_search(k, dims), FOUND)

    found = written(search(rows.where("block = 0"), asks.withColumn("least", F.lit(None).cast("long")), 0, 0), "topk-first")
    if blocks > 1:
        least = found.groupBy("query_id", "query_key").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        rest = search(rows.where("block > 0"), asks.join(least, ["query_id", "query_key"], "left"), 1, blocks - 1)
        found = found.unionByName(rest)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
