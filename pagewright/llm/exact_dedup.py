"""Exact deduplication by two passes of a Bloom filter.

Pass one sets cells of a counting Bloom filter (never, once, twice or more) with each text's hash; a hash of which all
cells are set twice or more may be a repeated one. Pass two lets all other rows straight through, and only the possibly
repeated ones are shuffled and grouped by their whole SHA-256. The filter's size follows the row count up to a fixed bound
(``max_cells``), which bounds what is merged, broadcast or held. More rows are split by hash into ranges, each with a filter
of that size, so that the filter is as sharp at any number of rows; hashes and ids (no texts) are then dealt by range, in as
many pieces as a range has rows for, all ranges' filters are built in one job and all hashes tested in another.

Defined cases: a null text counts as empty; a null id is smaller than any other; of rows equal in text and id one stays;
an empty table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import free_name, utf8, written

BLOCK = 1 << 16
CELLS_PER_ROW = 8
MAX_CELLS = 1 << 27
#: Tasks that fill the filter if one is enough, and rows that a task takes of a range if not; a task holds two bits a cell.
TASKS, PIECE = 16, 1 << 22
BLOCK_SCHEMA = "part int, block int, salt int, once binary, twice binary"


def filter_cells(rows: int, max_cells: int = MAX_CELLS) -> int:
    """A power of two: eight cells for each row, at most ``max_cells``, at least one block."""
    return max(BLOCK, min(max_cells, 1 << math.ceil(math.log2(max(1, rows) * CELLS_PER_ROW))))


def cells_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each 64-bit hash."""
    h = hashes.view(np.uint64)
    return (h & np.uint64(cells - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(cells - 1)).astype(np.int64)


def ranges(rows: int, max_cells: int = MAX_CELLS) -> int:
    """Into how many hash ranges the rows are split, so that each row has its eight cells."""
    return max(1, -(-rows * CELLS_PER_ROW // max_cells))


def add(once: np.ndarray, twice: np.ndarray, cells: np.ndarray) -> None:
    """Counts cells into two bit arrays: hit once or more, and twice or more."""
    at, n = np.unique(cells, return_counts=True)
    place, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    own = place[first]
    hit, more = np.bitwise_or.reduceat(bit, first), np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), first)
    twice[own] |= more | (once[own] & hit)
    once[own] |= hit


def _count(cells: int, salts: int):
    """Sorted (part, piece, hash) rows as filled blocks of each part's filter."""

    def blocks(part: int, salt: int, once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = BLOCK // 8
        for k in range(0, cells // 8, step):
            if once[k : k + step].any():
                row = [[part], [k // step], [salt], [once[k : k + step].tobytes()], [twice[k : k + step].tobytes()]]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["part", "block", "salt", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, now = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8), None
        for part, piece, cols in _runs(batches, 2):
            if (part, piece) != now:
                if now is not None:
                    yield from blocks(now[0], now[1] % salts, once, twice)
                    once[:], twice[:] = 0, 0
                now = part, piece
            for own in cells_of(cols[0].to_numpy(zero_copy_only=False).astype(np.int64), cells):
                add(once, twice, own)
        if now is not None:
            yield from blocks(now[0], now[1] % salts, once, twice)

    return run


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Sorted batches cut where their first ``n`` columns (whole numbers) change: those numbers, and the other columns."""
    for batch in batches:
        if batch.num_rows:
            keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:n]]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                own = batch.slice(a, b - a)
                yield (*[int(k[a]) for k in keys], own.columns[n:])


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    once = np.zeros(BLOCK // 8, np.uint8)
    twice = np.zeros(BLOCK // 8, np.uint8)
    for a, b in zip(parts["once"], parts["twice"], strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        twice |= b | (once & a)
        once |= a
    return pd.DataFrame({"part": parts["part"].iloc[:1], "block": parts["block"].iloc[:1], "salt": np.int32(0), "once": [once.tobytes()], "twice": [twice.tobytes()]})


def filters(hashes: DataFrame, cells: int) -> DataFrame:
    """The merged filters by ``BLOCK_SCHEMA``; ``twice`` has the bits of cells that were hit twice or more.

    ``hashes``: part, piece and a long, pieces standing together in a task. Pieces' blocks meet in two steps, four to a part first.
    """
    parts = hashes.mapInArrow(_count(cells, 4), BLOCK_SCHEMA)
    return parts.groupBy("part", "block", "salt").applyInPandas(_merge, BLOCK_SCHEMA).groupBy("part", "block").applyInPandas(_merge, BLOCK_SCHEMA)


def repeated_filter(hashes: DataFrame, cells: int) -> np.ndarray:
    """The bits of one filter over all hashes (one long column), on the driver: an eighth of ``cells`` bytes."""
    one = hashes.coalesce(TASKS).select(F.lit(0).alias("part"), F.spark_partition_id().alias("piece"), hashes.columns[0])
    bits = np.zeros(cells // 8, np.uint8)
    for row in filters(one, cells).select("block", "twice").toLocalIterator():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.twice, np.uint8)
    return bits


def with_maybe(df: DataFrame, hash_col: str, out: str, cells: int, shared: Broadcast) -> DataFrame:
    """``df`` with a boolean column: whether the filter (its bits, broadcast) can't rule out that the hash is repeated."""

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(hits(shared.value, h.to_numpy(np.int64), cells))

    return df.withColumn(out, maybe(hash_col))


def hits(bits: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """Which hashes have both cells set."""
    hit = np.ones(len(hashes), bool)
    for own in cells_of(hashes, cells):
        hit &= (bits[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1 > 0
    return hit


def _test(cells: int, names: list[str]):
    """Sorted rows of ``by_ranges``: a piece's filter, then its rows, which get their verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, now = np.zeros(cells // 8, np.uint8), None
        for part, piece, kind, cols in _runs(batches, 3):
            if (part, piece) != now:
                bits[:], now = 0, (part, piece)
            if kind == 0:
                for block, twice in zip(cols[0].to_pylist(), cols[1].to_pylist(), strict=True):
                    bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(twice, np.uint8)
            else:
                hit = hits(bits, cols[2].to_numpy(zero_copy_only=False).astype(np.int64), cells)
                yield pa.RecordBatch.from_arrays([*cols[3:], pa.array(hit)], names=names)

    return run


def by_ranges(rows: DataFrame, n: int, hash_col: str, max_cells: int, maybe: str = "maybe") -> DataFrame:
    """Narrow ``rows`` with a boolean column: whether their range's filter can't rule out that the hash is repeated.

    Four jobs at any number of ranges: their sizes, the dealt rows, the filters, the tests. A range is dealt in pieces of about
    ``PIECE`` rows, so a hash that many rows have makes more pieces, not a larger one; a piece meets a copy of its range's filter.
    """
    count, cells = ranges(n, max_cells), filter_cells(max_cells // CELLS_PER_ROW, max_cells)
    keyed = rows.withColumns({"_part": F.pmod(F.xxhash64(hash_col), F.lit(count)).cast("int"), "_at": F.monotonically_increasing_id()})
    keyed = written(keyed, "dedup-keyed")
    sizes = written(keyed.groupBy("_part").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_pieces")), "dedup-sizes")  # a row for each 1.7e7 rows
    piece = F.pmod(F.xxhash64("_at"), F.col("_pieces")).cast("int").alias("_piece")
    dealt = keyed.join(F.broadcast(sizes), "_part").select("_part", piece, *rows.columns)
    own = written(filters(dealt.select("_part", "_piece", hash_col).repartition("_part", "_piece").sortWithinPartitions("_part", "_piece"), cells), "dedup-filters")
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    kinds = dict(rows.dtypes)
    heads = own.withColumnRenamed("part", "_part").join(F.broadcast(sizes), "_part").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    heads = heads.select("_part", "_piece", F.lit(0).alias("_kind"), F.col("block").alias("_block"), F.col("twice").alias("_twice"), null("_hash", "long"), *[null(c, kinds[c]) for c in rows.columns])
    tails = dealt.select("_part", "_piece", F.lit(1).alias("_kind"), null("_block", "int"), null("_twice", "binary"), F.col(hash_col).alias("_hash"), *rows.columns)
    met = heads.unionByName(tails).repartition("_part", "_piece").sortWithinPartitions("_part", "_piece", "_kind")
    return met.mapInArrow(_test(cells, [*rows.columns, maybe]), ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, (maybe, "boolean")]))


def marked(rows: DataFrame, n: int, hash_col: str, max_cells: int = MAX_CELLS, maybe: str = "maybe") -> DataFrame:
    """Narrow ``rows``, written, with the verdict of one broadcast filter or, if there are too many of them, of their ranges'."""
    if ranges(n, max_cells) > 1:
        return by_ranges(rows, n, hash_col, max_cells, maybe)
    cells = filter_cells(n, max_cells)
    return with_maybe(rows, hash_col, maybe, cells, rows.sparkSession.sparkContext.broadcast(repeated_filter(rows.select(hash_col), cells)))


def dedup_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest id of its text), group_size, kept, text_sha256."""
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(utf8(text_col), 256).alias("text_sha256")).withColumns({"uid": F.monotonically_increasing_id(), "h": F.xxhash64("text_sha256")}),
        "dedup-hashes",
    )
    n = rows.count()
    met = marked(rows, n, "h", max_cells)
    met = written(met, "dedup-marked") if ranges(n, max_cells) > 1 else met
    straight = met.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    repeated = met.where("maybe").select("doc_id", "uid", "text_sha256")
    groups = written(repeated.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size")), "dedup-groups")
    known = repeated.join(groups, "text_sha256").select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("top.uid")).alias("kept"), "text_sha256")
    return straight.unionByName(known)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` with the row of the largest id for each text. Of the rows that may be repeated only hashes and ids are compared.

    Where one filter is enough, rows that aren't repeated aren't shuffled. Beyond, rows meet the repeated hashes by a join on
    the hash, whose task for a text with very many copies adaptive execution splits.
    """
    sha, h, maybe, top = free_name(docs, "sha", "h", "maybe", "top")
    hashed = docs.withColumn(sha, F.sha2(utf8(text_col), 256)).withColumn(h, F.xxhash64(sha))
    narrow = written(hashed.select(F.col(id_col).alias("id"), F.col(sha).alias("sha"), F.col(h).alias("h")), "dedup-hashes")
    n = narrow.count()

    def tops(rows: DataFrame, least: int) -> DataFrame:
        groups = rows.where("maybe").groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).where(F.col("n") >= least)
        return written(groups, "dedup-groups").select(F.col("sha").alias(sha), F.col("top").alias(top))

    if ranges(n, max_cells) > 1:
        met = hashed.join(tops(by_ranges(narrow, n, "h", max_cells), 2).withColumn(maybe, F.lit(True)), sha, "left")
        straight, repeated = met.where(F.col(maybe).isNull()), met.where(F.col(maybe))
    else:
        cells = filter_cells(n, max_cells)
        bits = docs.sparkSession.sparkContext.broadcast(repeated_filter(narrow.select("h"), cells))
        met, found = with_maybe(hashed, h, maybe, cells, bits), tops(with_maybe(narrow, "h", "maybe", cells, bits), 1)
        straight, repeated = met.where(~F.col(maybe)), met.where(F.col(maybe)).join(found, sha)
    stays = repeated.where(F.col(id_col).eqNullSafe(F.col(top))).dropDuplicates([sha])
    return straight.select(docs.columns).unionByName(stays.select(docs.columns))
