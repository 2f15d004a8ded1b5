"""Best-fit packing of documents into token sequences, with conflicts.

Each text is encoded once. Documents are dealt by hash into shards of about ``SHARD`` rows and at most about ``SHARD_BYTES``
of text, whatever their number or sources; each shard packs its own bins, longest pieces first. Ids cross the shuffle in two bytes if the vocabulary allows it. Bins stand in the order of
their room; a bin carries a bitmap of its sources and one of its duplicate clusters. The search begins at the least room that
holds the piece and goes on to the next larger until a bin has neither the piece's source nor its cluster; without one, a bin
is opened. A text longer than a bin is cut into full pieces, each a bin of its own, and a rest that is packed. Every piece
carries its token ids and its place, so that a bin's pieces in order are its sequence.

Defined cases: null and empty texts have no tokens and get a row without a bin; a null source or cluster conflicts with
nothing; ties in length go by id, null ids first, then by source and cluster; repeated rows are packed one by one; rows of one
source only make bins of one piece each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import tokens
from pagewright.llm.shared import utf8

CAPACITY = 2048
SHARD = 4096
SHARD_BYTES = 1 << 25
#: Pieces that a task hands on at once: a shard's token ids never stand in its result as a whole.
SLICE = 512
#: Shards of larger tables share partitions.
MOST_PARTITIONS = 1 << 14
ROWS = "doc_id long, source string, cluster long, token_ids binary"
SCHEMA = "doc_id long, piece int, n_tokens long, bin_id string, bin_offset long, source string, cluster long, token_ids array<int>"


def best_fit(lengths: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> list[int]:
    """The bin of each piece, in the order given. None conflicts with nothing."""
    twice = [x for x, n in Counter(clusters).items() if n > 1 and x is not None]
    source_bit = {x: 1 << k for k, x in enumerate(x for x in dict.fromkeys(sources) if x is not None)}
    cluster_bit = {x: 1 << k for k, x in enumerate(twice)}
    rooms: list[tuple[int, int]] = []
    held: list[list[int]] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (held[rooms[at][1]][0] & s or held[rooms[at][1]][1] & c):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        insort(rooms, (room - length, b))
        out.append(b)
    return out


def _pack_shard(capacity: int, kind: type):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # one shard
        docs, sources, clusters = (rows.column(c).to_pylist() for c in ("doc_id", "source", "cluster"))
        ids = [np.frombuffer(x.as_buffer(), kind) for chunk in rows.column("token_ids").chunks for x in chunk]
        pieces = [(min(capacity, len(x) - at), r, k, at) for r, x in enumerate(ids) for k, at in enumerate(range(0, max(1, len(x)), capacity))]
        pieces.sort(key=lambda p: (-p[0], docs[p[1]] is not None, docs[p[1]] or 0, p[2], str(sources[p[1]]), clusters[p[1]] or 0))
        full = sum(p[0] == capacity for p in pieces)
        part = [p for p in pieces[full:] if p[0]]
        found = best_fit([p[0] for p in part], [sources[p[1]] for p in part], [clusters[p[1]] for p in part], capacity)
        bins = [*range(full), *(full + b for b in found)]
        used: Counter[int] = Counter()
        offsets: list[int | None] = []
        for (n, *_), b in zip(pieces, bins, strict=False):
            offsets.append(used[b])
            used[b] += n
        none = [None] * (len(pieces) - len(bins))
        names, offsets = [*(f"{key[0].as_py()}-{b}" for b in bins), *none], [*offsets, *none]
        for at in range(0, len(pieces), SLICE):
            own = pieces[at : at + SLICE]
            values = np.concatenate([np.zeros(0, kind), *[ids[r][k : k + n] for n, r, _, k in own]]).astype(np.int32)
            ends = np.cumsum([0, *(p[0] for p in own)])
            columns = [
                pa.array([docs[p[1]] for p in own], pa.int64()), pa.array([p[2] for p in own], pa.int32()), pa.array([p[0] for p in own], pa.int64()), pa.array(names[at : at + SLICE], pa.string()), pa.array(offsets[at : at + SLICE], pa.int64()),
                pa.array([sources[p[1]] for p in own], pa.string()), pa.array([clusters[p[1]] for p in own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "source", "cluster", "token_ids"])

    return run


def text_cluster(text: str | Column) -> Column:
    """Texts that differ in capitals and white space only are of one cluster; null is of none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))))


def id_kind(vocabulary: str) -> type:
    return np.uint16 if len(tokens.load(vocabulary).sizes) <= 1 << 16 else np.int32


def encoded(rows: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``rows`` (doc_id, source, cluster, text in bytes) with their token ids in bytes, by ``ROWS``."""
    get, kind = tokens.shipped(rows.sparkSession, vocabulary), id_kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = get()
        for batch in batches:
            ids = pa.array([v.encode(x.as_py().decode("utf-8", "replace")).astype(kind).tobytes() for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], names=["doc_id", "source", "cluster", "token_ids"])

    return rows.select("doc_id", "source", "cluster", "text").mapInArrow(run, ROWS)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, vocabulary: str = tokens.VOCABULARY
) -> DataFrame:
    """One row per piece, by ``SCHEMA``: the document, the piece's number and tokens, its bin and place in it."""
    cluster = text_cluster(text_col) if cluster is None else cluster
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(utf8(text_col))).alias("bytes")).first()
    shards = max(1, -(-size.n // shard_rows), -(-(size.bytes or 0) // SHARD_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), utf8(text_col).alias("text"))
    dealt = encoded(rows, vocabulary).withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards))).repartition(min(shards, MOST_PARTITIONS), "shard")
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity, id_kind(vocabulary)), SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per bin: its token ids in order, its pieces with their documents and places, and its tokens. A bin holds at most its capacity of pieces."""
    pieces = F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "piece", "n_tokens", "token_ids")))
    bins = packed.where("bin_id IS NOT NULL").groupBy("bin_id").agg(pieces.alias("own"), F.sum("n_tokens").alias("n_tokens"))
    return bins.select("bin_id", F.flatten("own.token_ids").alias("token_ids"), F.transform("own", lambda p: p.dropFields("token_ids")).alias("pieces"), "n_tokens")
