"""SimHash near-duplicates: 64-bit fingerprints, exact links within a Hamming radius of three, connected components.

Only distinct fingerprints are compared. Two that differ in at most three of 64 bits agree on all bits of b - 3 out of b
blocks, so equal bits of such blocks deal the fingerprints into buckets (b follows their number, so that a bucket stays
small at any size). Every bucket is compared by tiles: a bucket of at most ``TILE`` rows is one tile; a larger one is cut by
population count and hash, and each pair of its tiles that lie within the radius is a group of its own, others are skipped. A
bucket has at most ``CUTS`` tiles in a band of population counts, so that its rows are multiplied by a fixed number at most
and the tiles grow instead. Within a group, rows sorted by population count are compared ``STEP`` by ``STEP`` with numpy's
exclusive-or and bit counts, and pairs of steps whose population counts differ beyond the radius are skipped. A task returns
a spanning forest of the links it found, never all pairs; star contractions join the forests into components.

Three of 64 bits is a tight radius: it finds texts that differ in a word or two. ``drop_near_duplicates`` therefore has a second
pass over the classes' leaders, with 256 bits over distinct five-word shingles and a radius of ``WIDE_RADIUS``, that of
texts which share four fifths of their shingles and a little more (see README for its recall). So wide a radius leaves no
blocks to agree on; leaders meet in the buckets of anchors instead: of a text's ``ANCHORS`` smallest shingle hashes the
``CHOSEN`` that fewest leaders have. Two texts that share four fifths of their shingles share none of these about once in ten
thousand times, and a passage that many texts quote is nobody's rare anchor. Buckets are first compared within tiles, then within
tiles of the rows that stand for their tiles' classes, as long as that halves them; this only finds most links early. In
each bucket of more than a tile, whatever its size, all pairs of rows that aren't of one component by then are compared,
so that the components are those of all pairs. Rows alike cost little so; n rows of one bucket that are not alike cost
n * n / 2 comparisons.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; null ids are no smallest id (a
component of null ids has a null one); repeated rows are rows of one class; an empty table gives an empty result; other
columns are not read, whatever their names. ``drop_near_duplicates`` keeps one row of each class and every row without an
id, which no class id could name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import free_name, only_last, utf8, written

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 2048
STEP = 1024
CUTS = 64
BUCKET = 128
LANES = np.uint64(0x0101010101010101)
EDGE_SCHEMA = "u long, v long"
#: The second pass: words of a shingle, lanes of 64 bits, bits that may differ, smallest hashes of a text, and how many of them make buckets.
WIDE_SHINGLE, LANES_WIDE, WIDE_RADIUS, ANCHORS, CHOSEN = 5, 4, 48, 16, 8
#: Tiles that the rows of a large bucket are cut into at most, so that rows are multiplied by a fixed number; beyond that the tiles grow.
PAIRED = 16
#: Multipliers of the words' places, and those of the splitmix64 finaliser.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: What tells the lanes apart.
STARTS = np.arange(LANES_WIDE, dtype=np.uint64) * PLACES[0]
SKETCHES = "doc_id long, fp long, wide binary, anchors array<long>"
MEMBERS = "bucket long, doc_id long, wide binary"
FOUND = "bucket long, doc_id long, wide binary, root long"


def bit_totals(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in ``h``; lowest bit first. Eight bits are summed at once, one in each byte."""
    out = np.empty(64, np.int64)
    starts = np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, starts)
        out[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, signed."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64, n)
    bits = (bit_totals(h) * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits spread over all of its 64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def wide_sketch(text: bytes, known: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The wide fingerprint of a text in UTF-8, and its smallest distinct shingle hashes. ``known`` holds words' hashes."""
    words = text.lower().split()
    if not words:
        return bytes(8 * LANES_WIDE), np.empty(0, np.int64)
    digest, out = xxhash.xxh64_intdigest, []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w, SEED)
        out.append(h)
    at = np.array(out, np.uint64)
    n = max(1, len(at) - WIDE_SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WIDE_SHINGLE, len(at))):
        h += mixed(at[k : k + n] * PLACES[k])
    h = np.unique(mixed(h))
    bits = [(bit_totals(mixed(h + start)) * 2 > len(h)).astype(np.uint8) for start in STARTS]
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes(), h[:ANCHORS].view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both fingerprints and the anchors of each row, by ``SKETCHES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            fps, wides, anchors = [], [], []
            for x in batch.column(1):
                text = x.as_py()
                wide, own = wide_sketch(text, known)
                fps.append(fingerprint(text))
                wides.append(wide)
                anchors.append(own)
                if len(known) > 1 << 14:
                    known.clear()
            kinds = pa.int64(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((fps, wides, anchors), kinds, strict=True))], names=["doc_id", "fp", "wide", "anchors"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, SKETCHES)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_masks(rows: int) -> list[int]:
    """A mask for each choice of b - 3 out of b blocks, signed; b is the least of 4 to 8 with buckets of about ``BUCKET`` rows."""
    for b in range(RADIUS + 1, 9):
        edges = [round(64 * k / b) for k in range(b + 1)]
        if rows / 2 ** (64 * (b - RADIUS) / b) <= BUCKET or b == 8:
            blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
            masks = [sum(c) for c in combinations(blocks, b - RADIUS)]
            return [m - (1 << 64) if m >> 63 else m for m in masks]
    raise AssertionError


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each node but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root == (up := root[root])).all():
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def tile_links(pc: np.ndarray, fp: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The forest of links among rows sorted by population count."""
    x, us, vs, held = fp.view(np.uint64), [], [], 0
    for a in range(0, len(x), step):
        last = pc[min(a + step, len(x)) - 1]
        for b in range(a, len(x), step):
            if pc[b] - last > RADIUS:
                break
            near = np.bitwise_count(x[a : a + step, None] ^ x[None, b : b + step]) <= RADIUS
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            us, vs, held = [*us, fp[a + i]], [*vs, fp[b + j]], held + len(i)
            if held > 1 << 19:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
    return forest(np.concatenate(us), np.concatenate(vs)) if held else (fp[:0], fp[:0])


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Sorted batches as arrays that end where a group ends; column 0 is the group."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= least:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1])
            if cut:
                yield [c[:cut] for c in cols]
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _tile_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group, pc, fp in _whole_groups(batches):
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(starts[1:], len(group))
        met = ends - starts > 1
        found = [tile_links(pc[a:b], fp[a:b]) for a, b in zip(starts[met].tolist(), ends[met].tolist(), strict=True)]
        if found:
            yield _batch(np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found]))


def links(nodes: DataFrame, tile: int = TILE, most: int = CUTS) -> DataFrame:
    """A forest of all links between distinct fingerprints (column fp): u and v, u's component holding v."""
    masks = bucket_masks(nodes.count())
    # a bucket's name is the hash of its table and bits: two that share one only meet in it, and every link is tested
    dealt = nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])).alias("bucket"))
    large = written(dealt.groupBy("bucket").count().where(F.col("count") > tile), "simhash-large")
    marked = dealt.join(large, "bucket", "left").withColumn("pc", F.bit_count("fp").cast("int"))
    band, cuts = F.floor(F.col("pc") / (RADIUS + 1)), F.least(F.ceil(F.col("count") / tile), F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("fp"), cuts).cast("int")
    others = F.sequence(F.lit(0), cuts - 1)
    pairs = F.concat(
        F.transform(others, lambda k: F.xxhash64("bucket", "band", "band", F.least("own", k), F.greatest("own", k))),
        F.transform(others, lambda k: F.xxhash64("bucket", "band", F.col("band") + 1, "own", k)),
        F.transform(others, lambda k: F.xxhash64("bucket", F.col("band") - 1, "band", k, "own")),
    )
    whole = marked.where("count IS NULL").select(F.col("bucket").alias("tiles"), "pc", "fp")
    cut = marked.where("count IS NOT NULL").withColumns({"band": band, "own": own}).select(F.explode(pairs).alias("tiles"), "pc", "fp")
    return whole.unionByName(cut).repartition("tiles").sortWithinPartitions("tiles", "pc").mapInArrow(_tile_edges, EDGE_SCHEMA)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node on an edge, by alternating star contractions.

    Each step is written to the shared folder; it ends when a step changes nothing, that is, when all edges are stars.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "simhash-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
        large = both.join(least, "u").select("v", F.least("u", "m").alias("m")).where("v > m AND v > u").unionByName(edges.join(least, "u").select(F.col("u").alias("v"), "m").where("v > m"))
        edges = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "simhash-edges")
        down = written(edges.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
        small = edges.join(down, "u").select(F.col("v").alias("a"), "m").where("a != m").unionByName(down.select(F.col("u").alias("a"), "m"))
        edges = written(small.select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), "simhash-edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.countDistinct("u").alias("k")).first()
        if now == state and now.n == now.k:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes_of(rows: DataFrame, tile: int = TILE, most: int = CUTS) -> DataFrame:
    """doc_id, fp and component_id of rows with their fingerprints, read from a written table."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    with only_last(rows.sparkSession):
        roots = written(components(links(nodes.select("fp"), tile, most)), "simhash-roots")
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named.select("fp", "root", "least_id"), "simhash-named")
    ids = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-ids")
    of_fp = written(named.join(ids, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, most: int = CUTS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id reachable by links)."""
    return classes_of(written(fingerprints(docs, id_col, text_col), "simhash-fingerprints"), tile, most)


def joining_links(labels: np.ndarray, wide: np.ndarray, other_labels: np.ndarray | None = None, other: np.ndarray | None = None, radius: int = WIDE_RADIUS, step: int = STEP // 2) -> tuple[np.ndarray, np.ndarray]:
    """The forest of links between the classes (``labels``) of rows (``wide``: lanes by rows), or between theirs and those of other rows.

    Pairs of rows that are of one class by then are skipped, as they join nothing; the classes come out as if all pairs were compared.
    """
    alone = other is None
    other_labels, other = (labels, wide) if alone else (other_labels, other)
    totals = np.bitwise_count(other).sum(axis=0, dtype=np.int64)
    names, at = np.unique(np.concatenate((labels, other_labels)), return_inverse=True)
    root, mine, theirs = np.arange(len(names)), at[: len(labels)], at[len(labels) :]
    for a in range(0, len(labels), step):
        x = wide[:, a : a + step]
        own = np.bitwise_count(x).sum(axis=0, dtype=np.int64)
        may = (totals >= own.min() - radius) & (totals <= own.max() + radius)
        if alone:
            may[:a] = False
        left = np.flatnonzero(may)
        for b in range(0, len(left), step):
            y = left[b : b + step]
            ours, its = root[mine[a : a + step]], root[theirs[y]]
            if (ours == ours[0]).all():
                y, its = y[its != ours[0]], its[its != ours[0]]
            if not len(y):
                continue
            apart = np.zeros((len(ours), len(y)), np.uint16)
            for p, q in zip(x, other, strict=True):
                apart += np.bitwise_count(p[:, None] ^ q[None, y])
            i, j = np.nonzero((apart <= radius) & (ours[:, None] != its[None, :]))
            if len(i):
                u, v = forest(ours[i], its[j])
                root[u] = v
                root = root[root]
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _lanes(values: pa.Array) -> np.ndarray:
    """Fingerprints in bytes as lanes by rows."""
    return np.ascontiguousarray(np.frombuffer(b"".join(values.to_pylist()), "<u8").reshape(-1, LANES_WIDE).T)


def _tile_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of a bucket (rows by bucket and tile): each row with the row of its class that stays, or null if it is that row."""
    for keys, ids, values in _groups(batches):
        u, v = joining_links(ids, _lanes(values))
        at = np.searchsorted(u, ids)
        known = (at < len(u)) & (u[np.minimum(at, max(0, len(u) - 1))] == ids) if len(u) else np.zeros(len(ids), bool)
        root = pa.array(v[np.minimum(at, max(0, len(v) - 1))] if len(v) else ids, pa.int64(), mask=~known)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), keys[0])), pa.array(ids), values, root], names=["bucket", "doc_id", "wide", "root"])


def _groups(batches: Iterator[pa.RecordBatch], n: int = 2) -> Iterator[tuple[tuple, np.ndarray, pa.Array]]:
    """Sorted rows as groups that agree in their first ``n`` columns: those, the ids and the fingerprints."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:n]]
        edges = [0, *np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if batch.num_rows > 1 else np.zeros(0, bool)) + 1, batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            own = tuple(int(k[a]) for k in keys)
            if own != now and held:
                yield _group(now, held, n)
                held = []
            now = own
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield _group(now, held, n)


def _group(keys: tuple, held: list[pa.RecordBatch], n: int) -> tuple[tuple, np.ndarray, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    return keys, table.column(n).combine_chunks().to_numpy(zero_copy_only=False), table.column(n + 1).combine_chunks()


def _pair_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles (rows by pair, side and root) as links between the classes of their sides, 0 and 1; side 2 is a tile by itself."""
    left = None
    for (pair, side), roots, values in _groups(batches):
        own = pair, roots, _lanes(values)
        if side == 0:
            left = own
        elif side == 2:
            yield _batch(*joining_links(own[1], own[2]))
        elif left is not None and left[0] == pair:
            yield _batch(*joining_links(left[1], left[2], own[1], own[2]))


def apart_links(rows: DataFrame, edges: DataFrame, tile: int) -> DataFrame:
    """All links that join two components of ``edges`` within a bucket (``rows``: bucket, doc_id, wide), and those components; a written table.

    The rows of a bucket's largest component meet all others of the bucket, and these meet each other. Either side is cut
    into tiles of ``tile`` rows, or into ``PAIRED`` larger ones; each pair of tiles is a group.
    """
    roots = written(components(edges), "simhash-joined")
    named = rows.join(roots, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "wide", F.coalesce("root", "doc_id").alias("root"))
    named = written(named, "simhash-named")
    counts = named.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("n"), F.sum("n").alias("all"))
    cuts = lambda n: F.least(F.ceil(n / tile), F.lit(PAIRED)).cast("int")
    sizes = written(sizes.where("all > n").select("bucket", "most", cuts(F.col("n")).alias("of_most"), cuts(F.col("all") - F.col("n")).alias("of_rest")), "simhash-sizes")
    spread = named.join(sizes, "bucket").withColumn("rest", F.col("root") != F.col("most"))
    spread = spread.withColumn("tile", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.when(F.col("rest"), F.col("of_rest")).otherwise(F.col("of_most"))).cast("int"))
    pair = lambda kind, a, b, side: F.struct(F.xxhash64("bucket", F.lit(kind), a, b).alias("pair"), side.cast("int").alias("side"))
    tile_ = F.col("tile")
    across = lambda n, of: F.transform(F.sequence(F.lit(0), F.col(n) - 1), of)
    of_most = across("of_rest", lambda k: pair(0, tile_, k, F.lit(0)))
    of_rest = F.concat(
        across("of_most", lambda k: pair(0, k, tile_, F.lit(1))),
        across("of_rest", lambda k: pair(1, F.least(tile_, k), F.greatest(tile_, k), F.when(tile_ == k, 2).otherwise((tile_ > k).cast("int")))),
    )
    pairs = spread.select(F.explode(F.when(F.col("rest"), of_rest).otherwise(of_most)).alias("p"), "root", "wide").select("p.pair", "p.side", "root", "wide")
    found = pairs.repartition("pair").sortWithinPartitions("pair", "side", "root").mapInArrow(_pair_edges, EDGE_SCHEMA)
    return written(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found), "simhash-apart")


def second_links(leaders: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (u, v) between leaders (doc_id, wide, anchors) whose components are those of all pairs that share a bucket and lie within the radius; written tables."""
    anchors = written(leaders.select("doc_id", F.explode("anchors").alias("bucket")), "simhash-anchors")
    known = written(anchors.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    # an anchor that nobody shares counts as one of the rarest, but makes no bucket
    ranked = anchors.join(known, "bucket", "left").groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "bucket"))), 1, CHOSEN).alias("own"))
    chosen = ranked.select("doc_id", F.explode("own").alias("x")).where("x.n > 1").select("doc_id", "x.bucket")
    members = written(chosen.join(leaders.select("doc_id", "wide"), "doc_id").select("bucket", "doc_id", "wide").distinct(), "simhash-members")
    edges = large = None
    rows = members
    while True:
        sizes = written(rows.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "simhash-sizes")
        large = sizes.where("tiles > 1").select("bucket") if large is None else large
        # a bucket's own tiles, so that a row meets others in each of its buckets
        spread = rows.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("tiles")).cast("int"))
        found = written(spread.select("bucket", "tile", "doc_id", "wide").repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").mapInArrow(_tile_roots, FOUND), "simhash-found")
        own = found.where("root IS NOT NULL").select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
        edges = own if edges is None else edges.unionByName(own)
        left = written(found.where("root IS NULL").join(sizes.where("tiles > 1"), "bucket").select("bucket", "doc_id", "wide"), "simhash-left")
        before, after = sizes.where("tiles > 1").agg(F.sum("tiles")).first()[0], left.count()
        if not after or 2 * after > before * tile:  # or tiles no longer find enough of their rows alike
            break
        rows = left
    return edges if before is None and rows is members else apart_links(members.join(large, "bucket", "left_semi"), edges, tile)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each class: that with the class's smallest id. Rows that share an id stay or go together; they stay if one of them leads its class."""
    (gone,) = free_name(docs, "gone")
    rows = written(sketches(docs, id_col, text_col), "simhash-sketches")
    leads = classes_of(rows.select("doc_id", "fp")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("leads"))
    leads = written(leads, "simhash-leads")
    with only_last(docs.sparkSession):
        edges = second_links(written(rows.join(leads.where("leads"), "doc_id").select("doc_id", "wide", "anchors"), "simhash-leaders"), tile)
        roots = written(components(edges), "simhash-roots")
    drop = written(leads.where("NOT leads").select("doc_id").unionByName(roots.where("node != root").select(F.col("node").alias("doc_id"))).withColumnRenamed("doc_id", gone), "simhash-drop")
    return docs.join(drop, F.col(id_col) == F.col(gone), "left_anti")
