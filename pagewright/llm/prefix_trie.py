"""A trie of conversation prefixes, merged from partial tries.

Each distinct sequence of first turns is a node; its name is a chained MD5 of the turns' digests, so equal prefixes have
equal names in every task. Tasks first combine the paths of their own conversations into a partial trie: a table of nodes
with sums and smallest members, and of lists of the conversations that end there, cut by ranges of 65,536 ids so that a list
is bounded whatever ends at a node. Partial tries meet in two merges by the hash of the node's name, the first one salted,
which sum members and join lists. The rollup goes from the bottom up: the nodes of which a conversation is the smallest
member are the lower end of its path, so each node has one owner, and the sums over a path's owned nodes from its end upwards,
added up over all owners by another merge, are the sums over subtrees. The number of jobs doesn't depend on the depth.

Defined cases: null roles and texts are empty; malformed bytes are replacement characters; rows go by turn, null first, then
by the MD5 of role and text; equal rows are turns of their own; rows with a null id belong to no conversation and are left
out; an empty table gives an empty result (no root either, as it would have no smallest member); other columns are not read.
A conversation's rows, without their texts, stream through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import written

ROOT = bytes(16)
#: Ids that share their higher bits stand in one list.
ID_BITS = 16
#: Nodes that a task holds before it hands its partial trie on, and parts in which a node's partial tables meet first.
HELD, SALTS = 1 << 17, 16
TURNS = "conv_id long, origin int, turn long, mark binary, chars long, skip int"
PATHS = "conv_id long, depth int, node binary, parent binary, chars long, ends boolean"
PARTS = "node binary, segment long, depth int, parent binary, chars long, least long, members long, ended array<long>"


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, mark (MD5 of role and text) and chars of each row; rows without an id are left out."""
    text = lambda name: F.make_valid_utf8(F.coalesce(F.col(name), F.lit("")))
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return rows.select("conv_id", "turn", mark.alias("mark"), F.char_length("text").cast("long").alias("chars"))


def own_turns(turns: DataFrame) -> DataFrame:
    """Conversations as they are, by ``TURNS``."""
    return turns.select("conv_id", F.lit(1).alias("origin"), "turn", "mark", "chars", F.lit(0).alias("skip"))


def rebuilt_turns(turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Every conversation with its first ``heads`` turns (``most`` at most) replaced by those of conversation ``base``, by ``TURNS``.

    Both are columns of conv_id. A base hands on ``most`` turns at most, to every conversation that names it.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "mark"))
    convs = written(turns.select("conv_id").distinct(), "trie-ids").withColumns({"base": base, "skip": heads})
    bases = convs.select(F.col("base").alias("conv_id")).distinct()
    first = turns.join(bases, "conv_id", "left_semi").withColumn("place", place).where(F.col("place") <= most)
    given = convs.join(written(first.withColumnRenamed("conv_id", "base"), "trie-heads"), "base").where("place <= skip")
    given = given.select("conv_id", F.lit(0).alias("origin"), F.col("place").cast("long").alias("turn"), "mark", "chars", F.lit(0).alias("skip"))
    own = turns.withColumn("skip", heads).select("conv_id", F.lit(1).alias("origin"), "turn", "mark", "chars", "skip")
    return given.unionByName(own)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as paths; each conversation's last node is marked."""
    now, node, depth, left, held = None, ROOT, 0, None, None
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    for batch in batches:
        out = []
        for conv, origin, mark, chars, skip in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if conv != now:
                if held is not None:
                    out.append((*held, True))
                now, node, depth, left = conv, ROOT, 0, None
                held = (conv, 0, ROOT, None, 0)
            if origin:
                left = skip if left is None else left
                if left:
                    left -= 1
                    continue
            out.append((*held, False))
            parent, node, depth = node, hashlib.md5(node + mark).digest(), depth + 1
            held = (conv, depth, node, parent, chars)
        yield _batch(out, PATHS, kinds)
    yield _batch([] if held is None else [(*held, True)], PATHS, kinds)


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])


def paths(turns: DataFrame) -> DataFrame:
    """Each conversation's nodes from the root on, by ``PATHS``; written to the shared folder."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "origin", "turn", "mark")
    return written(dealt.select("conv_id", "origin", "mark", "chars", "skip").mapInArrow(_walk, PATHS), "trie-paths")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths as partial tries: a row for each node, and one for each of its lists."""
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    nodes: dict[bytes, list] = {}
    ended: dict[tuple[bytes, int], list[int]] = {}
    n_ended = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(k, None, *v, None) for k, v in nodes.items()] + [(k, s, None, None, None, None, 0, v) for (k, s), v in ended.items()]
        for at in range(0, len(rows), 10_000):
            yield _batch(rows[at : at + 10_000], PARTS, kinds)
        nodes.clear()
        ended.clear()

    for batch in batches:
        for conv, depth, node, parent, chars, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = nodes.get(node)
            if own is None:
                nodes[node] = [depth, parent, chars, conv, 1]
            else:
                own[3] = min(own[3], conv)
                own[4] += 1
            if ends:
                ended.setdefault((node, conv >> ID_BITS), []).append(conv)
                n_ended += 1
        if len(nodes) + n_ended > HELD:
            yield from flush()
            n_ended = 0
    yield from flush()


def _merged(parts: DataFrame, *also: str) -> DataFrame:
    sums = [F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.min("least").alias("least"), F.sum("members").alias("members"), F.flatten(F.collect_list("ended")).alias("ended")]
    return parts.groupBy("node", "segment", *also).agg(*sums)


def merged_tries(walked: DataFrame) -> DataFrame:
    """The merged node table and lists, by ``PARTS``; written to the shared folder."""
    parts = walked.mapInArrow(_partial, PARTS).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return written(_merged(_merged(parts, "salt").drop("salt")), "trie-nodes")


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, out = None, None, []
    kinds = [pa.binary(), pa.string()]
    for batch in batches:
        for node, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if node != now:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        yield _batch(out, "node binary, ends_sha256 string", kinds)
        out = []
    yield _batch([] if sha is None else [(now, sha.hexdigest())], "node binary, ends_sha256 string", kinds)


def list_digests(tries: DataFrame) -> DataFrame:
    """node and ends_sha256 of each node at which conversations end; a node's lists stream past one hash in ascending order."""
    ids = F.concat_ws(",", F.transform(F.array_sort("ended"), lambda x: x.cast("string")))
    lists = tries.where("segment IS NOT NULL").select("node", "segment", ids.alias("ids")).repartition("node").sortWithinPartitions("node", "segment")
    return lists.select("node", "ids").mapInArrow(_list_digests, "node binary, ends_sha256 string")


ROLLED = "node binary, parent_conv_id long, n_leaves long, saved_tokens long"


def _rollup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths from their ends up to the root's children: what each owner's own nodes add to every node above, combined within the task.

    The root's least conversation comes with every row, as the parent's of the paths' first nodes.
    """
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    held: dict[bytes, list] = {}
    now, leaves, saved, below, skip = None, 0, 0, None, False

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(k, *v) for k, v in held.items()]
        for at in range(0, len(rows), 10_000):
            yield _batch(rows[at : at + 10_000], ROLLED, kinds)
        held.clear()

    for batch in batches:
        for conv, depth, node, least, members, chars, leaf, root in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if conv != now:
                now, leaves, saved, below, skip = conv, 0, 0, None, least != conv
            if skip:
                continue
            if below is not None:
                held[below][0] = least  # the parent of an owned node, met next on the way up
                below = None
            if least == conv:
                leaves, saved, below = leaves + leaf, saved + (members - 1) * chars, node
            own = held.setdefault(node, [None, 0, 0])
            own[1] += leaves
            own[2] += saved
            if depth == 1 and below is not None:
                own[0], below = root, None
        if len(held) > HELD and below is None:
            yield from flush()
    yield from flush()


def rollup(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, depth, least, members, chars, n_children) with parent_conv_id, n_leaves and saved_tokens.

    The root, which lies on every path, takes no part in the paths' join with the nodes: its sums are those over all nodes.
    """
    leaf = (F.col("n_children") == 0).cast("int")
    stats = nodes.select("node", "least", "members", leaf.alias("leaf"))
    root = nodes.where("depth = 0").select(F.col("least").alias("root"))
    steps = walked.where("depth > 0").select("conv_id", "depth", "node", "chars").join(stats, "node").join(F.broadcast(root))  # one row
    steps = steps.select("conv_id", "depth", "node", "least", "members", "chars", "leaf", "root").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("depth"))
    parts = steps.mapInArrow(_rollup, ROLLED).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    sums = [F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    whole = nodes.agg(F.max(F.lit(ROOT)).alias("node"), F.lit(None).cast("long").alias("parent_conv_id"), F.sum(leaf).alias("n_leaves"), F.sum((F.col("members") - 1) * F.col("chars")).alias("saved_tokens"))
    return nodes.join(parts.groupBy("node", "salt").agg(*sums).groupBy("node").agg(*sums).unionByName(whole), "node")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the conversations in ``turns`` (``own_turns`` or ``rebuilt_turns``).

    node (its name), conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    walked = paths(turns)
    tries = merged_tries(walked)
    nodes = tries.where("segment IS NULL").drop("segment", "ended")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").na.fill(0, ["n_children"]).drop("parent"), "trie-table")
    rolled = rollup(walked, nodes).join(list_digests(tries), "node", "left")
    return rolled.select(
        "node", F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
