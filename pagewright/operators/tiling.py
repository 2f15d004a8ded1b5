"""Which manifests, one after the other, make up a sequence: windows and manifests meet by polynomial hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two primes below 2^31, each with a base: sums of up to 2^32 terms fit a long, and a chance match is one in 2^61.
HASHES = ((2147483647, 1000003), (2147483629, 998244353))


def power(base: int, exponent: Column, prime: int) -> Column:
    """``base`` to a power below 2^31, modulo ``prime``, by squares."""
    squares, x = [], base % prime
    for _ in range(31):
        squares.append(x)
        x = x * x % prime
    table = F.array(*[F.lit(s).cast("long") for s in squares])
    bit = lambda k: F.getbit(exponent.cast("long"), k) == 1
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(1).cast("long"), lambda acc, k: F.when(bit(k), acc * F.get(table, k) % prime).otherwise(acc))


def _terms(token: Column, place: Column) -> list[Column]:
    return [(F.pmod(F.xxhash64(F.lit(k), token), F.lit(p)) * power(b, place, p) % p).alias(f"_t{k}") for k, (p, b) in enumerate(HASHES)]


def hits(sequences: DataFrame, manifests: DataFrame, batch: str, place: str, token: str, manifest: str) -> DataFrame:
    """batch, start, length and manifest wherever a whole manifest stands in a sequence of its batch.

    ``sequences``: batch, place (0, 1, ...), token; ``manifests``: batch, manifest, place, token. Null tokens equal nothing.
    Windows of the batch's manifests' lengths are cut from prefix sums, shifted back to place 0 and met by equality; every
    meeting is then compared token by token.
    """
    own = Window.partitionBy(batch).orderBy("start")
    sums = sequences.select(batch, F.col(place).cast("long").alias("start"), *_terms(F.coalesce(F.col(token).cast("string"), F.lit("\0")), F.col(place)))
    sums = sums.withColumns({f"_s{k}": F.coalesce(F.sum(f"_t{k}").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k in range(2)})
    ends = sequences.groupBy(batch).agg(F.count("*").alias("start"), *[F.sum(t).alias(f"_s{k}") for k, t in enumerate(_terms(F.coalesce(F.col(token).cast("string"), F.lit("\0")), F.col(place)))])
    prefix = sums.select(batch, "start", "_s0", "_s1").unionByName(ends)
    whole = manifests.groupBy(batch, manifest).agg(F.count("*").alias("length"), F.count(token).alias("_read"), *[(F.sum(t) % p).alias(f"_m{k}") for (k, (p, _)), t in zip(enumerate(HASHES), _terms(F.col(token).cast("string"), F.col(place)), strict=True)])
    whole = whole.where("length = _read").drop("_read")
    windows = prefix.join(whole.select(batch, "length").distinct(), batch).withColumn("_end", F.col("start") + F.col("length"))
    right = prefix.select(batch, F.col("start").alias("_end"), F.col("_s0").alias("_e0"), F.col("_s1").alias("_e1"))
    shifted = [(F.pmod(F.col(f"_e{k}") - F.col(f"_s{k}"), F.lit(p)) * power(pow(b, -1, p), F.col("start"), p) % p).alias(f"_m{k}") for k, (p, b) in enumerate(HASHES)]
    met = windows.join(right, [batch, "_end"]).select(batch, "start", "length", *shifted).join(whole, [batch, "length", "_m0", "_m1"]).select(batch, "start", "length", manifest)
    # every meeting, token by token
    steps = met.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("_k", "_step")).withColumn("_at", F.col("start") + F.col("_step"))
    steps = steps.join(sequences.select(batch, F.col(place).cast("long").alias("_at"), F.col(token).alias("_a")), [batch, "_at"])
    steps = steps.join(manifests.select(batch, manifest, F.col(place).cast("long").alias("_step"), F.col(token).alias("_b")), [batch, manifest, "_step"])
    return steps.groupBy(batch, "start", "length", manifest).agg(F.count_if(F.col("_a") == F.col("_b")).alias("_same")).where("_same = length").drop("_same")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits by batch and start: those on the chain that has one unused manifest at each step, or -1 where that fails."""
    now, at, used, waiting, out = None, 0, set(), [], []

    def step() -> None:
        nonlocal at, waiting
        if waiting:
            free = [w for w in waiting if w[2] not in used]
            if len(free) == 1:
                start, length, manifest = free[0]
                used.add(manifest)
                out.append((now[0], start, length, manifest))
                at += length
            else:
                at = -1
            waiting = []

    for batch in batches:
        for group, start, length, manifest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or (group,) != now:
                if now is not None:
                    step()
                now, at, used, waiting = (group,), 0, set(), []
            if waiting and waiting[0][0] != start:
                step()
            if start == at:
                waiting.append((start, length, manifest))
    if now is not None:
        step()
    kinds = batch.schema if now is not None else None
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds.field(k).type) for k in range(4)], names=kinds.names)


def tiled(sequences: DataFrame, manifests: DataFrame, batch: str, place: str, token: str, manifest: str, least: int = 2) -> DataFrame:
    """batch, start, length and manifest of the manifests that make up a batch's sequence, one fitting at each step, ``least`` at least.

    A manifest is used once. Sequences with no such chain to their very end give nothing. A batch's hits are walked in one task.
    """
    found = hits(sequences, manifests, batch, place, token, manifest).select(batch, "start", "length", manifest)
    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    chain = found.repartition(batch).sortWithinPartitions(batch, "start", manifest).mapInArrow(_chain, schema)
    ends = chain.groupBy(batch).agg(F.sum("length").alias("_covered"), F.count("*").alias("_parts")).where(F.col("_parts") >= least)
    whole = ends.join(sequences.groupBy(batch).agg(F.count("*").alias("_rows")), batch).where("_covered = _rows").select(batch)
    return chain.join(whole, batch, "left_semi")
