"""A ledger of sends that is reserved before anything is sent, kept by a stream over arriving files.

Each row is an attempt to send a key, with its time and how it ended: ``ok``, ``rejected`` (surely nothing was sent) or
``unknown``. The first attempt of a key reserves it; attempts while it is reserved or sent are refused. ``ok`` makes the
reservation a send for good, ``rejected`` gives it back at once, and an unknown end holds it for a lease, after which a timer
gives it back. Attempts are taken in the order of their times and ids, once the watermark has passed them, so files may come
in any order and more than once: an attempt that waits is known by its id, and one from before the watermark is settled.
What happens to each attempt is appended to a journal (a file sink, written exactly once); the ledger is its fold.
Keys share their state and its timer by hash, as a call of Python for each key and batch costs more than its attempts; a
shard's attempts and reservations are packed Arrow tables. Each key is walked on its own all the same.

Defined cases: null keys are keys; attempts without a time or id are left out; ends other than the three count as unknown;
an attempt that arrives behind the watermark is left out; attempts after the last watermark wait for more input, which may be
a closing row: one with a late time and no id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "waiting binary, reserved binary, sent binary, settled long"
#: What a shard keeps: attempts that wait for the watermark, keys' reservations, and keys that are sent.
WAITING = pa.schema([("key", pa.string()), ("attempt", pa.int64()), ("time", pa.int64()), ("end", pa.string())])
RESERVED = pa.schema([("key", pa.string()), ("until", pa.int64()), ("holder", pa.int64())])
SENT = pa.schema([("key", pa.string())])
#: What a journal says of an attempt; ``expired`` is said of the one whose reservation's lease ended, at that time.
ACTIONS = ("sent", "rejected", "held", "refused", "expired")


def settle(pending: list[tuple[int, int, str]], held: tuple[int, int] | None, sent: bool, until: int, lease: int) -> tuple[list[tuple[int, int, str]], tuple[int, int] | None, bool]:
    """The journal (time, id, action) of attempts (time, id, end) before ``until``, and the reservation (end of its lease, id) after them. Times are microseconds."""
    said: list[tuple[int, int, str]] = []
    for at, key, end in sorted(pending):
        if held is not None and held[0] <= at:
            said.append((*held, "expired"))
            held = None
        if sent or held is not None:
            said.append((at, key, "refused"))
        elif end == "ok":
            sent = True
            said.append((at, key, "sent"))
        elif end == "rejected":
            said.append((at, key, "rejected"))
        else:
            held = at + lease, key
            said.append((at, key, "held"))
    if held is not None and held[0] < until:
        said.append((*held, "expired"))
        held = None
    return said, held, sent


def packed(columns: dict[str, Sequence], schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.table(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def unpacked(kept: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(kept)).read_all()


def walked(ready: pd.DataFrame, reserved: dict[str, tuple[int, int]], sent: set[str], until: int, lease: int) -> dict[str, list]:
    """The journal of a shard's attempts before ``until``, key by key; ``reserved`` and ``sent`` are brought up to then."""
    out: dict[str, list] = {"key": [], "at": [], "attempt": [], "action": []}
    rows = ready.sort_values("key", kind="stable")
    names = rows["key"].to_numpy()
    starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()] if len(rows) else []
    attempts = list(zip(rows["time"].tolist(), rows["attempt"].tolist(), rows["end"].tolist(), strict=True))
    mine = {names[i]: attempts[i:j] for i, j in zip(starts, [*starts[1:], len(rows)], strict=False)}
    for key in [*mine, *[k for k, (end, _) in reserved.items() if end < until and k not in mine]]:
        said, held, is_sent = settle(mine.get(key, []), reserved.pop(key, None), key in sent, until, lease)
        if held is not None:
            reserved[key] = held
        if is_sent:
            sent.add(key)
        for k, name in enumerate(("at", "attempt", "action")):
            out[name] += [x[k] for x in said]
        out["key"] += [key] * len(said)
    return out


def journal(attempts: DataFrame, keys: Sequence[str], at: str, attempt: str, end: str, late: str = "1 hour", lease_seconds: int = 3600, shards: int = 512) -> DataFrame:
    """The stream of journal rows: the keys, ``at``, ``attempt`` and ``action``. ``shards``: how many states the keys share."""
    kinds = dict(attempts.dtypes)  # ids are whole numbers
    schema = "key string, at timestamp, attempt long, action string"
    lease = lease_seconds * 1_000_000

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held, done, settled = state.get if state.exists else (packed({n: [] for n in WAITING.names}, WAITING), packed({n: [] for n in RESERVED.names}, RESERVED), packed({"key": []}, SENT), 0)
        kept = unpacked(held).to_pydict()
        reserved = dict(zip(kept["key"], zip(kept["until"], kept["holder"], strict=True), strict=True))
        sent = set(unpacked(done)["key"].to_pylist())
        parts = [unpacked(waiting).to_pandas()]
        for frame in frames:
            if len(frame):
                parts.append(frame.loc[frame["whole"] & (frame["time"] >= settled), WAITING.names])
        pending = pd.concat([p for p in parts if len(p)] or parts[:1]).drop_duplicates(["key", "attempt"])  # the first that came
        now = max(settled, state.getCurrentWatermarkMs() * 1000)
        out = walked(pending[pending["time"] < now], reserved, sent, now, lease)
        left = pending[pending["time"] >= now]
        held = {"key": list(reserved), "until": [v[0] for v in reserved.values()], "holder": [v[1] for v in reserved.values()]}
        state.update((packed({n: pa.Array.from_pandas(left[n], type=WAITING.field(n).type) for n in WAITING.names}, WAITING), packed(held, RESERVED), packed({"key": sorted(sent)}, SENT), now))
        wakes = ([int(left["time"].min())] if len(left) else []) + held["until"]
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes) // 1000, now // 1000) + 1)
        if out["key"]:
            yield pd.DataFrame(out | {"at": pd.to_datetime(out["at"], unit="us")})

    # rows without a time or id are told apart in the step: a filter would be moved below the watermark, which a closing row must move
    whole = F.col(attempt).isNotNull() & F.col(at).isNotNull()
    zero = F.lit(0).cast("long")
    # keys as one text, so that nulls stay keys and whole numbers exact on the way through pandas
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    key = F.to_json(F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)]), micros)
    rows = attempts.withWatermark(at, late).select(
        key.alias("key"), F.col(at).alias("at"), whole.alias("whole"), F.coalesce(F.unix_micros(at), zero).alias("time"), F.coalesce(F.col(attempt).cast("long"), zero).alias("attempt"), F.coalesce(end, F.lit("")).alias("end")
    ).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    said = rows.groupBy("shard").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    read = F.from_json("key", ", ".join(f"k{n} {kinds[k]}" for n, k in enumerate(keys)), micros)
    return said.withColumn("key", read).select(*[F.col(f"key.k{n}").alias(k) for n, k in enumerate(keys)], "at", "attempt", "action")


def archiving(spark: SparkSession, path: str, archive: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder; files that are read are moved to ``archive``, under their own paths."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return source.option("spark.sql.streaming.fileSource.cleaner.numThreads", "4").parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends a stream's rows to Parquet files until what has arrived is read; the files, read again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ledger(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fold of a journal: for each key the attempt that was sent, when, and how many attempts ended how."""
    count = lambda name: F.count_if(F.col("action") == name).alias(name)
    sent = F.col("action") == "sent"
    return rows.groupBy(*keys).agg(F.max(F.when(sent, F.col("attempt"))).alias("sender"), F.max(F.when(sent, F.col("at"))).alias("sent_at"), count("sent"), count("rejected"), count("held"), count("refused"), count("expired"))
