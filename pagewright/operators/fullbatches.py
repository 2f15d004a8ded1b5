"""Batches of an exact size whose cut sections repeat their header."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_batches(df: DataFrame, keys: Sequence[str], page: str, header: str, limit: int) -> DataFrame:
    """keys, page, ``batch`` and ``place`` (both from 0) and ``repeated`` of each page, and of each repeated header.

    Every batch of a group but its last one has ``limit`` pages. A batch that begins within a section begins with a copy of
    the section's header, which takes a place and moves all later cuts; pages before the first header have none. ``page`` (a
    whole number) orders a group. Without a limit (0 or less) all is one batch; a limit of 1 that would need a copy is an
    error. The walk holds a few numbers a group, however large that is; a group is walked in one task.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{page}` long, batch long, place long, repeated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, used, last = None, -1, 0, None
        for rows in batches:
            out = []
            for *own, number, head in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                if now is None or own != now:
                    now, part, used, last = own, -1, 0, None
                if head:
                    last = number
                if part < 0 or 0 < limit <= used:
                    part, used = part + 1, 0
                    if last is not None and not head:
                        if limit == 1:
                            raise ValueError("batches of one page leave no room for a header's copy: take two at least")
                        out.append((*own, last, part, 0, True))
                        used = 1
                out.append((*own, number, part, used, False))
                used += 1
            types = [*(rows.schema.field(k).type for k in range(len(keys))), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[*keys, page, "batch", "place", "repeated"])

    rows = df.select(*keys, F.col(page).cast("long").alias(page), F.coalesce(F.col(header), F.lit(False)).alias("_head"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, page).mapInArrow(run, schema)
