"""Repair of conversation structure by shortest paths over small integer costs.

A conversation's rows and the states of the pattern ``(s?(ua)+)?`` (an optional system turn, then pairs of user and
assistant turns, or nothing) make a graph: an edit of a row leads over that row, an inserted turn leads to another state.
Costs are small integers, so distances to the end come from Dial's bucket queue; the repair is read off by walking tight
arcs from the start, the least letter first, which gives the cheapest edits and among them the ASCII-least audit. Rows are
one byte each by then (role and fault), and distances are held for ``BLOCK`` rows at a time: those at the blocks' ends are
kept and the blocks' own are found again on the walk. Texts stay in Spark; the second pass streams them past the audits.

Edits: K keeps a row, R gives it the role user or assistant, D deletes it, I inserts a turn of either role without a text.
Faults, the first that fits a row: blank (white space only), duplicate (role and text stand in an earlier row), truncated
(the last character that is no white space is none of ``.!?``). Blank rows and duplicates must be deleted; a truncated row
that stays costs 5 more.

Defined cases: a null role or text is one space; malformed bytes are replacement characters; rows go by turn, null first,
then by the MD5 of role and text; equal rows of one turn are duplicates; a null id is a conversation like another; a role
that starts with none of ``s``, ``u``, ``a`` (or is empty) can't be kept; rows marked as gone count for nothing, but their
conversation is returned; an empty table gives an empty result; other columns are not read. A conversation's rows pass
through one task, in a stream, as its audit and its digest are one sequence each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import written

#: ASCII white space, what may end a text, and the costs of edits.
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLOCK = 1 << 16
#: Cells of the bucket queue: more than an arc's largest cost and than the spread of the distances at a block's end.
BUCKETS = 32
#: States: nothing yet, after the system turn, after a user's, after an assistant's turn; the first and last may end.
STATES, ENDING, FAR = 4, (0, 3), 1 << 60
NEXT = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
#: A row's byte: three times its role's place here, plus 1 if truncated, 2 if it must go.
ROLES = ("u", "a", "s", "")
GONE = 255
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def _steps(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row: letter, cost, next state; the least letter first."""
    role, fault = ROLES[code // 3], code % 3
    extra = CUT if fault == 1 else 0
    out = []
    for s in range(STATES):
        ways = [("D", DELETE, s)]
        if fault < 2:
            ways += [("K", extra, NEXT[role][s])] if s in NEXT.get(role, {}) else []
            ways += [("R", REROLE + extra, NEXT[r][s]) for r in "ua" if s in NEXT[r]]
        out.append(ways)
    return out


STEPS = [_steps(code) for code in range(12)]
INSERTS = [next(NEXT[r][s] for r in "ua" if s in NEXT[r]) for s in range(STATES)]
#: The same arcs by where they lead: for each code and state, where from and at what cost.
BACK = [[[(p, cost) for p in range(STATES) for _, cost, t in steps[p] if t == s] for s in range(STATES)] for steps in STEPS]
BACK_INSERTS = [[p for p in range(STATES) if INSERTS[p] == s] for s in range(STATES)]


def distances(codes: bytes, at_end: list[int]) -> list[int]:
    """Costs to the end from each place of a block and state (four to a place), by Dial's bucket queue. ``at_end``: those at its end."""
    n = len(codes)
    dist = [FAR] * (STATES * (n + 1))
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    base = min(at_end)
    for s, d in enumerate(at_end):
        if d < base + BUCKETS - 8:  # a dearer state is reached for less through inserted turns
            dist[STATES * n + s] = d
            buckets[d % BUCKETS].append(STATES * n + s)
    d, left = base, sum(map(len, buckets))
    while left:
        cell = buckets[d % BUCKETS]
        while cell:
            node = cell.pop()
            left -= 1
            if dist[node] != d:
                continue  # reached for less meanwhile
            i, s = divmod(node, STATES)
            for p in BACK_INSERTS[s]:
                other = node - s + p
                if d + INSERT < dist[other]:
                    dist[other] = d + INSERT
                    buckets[(d + INSERT) % BUCKETS].append(other)
                    left += 1
            if i:
                for p, cost in BACK[codes[i - 1]][s]:
                    other = STATES * (i - 1) + p
                    if d + cost < dist[other]:
                        dist[other] = d + cost
                        buckets[(d + cost) % BUCKETS].append(other)
                        left += 1
        d += 1
    return dist


def cheapest(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The cost of the cheapest repair and the least audit of that cost."""
    cuts = list(range(0, len(codes), block)) or [0]
    ends = {len(cuts) - 1: [0 if s in ENDING else FAR for s in range(STATES)]}
    for k in range(len(cuts) - 1, 0, -1):
        ends[k - 1] = distances(codes[cuts[k] : cuts[k] + block], ends[k])[:STATES]
    audit, s, cost = [], 0, 0
    for k, at in enumerate(cuts):
        own = codes[at : at + block]
        dist = distances(own, ends.pop(k))
        cost = dist[0] if k == 0 else cost
        i, last = 0, k == len(cuts) - 1
        while i < len(own) or last and (dist[STATES * i + s] or s not in ENDING):
            here, ways = dist[STATES * i + s], STEPS[own[i]][s] if i < len(own) else []
            ways = sorted([(letter, c, i + 1, t) for letter, c, t in ways] + [("I", INSERT, i, INSERTS[s])])
            letter, _, i, s = next(w for w in ways if w[1] + dist[STATES * w[2] + w[3]] == here)
            audit.append(letter)
    return cost, "".join(audit)


def _text(name: str) -> Column:
    return F.make_valid_utf8(F.coalesce(F.col(name), F.lit(" ")))


def ordered(rows: DataFrame, gone: str | Column = "false") -> DataFrame:
    """conv_id, turn, mark (the MD5 that orders a turn's rows), gone, role and text of each row."""
    gone = F.expr(gone) if isinstance(gone, str) else gone
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), gone.alias("gone"), _text("role").alias("role"), _text("text").alias("text"))
    return rows.withColumn("mark", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))))


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now, state = [], None, None

    def close() -> None:
        codes, low, high, kinds, counts, illegal = state
        cost, audit = cheapest(bytes(codes))
        out.append((now[0], high - low + 1 - kinds if kinds else 0, *counts, illegal, cost, audit))

    size = 0
    for batch in batches:
        for conv, turn, code, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or (conv,) != now:
                if now is not None:
                    close()
                    size += len(out[-1][-1]) + 64
                now, state, role = (conv,), [bytearray(), None, None, 0, [0, 0, 0], 0], None
                if size > 1 << 22:
                    yield _batch(out, PLAN_KINDS)
                    out.clear()
                    size = 0
            if code == GONE:
                continue
            if turn is not None and turn != state[2]:
                state[1] = turn if state[1] is None else state[1]
                state[2] = turn
                state[3] += 1
            if fault:
                state[4][fault - 1] += 1
            pair = None if role is None else role + ROLES[code // 3]
            state[5] += pair is not None and pair not in ("su", "ua", "au")
            role = ROLES[code // 3]
            state[0].append(code)
    if now is not None:
        close()
    yield _batch(out, PLAN_KINDS)


PLAN_KINDS = [("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())]
TURN_KINDS = [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
DIGEST_KINDS = [*PLAN_KINDS, ("repaired_sha256", pa.string())]


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation, by ``PLAN``: its faults and its cheapest repair. ``rows``: from ``ordered``; texts aren't shuffled."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "u", 0).when(initial == "a", 3).when(initial == "s", 6).otherwise(9)
    narrow = rows.select("conv_id", "turn", "mark", "gone", role.alias("role"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(*ENDS)).alias("cut"))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "mark").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    dealt = narrow.repartition("conv_id").withColumn("again", again).withColumn("fault", fault)
    code = F.when(F.col("gone"), GONE).otherwise(F.col("role") + F.when(F.col("fault") == 3, 1).when(F.col("fault") > 0, 2).otherwise(0))
    return dealt.sortWithinPartitions("conv_id", "turn", "mark", "again").select("conv_id", "turn", code.alias("code"), "fault").mapInArrow(_plans, PLAN)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str, str | None, str | None]]:
    """Sorted rows of ``_met`` as events: each conversation's plan (first item), and then its turns (edit, role, text), deleted ones too."""
    plan, audit, at, s = None, "", 0, 0

    def inserted() -> Iterator[tuple[None, str, str, str]]:
        nonlocal at, s
        while at < len(audit) and audit[at] == "I":
            s = INSERTS[s]
            at += 1
            yield None, "I", "user" if s == 2 else "assistant", ""

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            conv, head, role, text, *counts, found = row
            if head:
                yield from inserted()
                plan, audit, at, s = (conv, *counts, found), found, 0, 0
                yield plan, "", None, None
                continue
            yield from inserted()
            letter = audit[at]
            at += 1
            if letter == "R":
                s = INSERTS[s]  # the role that the state takes
                role = "user" if s == 2 else "assistant"
            elif letter == "K":
                s = NEXT[role[0]][s]
            yield None, letter, role, text
    yield from inserted()


def _met(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows and plans side by side, each conversation's plan before its rows."""
    names = [n for n, _ in PLAN_KINDS[1:]]
    heads = planned.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *names)
    kinds = dict(planned.dtypes)
    lines = rows.where("NOT gone").select("conv_id", F.lit(False).alias("head"), "turn", "mark", "role", "text", *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    met = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "mark")
    return met.select("conv_id", "head", "role", "text", *names)


def repaired_turns(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations' turns by ``TURNS``: their place from 0, the edit that made them (K, R or I), role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, place, size = [], None, 0, 0
        for plan, letter, role, text in _edited(batches):
            if plan is not None:
                conv, place = plan[0], 0
            elif letter != "D":
                out.append((conv, place, letter, role, text))
                place, size = place + 1, size + len(text)
                if size > 1 << 22 or len(out) >= 10_000:
                    yield _batch(out, TURN_KINDS)
                    out, size = [], 0
        yield _batch(out, TURN_KINDS)

    return _met(rows, planned).mapInArrow(run, TURNS)


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The plans with ``repaired_sha256``: that of the repaired turns as ``role:text``, joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, sha, first = [], None, hashlib.sha256(), True
        for plan, letter, role, text in _edited(batches):
            if plan is not None:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                    if len(out) >= 10_000:
                        yield _batch(out, DIGEST_KINDS)
                        out = []
                now, sha, first = plan, hashlib.sha256(), True
            elif letter != "D":
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if now is not None:
            out.append((*now, sha.hexdigest()))
        yield _batch(out, DIGEST_KINDS)

    return _met(rows, planned).mapInArrow(run, f"{PLAN}, repaired_sha256 string")


def plan_repairs(rows: DataFrame) -> DataFrame:
    """``plans`` of ``ordered`` rows, written to the shared folder: they are met by the rows again."""
    return written(plans(rows), "repair-plans")
