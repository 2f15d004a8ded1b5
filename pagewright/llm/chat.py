"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered once as a whole, encoded once, and its mask found by intersecting the sorted spans of the
assistant's texts with the sorted spans of the tokens by binary search. The template's marks are special tokens, so that no
token reaches over the end of a turn: the masked tokens are the assistants' texts and nothing else. Control strings inside
texts and roles get a backslash after their first character, however many stand there already, and lose one when read back,
so no text can hold a mark. Spans and offsets count UTF-8 bytes. The digests are rebuilt from the token ids, the offsets and
the mask alone.

Defined cases: null texts and roles are empty; replacement characters stand for bytes that are no UTF-8; rows of one conversation go by turn (null first), then role and text;
repeated rows are turns of their own; a row with a null id is a conversation of its own; an empty table gives an empty
result; other columns are not read. A conversation is one group of one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import tokens
from pagewright.llm.shared import valid

START, SAID, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = (START, SAID, END)
#: The strings that steer chat models.
CONTROL = (*MARKS, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PLAIN = re.compile("|".join(rf"({re.escape(c[0])}\\*)(?={re.escape(c[1:])})" for c in CONTROL))
_MARKED = re.compile("|".join(rf"({re.escape(c[0])}\\*)\\(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile("(.*?)".join([*map(re.escape, MARKS)]), re.DOTALL)
SCHEMA = "conv_id long, formatted string, token_ids array<int>, token_ends array<int>, loss_mask array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][:-1], text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, np.ndarray, np.ndarray]:
    """The formatted conversation, and starts and ends in bytes of the texts that bear loss."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SAID, escape(text)
        at += len(head.encode())
        size = len(body.encode())
        if role == loss_role and body:
            starts.append(at)
            ends.append(at + size)
        parts += (head, body, END)
        at += size + len(END)
    return "".join(parts), np.array(starts, np.int64), np.array(ends, np.int64)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def loss_mask(ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Which tokens bear loss. ``ends``: where the tokens end; they meet, the first at 0. Spans are sorted and apart."""
    mask = np.zeros(len(ends), bool)
    if len(span_ends) and len(ends):
        starts = np.append(0, ends[:-1])
        k = np.searchsorted(span_ends, starts, "right")
        mask = (k < len(span_ends)) & (span_starts[np.minimum(k, len(span_ends) - 1)] < ends)
    return mask


def masked_texts(formatted: bytes, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, one for each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    at = np.append(0, ends)
    return [unescape(formatted[a:b].decode("utf-8", "replace")) for a, b in zip(at[edge[::2]].tolist(), at[edge[1::2]].tolist(), strict=True)]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Sorted rows as conversations."""
    now, turns = None, []
    for batch in batches:
        for conv, alone, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (conv, alone) != now and turns:
                yield now[0], turns
                turns = []
            now = conv, alone
            turns.append((role, text))
    if turns:
        yield now[0], turns


def format_conversations(rows: DataFrame, vocabulary: str = tokens.VOCABULARY, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation, by ``SCHEMA``: the text, its tokens, where they end, and their mask."""
    get = tokens.shipped(rows.sparkSession, vocabulary, MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out, size = get(), [], 0
        for conv, turns in _conversations(batches):
            text, a, b = render(turns, loss_role)
            ids = v.encode_marked(text)
            ends = v.ends(ids)
            out.append((conv, text, ids, ends, loss_mask(ends, a, b)))
            size += len(text)
            if size > 1 << 22:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    names = ["conv_id", "formatted", "token_ids", "token_ends", "loss_mask"]
    _batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), valid("role").alias("role"), valid("text").alias("text"), "turn")
    turns = turns.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    return turns.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "role", "text").select("conv_id", "alone", "role", "text").mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """What can be read back from each conversation's tokens and mask, by ``DIGESTS``."""
    get = tokens.shipped(formatted.sparkSession, vocabulary, MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = get()
        for batch in batches:
            out = []
            lists = [c.values.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            cuts = [c.offsets.to_numpy() for c in batch.columns[1:]]
            for k, conv in enumerate(batch.column(0).to_pylist()):
                ids, ends, mask = (x[at[k] : at[k + 1]] for x, at in zip(lists, cuts, strict=True))
                data = v.decode(ids.tolist())
                text = data.decode("utf-8", "replace")
                turns = parse(text)
                loss = "".join(masked_texts(data, ends, mask))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "token_ids", "token_ends", "loss_mask").mapInArrow(run, DIGESTS)
