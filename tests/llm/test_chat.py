import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import chat, tokens
from tests.llm.conftest import SMALL

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|im_start|>", "<|im_sep", "a ", "é", "\n", " ", "日本", "s>", "\\n", "|>"]), max_size=12).map("".join)
ROWS = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escapes_are_reversible(text):
    got = chat.escape(text)
    assert chat.unescape(got) == text
    assert not any(c in got for c in chat.CONTROL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb\\n", "<|im_end|>"]), PIECES), max_size=6))
def test_masks_cover_the_assistant_exactly(turns):
    v = tokens.load(special=chat.MARKS)
    text, a, b = chat.render(turns)
    assert chat.parse(text) == turns
    ids = v.encode_marked(text)
    ends = v.ends(ids)
    assert v.decode(ids.tolist()) == text.encode()
    mask = chat.loss_mask(ends, a, b)
    assert chat.masked_texts(text.encode(), ends, mask) == [t for r, t in turns if r == "assistant" and t]
    spans = list(zip([0, *ends], ends, strict=False))
    assert mask.tolist() == [any(s < e2 and s2 < e for s2, e2 in zip(a, b, strict=True)) for s, e in spans]
    assert not any(m and k in v.special.values() for m, k in zip(mask.tolist(), ids.tolist(), strict=True))


def expected(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = {}
    for r in rows.orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: expected(v) for k, v in want.items()}


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "x"), (None, 1, "user", "hi"), (None, 1, "user", "hi"), (2, None, "assistant", "é" * 70_000), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS formatted", "2 AS token_ids", "3 AS alone")
    all_got = chat.digests(chat.format_conversations(df)).collect()
    got = {r.conv_id: r for r in all_got}
    assert len(all_got) == 4 and set(got) == {1, 2, None}
    assert [r.turns_sha256 for r in all_got if r.conv_id is None] == [expected([("user", "hi")])[1]] * 2
    assert (got[1].n_turns, got[1].turns_sha256) == expected([(None, "x"), ("assistant", None)])[:2]
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (3, 70_042, expected([("assistant", "é" * 70_000)] + [("assistant", rows[5][3])] * 2)[3])
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


def test_the_loss_digest_hangs_on_the_mask(spark):
    rows = spark.createDataFrame([(1, 1, "user", "What?"), (1, 2, "assistant", "So it is ok.")], ROWS)
    formatted = chat.format_conversations(rows)
    got = formatted.first()
    v = tokens.load(special=chat.MARKS)
    assert v.decode([k for k, m in zip(got.token_ids, got.loss_mask, strict=True) if m]) == b"So it is ok."
    whole = chat.digests(formatted).first()
    flips = [(k, got.formatted, got.token_ids, got.token_ends, [m != (i == k) for i, m in enumerate(got.loss_mask)]) for k in range(len(got.loss_mask))]
    changed = chat.digests(spark.createDataFrame(flips, chat.SCHEMA)).collect()
    assert len(changed) == len(flips) and all(r.loss_sha256 != whole.loss_sha256 for r in changed)


def test_malformed_bytes_are_replaced(spark):
    df = spark.sql("SELECT 1L AS conv_id, 0L AS turn, cast(unhex('FF') AS string) AS role, cast(unhex('61FF') AS string) AS text UNION ALL SELECT 1L, 1L, 'assistant', cast(unhex('C328') AS string)")
    got = chat.digests(chat.format_conversations(df)).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == expected([("�", "a�"), ("assistant", "�(")])
