import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import chat_format
from pagemill.llm.byte_bpe import codec

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = st.lists(st.sampled_from(["\\", "#", "##", "### ", "</turn>", "\n", "</turn>\n", ":\n", " ", "x", "é", "\U0001f600", "assistant", "\t", "."]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_formatted_text_reads_back(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans.tolist()] == [t for _, t in turns]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), PIECES), max_size=5))
def test_mask_covers_the_learned_texts_and_nothing_else(turns):
    formatted, spans = chat_format.render(turns)
    tool = codec(*VOCABULARY)
    ids = tool.encode([formatted])[0]
    assert b"".join(tool.encode([chat_format.render([t])[0] for t in turns])) == ids  # parts encode as the whole does
    starts, ends = (np.frombuffer(p, dtype="<u4").astype(np.int64) for p in tool.offsets(formatted, ids))
    learned = spans[[r == "assistant" for r, _ in turns]] if turns else spans
    under, low, high = chat_format.token_mask(starts, ends, learned)
    want = [any(a < y and x < b for x, y in learned.tolist() if x < y) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert under.tolist() == want
    assert chat_format.unescape(chat_format.masked_text(formatted, low, high)) == "".join(t for r, t in turns if r == "assistant")


def test_broken_text_and_tokens_over_two_turns():
    with pytest.raises(ValueError):
        chat_format.parse("### user:\nno end")
    with pytest.raises(ValueError):
        chat_format.token_mask(np.array([0]), np.array([9]), np.array([[1, 3], [5, 7]]))


def test_long_conversations_are_cut_between_turns(spark):
    """One conversation over many stretches, one of long texts; parts in order give the whole."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}\n") for i in range(9_000)]
    rows += [(2, i, "assistant", "long text " * 60_000) for i in range(4)] + [(3, 0, "user", None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, wide string")
    parts = chat_format.format_chats(table, *VOCABULARY)
    places = {(r.conv_id, r.stretch, r.part) for r in parts.select("conv_id", "stretch", "part").collect()}
    assert {s for c, s, _ in places if c == 1} == {0, 1, 2} and len([p for p in places if p[0] == 2]) > 1
    got = {r.conv_id: r for r in chat_format.read_back(table, *VOCABULARY).collect()}
    for conv in (1, 2, 3):
        turns = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len(chat_format.render(turns)[0])


def test_parts_hold_ids_mask_and_places(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", " there.")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(table, *VOCABULARY, learned=("bot",)).first()
    tool = codec(*VOCABULARY)
    assert row.ids == tool.encode([row.formatted])[0] and len(row.mask) == len(row.ids) // 4
    assert [row.formatted[t.start : t.end] for t in row.turns] == ["hi", " there."]
    assert sum(row.mask) == len(row.loss_starts) // 4 > 0
