import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import byte_bpe
from pagemill.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_query_is_the_other_library(spark, sf, plain):
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc in docs:
        want = np.array(plain.encode_ordinary(doc.text or ""), dtype="<u4")
        row = got[doc.doc_id]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=" \n\t'as!1é\u00a0\x1c中", max_size=30))
def test_any_text(text):
    tool = byte_bpe.codec(RANKS, PATTERN)
    other = tool.whole or tool._encode_whole("") is None or tool.whole
    packed = tool.encode([text])[0]
    assert ids_of(packed) == tool.whole.encode_ordinary(text), other
    assert byte_bpe.decoded(packed, byte_bpe.token_table(RANKS)) == text.encode()
    starts, ends = map(ids_of, tool.offsets(text, packed))
    at = 0
    for token, start, end in zip(ids_of(packed), starts, ends, strict=True):
        piece = tool.token_bytes[token]
        assert piece in text[start:end].encode()
        assert len(text[:start].encode()) <= at
        at += len(piece)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "né 中\U0001f600", None), (2, "a\U00018da7a <|endoftext|>", "z"), (2, "a" * 70_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.encode(docs, RANKS, PATTERN, with_offsets=True)
    back = byte_bpe.decode(out, RANKS).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS).collect() == []
