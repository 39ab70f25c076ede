"""Encoding against the tiktoken library, and exact round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from quillon.llm import bpe  # noqa: E402

PATH = tokenizers.path("byte_bpe_50k.tiktoken")
ENC = bpe.encoder(PATH)
LIB = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})
SAMPLES = [
    "", " ", "  ", "\n", "a", "I'll we've they're 's 't ''s  's x's'sab 'lla 're", "Hello  world \n\n  x", "tab\t\tx  y　 z",
    "a" * 500, " " * 700 + "x", "\n" * 300, "日本語テキスト 123abc ½ Ⅷ", "é" * 90 + "!?.." * 60, "'" * 40 + "s", "\x00\x1c \x85", "🙂🙂 ok🙂",
]


def split(ids, at):
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_samples_equal_library():
    ids, _, at = ENC.encode(SAMPLES)
    assert split(ids, at) == [LIB.encode_ordinary(t) for t in SAMPLES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" '\n\tstrevmld.!1a é")), st.characters(codec="utf-8", categories=["L", "N", "P", "Zs", "Cc"])), max_size=60), max_size=6))
def test_random_equal_library(texts):
    ids, starts, at = ENC.encode(texts)
    assert split(ids, at) == [LIB.encode_ordinary(t) for t in texts]
    assert ENC.decode(ids) == "".join(texts).encode()


def test_long_rows_use_the_scan():
    text = ("It's  a we'll \n\n mix of 12 things... " * 3000) + "x" * 5000
    assert split(*ENC.encode([text, "b", text])[::2]) == [LIB.encode_ordinary(t) for t in (text, "b", text)]


def test_scan_equals_steps():
    rng = np.random.default_rng(1)
    for n in (1, 300, 20_000):
        c = rng.integers(0, 18, n).astype(np.uint8)
        want, s = [], bpe.EDGE
        for x in c:
            want.append(s)
            s = bpe.NEXT[x, s]
        assert (bpe.scan(c) == np.array(want)).all()


def test_rows(spark):
    texts = [None, "", "Hello world", "Hello world", "x" * 3000]
    docs = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.encode_digests(docs, PATH).collect()}
    assert len(rows) == 5 and rows[None].n_tokens == 0 and rows[2].ids_sha256 == rows[3].ids_sha256
    assert rows[4].decoded_sha256 == hashlib.sha256(b"x" * 3000).hexdigest()
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0
    encoded = bpe.encode_texts(docs, PATH)
    assert {(r.doc_id, r.text) for r in bpe.decode_ids(encoded, PATH).collect()} == {(i if i else None, t or "") for i, t in enumerate(texts)}
    assert encoded.filter("doc_id = 2").first().starts == [0, 5]
