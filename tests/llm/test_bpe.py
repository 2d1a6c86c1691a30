import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridseries.llm import bpe, queries

from helpers import ODD, SF001, no_docs, odd_docs, rows_of

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def kernel():
    return bpe.load(PATH, P.PATTERN)


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_query_equals_library(spark, library):
    want = {r["doc_id"]: r["text"] or "" for r in rows_of(SF001, "documents")}
    got = queries.op4_byte_bpe(spark, SF001).collect()
    assert len(got) == len(want)
    for r in got:
        ids = library.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(ids))
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, library):
    got = bpe.encode(spark, odd_docs(spark), PATH, P.PATTERN).collect()
    want = sorted((str(i), digest(library.encode_ordinary(t or ""))) for i, t, _, _ in ODD)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in got) == want
    assert bpe.encode(spark, no_docs(spark), PATH, P.PATTERN).count() == 0


def test_decode_column(spark):
    enc = bpe.encode(spark, odd_docs(spark), PATH, P.PATTERN)
    back = bpe.decode(spark, enc, PATH, P.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((t or "").encode() for _, t, _, _ in ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85 'sdtlv.,!aZé1٣中"), st.characters(exclude_categories=["Cs"])), max_size=30)))
def test_any_text(kernel, library, texts):
    ids, counts = kernel.encode(texts)
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == library.encode_ordinary(t)
        at += n
    assert kernel.decode(ids, counts) == [t.encode() for t in texts]


def test_long_match(kernel, library):
    for t in ("a" * 5000, "é" * 700, " " * 3000, "ab" * 2000 + "."):
        ids, _ = kernel.encode([t])
        assert ids.tolist() == library.encode_ordinary(t)
