import unicodedata

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridseries.llm import queries
from gridseries.llm import token_counts as C

from helpers import ODD, SF001, no_docs, odd_docs, rows_of

PATH = P.path("word_bpe_49k.json")
ALPHABET = st.one_of(st.sampled_from("abcdehilnorstvéß'., 1#\n\x1c\x85"), st.characters(exclude_categories=["Cs", "Cn"]))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return C.load(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_query_equals_library(spark, library):
    want = {r["doc_id"]: r["text"] or "" for r in rows_of(SF001, "documents")}
    got = queries.op6_token_counts(spark, SF001).collect()
    assert len(got) == len(want)
    for r in got:
        n = count(library, want[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 2048)


def test_odd_rows(spark, library):
    got = C.token_counts(spark, odd_docs(spark), PATH, with_prefixes=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), count(library, t or "")) for i, t, _, _ in ODD)
    assert all((r.prefix_tokens[-1] if r.prefix_tokens else 0) == r.n_tokens for r in got)
    assert C.token_counts(spark, no_docs(spark), PATH).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=24), max_size=4))
def test_any_text(counter, library, texts):
    prefix, size = counter.prefixes(texts)
    at = 0
    for t, n in zip(texts, size):
        assert (prefix[at + n - 1] if n else 0) == count(library, t)
        at += n


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehilnorstuvwyé'., 12!"), max_size=40))
def test_every_prefix(counter, library, text):
    prefix, _ = counter.prefixes([text])
    text = unicodedata.normalize("NFC", text).lower()
    for i in range(len(text) + 1):
        n = len("".join(counter.words(text[:i])))
        assert (prefix[n - 1] if n else 0) == count(library, text[:i])


def test_special_strings(counter, library):
    for t in ("a<|endoftext|>b", "<|startoftext|><|endoftext|> x <|endoftext|", "don't <|ENDOFTEXT|>", "'re 'r 've're"):
        prefix, _ = counter.prefixes([t])
        assert prefix[-1] == count(library, t)


def test_budget_without_encoding_again(counter, library):
    text = "the quick brown fox jumps over the lazy dog " * 30
    prefix, _ = counter.prefixes([text])
    for budget in (0, 1, 7, 100, 269, 270, 1000):
        n = C.fitting(prefix, budget)
        assert n == 0 or prefix[n - 1] <= budget
        assert n == len(prefix) or prefix[n] > budget
