import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import tokens

PATH = tokens.vocabulary_path("byte_bpe_50k")
REF = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(PATH), special_tokens={})
ENC = tokens.encoder(PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    assert ENC.ids(t) == REF.encode_ordinary(t)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab e'é²½\n\t\x1c\xa0_1<|>中😀́", max_size=40))
def test_white_space_and_signs(t):
    assert ENC.ids(t) == REF.encode_ordinary(t)


@pytest.mark.parametrize("t", ["<|endoftext|>", "a" * 3000, " " * 700, "é" * 500, "don 't", "l'eau  de\n\n pluie ", "".join(random.Random(3).choices("abcdefgh", k=5000))])
def test_long_and_special(t):
    assert ENC.ids(t) == REF.encode_ordinary(t)


def test_both_merges_agree():
    r = random.Random(4)
    for _ in range(300):
        w = bytes(r.choices(b"the in\xc3\xa9q", k=r.randint(1, 80)))
        assert tokens.merge_scan(w, ENC.words.rank) == tokens.merge_heap(w, ENC.words.rank)


def test_pool_is_bounded():
    e = tokens.Encoder(PATH)
    e.POOL = 50
    for k in range(40):
        t = f"mot{k} et {k * 77} autres  ici"
        assert e.ids(t) == REF.encode_ordinary(t)
    assert len(e.pool) < 200


def test_operator(spark):
    texts = ["le mil", "", None, "le mil", " ", "x" * 20_000]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "text", ["doc_id"]).collect()}
    assert got == {k: REF.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    n = {r.doc_id: r.jetons for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.where("false"), "text", ["doc_id"]).count() == 0
