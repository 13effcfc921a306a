import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import tokens

PATH = tokens.default_path()
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.counter(PATH)
ODD = st.lists(st.sampled_from(list("aé ß\n\t'sltvemrd01.,!  日本<|>🙂") + ["<|endoftext|>", "the", " and", "'re"]), max_size=30).map("".join)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_counts_as_the_library(text):
    assert COUNTER.count(text) == library(text)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_every_prefix(text):
    assert COUNTER.prefixes(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)]


def test_long_pieces():
    for text in ("a" * 5000, "ab1" * 3000, " " * 3000 + "x", "é" * 2000, "$" * 999):
        assert COUNTER.count(text) == library(text)


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (1, "hello world", 9), (2, None, 1), (None, "", None), (3, "x" * 3000, 2)], "doc_id long, text string, n_tokens int")
    got = sorted(tokens.count_tokens(df).collect(), key=str)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((t or "")), library(t or ""), library(t or "") > 512) for t in ("hello world", "hello world", None, "", "x" * 3000))
    assert tokens.count_tokens(df.limit(0)).count() == 0
    table = tokens.with_prefix_counts(df.where("doc_id = 1").limit(1))
    fit = tokens.fit_budget(table, 1).first().n_chars
    assert library("hello world"[:fit]) <= 1 and library("hello world"[: fit + 1]) > 1
    assert tokens.fit_budget(table, 0).first().n_chars == 0
    assert isinstance(COUNTER.prefixes("ab"), np.ndarray)


@pytest.mark.parametrize("n", [0, 1])
def test_small(n):
    assert COUNTER.count("a" * n) == n
