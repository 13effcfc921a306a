"""Single texts of a megabyte, longer than the pieces that texts are taken in."""

import random

import pytest

from pagewright.llm import common as C
from pagewright.llm import decontam, near, suffixes

N = 150_000


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(20_000)]
    return [r.choice(vocabulary) for _ in range(N)]


@pytest.fixture(scope="module")
def docs(spark, words):
    base = " ".join(words)
    assert len(base) > 1.9 * C.PIECE
    return spark.createDataFrame([(1, base), (2, base + " end"), (3, None), (4, "short text")], "doc_id long, text string").repartition(2)


def test_near_duplicates(docs, words):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(docs, 4, 85).collect()}
    n = len({tuple(words[i : i + 4]) for i in range(N - 3)})
    assert got == {1: (n, 1), 2: (n + 1, 1), 3: (0, 3), 4: (1, 4)}


def test_repeated_passages(docs):
    assert [tuple(r) for r in suffixes.repeated_spans(docs).collect()] == [(2, 1, 0, N)]
    left = {r.doc_id: r.text for r in suffixes.remove_repeats(docs).collect()}
    assert left[2] == "end" and len(left[1].split()) == N


def test_decontamination(spark, docs, words):
    item = words[100_000:100_030]
    item[7] = "other"
    found = decontam.contaminated(docs, spark.createDataFrame([(9, " ".join(item)), (8, "nothing of the kind")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_words, r.n_equal, r.doc_start, r.item_start) for r in found) == [(1, 9, 30, 29, 100_000, 0), (2, 9, 30, 29, 100_000, 0)]
