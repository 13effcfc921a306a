import random

import pyarrow as pa
import pytest
from oracle import of_spark, rows

from pagewright.llm import suffixes

SF = "/root/testdata/sf0.001"


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("ijkl")
    shared = [[word() for _ in range(r.randrange(8, 30))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += r.choice(shared) if r.random() < 0.5 else [word() for _ in range(r.randrange(1, 25))]
        out.append(r.choice([" ", "\n", "  "]).join(w))
    return out


def brute(texts, length):
    """doc -> words that lie in a stretch which an earlier document holds."""
    first, words = {}, [t.split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = {}
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            f = first[tuple(w[i : i + length])]
            if f != d:
                out.setdefault((d, f), set()).update(range(i, i + length))
    return out


@pytest.mark.parametrize("seed,length", [(1, 10), (2, 7), (3, 12)])
def test_against_brute_force(spark, seed, length):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, at int, id string").repartition(3)
    got = {}
    for r in suffixes.repeated_spans(df, length).collect():
        got.setdefault((r.doc_id, r.first), set()).update(range(r.start, r.end))
    want = brute(texts, length)
    # stretches that overlap or touch are joined over the words between them
    assert set(got) == set(want) and all(got[k] >= want[k] for k in want)
    assert all(len(got[k] - want[k]) == 0 for k in want)
    drop = {}
    for (d, _), at in want.items():
        drop.setdefault(d, set()).update(at)
    left = {r.doc_id: r.text.split() for r in suffixes.remove_repeats(df, length).collect()}
    for d, t in enumerate(texts):
        w = [x for i, x in enumerate(t.split()) if i not in drop.get(d, ())]
        assert left.get(d) == w if w or not drop.get(d) else d not in left


def test_matches_sql(spark):
    assert of_spark(suffixes.op5_repeated_passages(spark, SF)) == rows(suffixes.OP5_SQL, SF)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, "é " + long + " z", 1), (3, None, 1), (4, "", 1), (None, long, 1), (5, long, 1)], "doc_id long, text string, n_chars int")
    assert {(r.doc_id, r.first, r.start, r.end) for r in suffixes.repeated_spans(df).collect()} == {(2, 1, 1, 61), (5, 1, 0, 60)}
    out = [(r.doc_id, r.text, r.n_chars) for r in suffixes.remove_repeats(df).collect()]
    assert (2, "é z", 3) in out and len(out) == 6 and not any(r[0] == 5 for r in out)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, 1, 2, 3, 4), (2, "a " + long, 1, 2, 3, 4)], "doc_id int, text string, _id int, _cuts int, start int, first int")
    out = suffixes.remove_repeats(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, long, 1, 2, 3, 4), (2, "a", 1, 2, 3, 4)]


def test_neighbours_over_batches():
    r = random.Random(4)
    rows = sorted((r.choice([1, 1, 2, 3, 4, 5]), r.randrange(4), r.randrange(50)) for _ in range(60)) + [(9, 1, 1), (9, 1, 2), (10, 1, 1)]
    docs = {h: {d for g, d, _ in rows if g == h} for h, _, _ in rows}
    known = [h == 10 for h, _, _ in rows]
    want = [(d, at) for h, d, at in rows if len(docs[h]) > 1 or h == 10]
    table = pa.table({"suffix": [x[0] for x in rows], "id": [x[1] for x in rows], "at": [x[2] for x in rows], "matched": known})
    for size in (1, 2, 7, 100):
        got = [tuple(x.values()) for b in suffixes.neighbours(table.to_batches(max_chunksize=size)) for x in b.to_pylist()]
        assert got == want
