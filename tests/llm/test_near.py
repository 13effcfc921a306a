import random
import re

import numpy as np
import pytest
from oracle import of_spark, rows

from pagewright.llm import graph, near

SF = "/root/testdata/sf0.001"


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    at = list(range(len(texts)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstuv")
    common = [word() for _ in range(30)]
    out = [None, "", " \n", "a", "A", "b c", "B C", "b c d"]
    for _ in range(14):
        base = [word() for _ in range(r.choice([3, 8, 40, 120]))] + (common if r.random() < 0.5 else [])
        for _ in range(r.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,k,percent,most", [(1, 4, 85, 16), (2, 5, 80, 3), (3, 3, 60, 16), (4, 2, 70, 1)])
def test_against_brute_force(spark, monkeypatch, seed, k, percent, most):
    monkeypatch.setattr(near, "UNIT", 2000)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, cls int, n int, tok int").repartition(3)
    got = sorted(map(tuple, near.near_groups(df, k, percent, most=most).collect()))
    assert got == brute(texts, k, percent)


def test_longer_prefixes_leave_fewer_pairs_to_verify(spark, monkeypatch):
    """Texts that share one passage but don't link: with l chosen by cost fewer pairs are verified than with l = 1, and the groups are the same."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(90)]
    texts = [" ".join(passage[i % 7 : 80 + i % 9] + [word() for _ in range(r.randrange(3, 25))]) for i in range(60)] + [" ".join(word() for _ in range(50)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    pairs, links = [], near.verified

    def verified(p, held, percent):
        pairs[-1] += p.count()
        return links(p, held, percent)

    monkeypatch.setattr(near, "verified", verified)
    for most in (1, 16):
        pairs.append(0)
        assert sorted(map(tuple, near.near_groups(df, 4, 85, most=most).collect())) == brute(texts, 4, 85)
    assert 0 < pairs[1] < pairs[0] < 60 * 59 / 20


def test_matches_sql(spark):
    assert of_spark(near.op1_near_duplicates(spark, SF)) == rows(near.OP1_SQL, SF)


def test_odd_rows(spark):
    df = spark.createDataFrame([(7, "x y z w v"), (7, "x y z w v"), (None, "x y z w v"), (3, "x y z w v"), (None, None), (9, "q")], "doc_id long, text string")
    got = sorted(map(tuple, near.near_groups(df).collect()), key=repr)
    assert got == sorted([(7, 1, 3), (7, 1, 3), (None, 1, 3), (3, 1, 3), (None, 0, None), (9, 1, 9)], key=repr)
    assert near.near_groups(df.limit(0)).count() == 0
    assert sorted(map(str, near.keep_one(df).select("doc_id").toPandas().doc_id)) == ["3.0", "9.0", "nan", "nan"]


def test_components(spark):
    r = random.Random(5)
    e = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(e, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(61))
    assert all(got[a] == got[b] for a, b in e if a != b)
    assert len(set(got.values())) == len({min(x for x in got if got[x] == v) for v in set(got.values())})


def test_prefixes():
    token = np.arange(20, dtype=np.uint64) << np.uint64(40)
    cold = np.zeros(1 << near.SKETCH_BITS, np.int64)
    l, kept, row, place = near.prefixes(np.array([10, 10]), token, 85, cold, 16)
    assert place.tolist() == [0, 1, 0, 1]
    assert l.tolist() == [1, 1] and kept.tolist() == [*token[:2], *token[10:12]] and row.tolist() == [0, 0, 1, 1]
    hot = cold.copy()
    hot[(token[:10] >> np.uint64(48 - near.SKETCH_BITS)).astype(int)] = 1000
    l, kept, row, _ = near.prefixes(np.array([10, 10]), token, 85, hot, 16)
    assert l[0] > 1 and l[1] == 1 and (row == 0).sum() == 1 + l[0]
    assert near.prefixes(np.array([10]), token[:10], 85, hot, 16)[0][0] <= 9


@pytest.mark.parametrize("percent", [50, 60])
def test_short_texts_at_low_thresholds(spark, percent):
    texts = ["a b c d", "a b c d e", "a b c", "f g h i j k", "f g h i", "l m", "l m n", "o p q r", "o p q s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, near.near_groups(df, 1, percent).collect())) == brute(texts, 1, percent)
    assert sorted(map(tuple, near.near_groups(df, 2, percent).collect())) == brute(texts, 2, percent)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 0, 0, 0), (2, "a b c d e f", 0, 0, 0), (3, "z", 0, 0, 0)], "doc_id int, text string, _gone int, component_id int, label int")
    out = near.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_signatures_bound_the_overlap():
    """Never below what two sets share, and close to it, also between sets of very different sizes."""
    r = np.random.default_rng(3)
    for n, m, common in ((1, 1, 0), (1, 1, 1), (5, 900, 4), (700, 700, 100), (700, 650, 600), (3000, 40, 0)):
        shared = r.integers(0, 1 << 48, common, np.uint64)
        a = np.unique(np.concatenate([shared, r.integers(0, 1 << 48, n - common, np.uint64)]))
        b = np.unique(np.concatenate([shared, r.integers(0, 1 << 48, m - common, np.uint64)]))
        bound = near.at_most(near.signature(a), near.signature(b), n, m)
        assert common <= bound <= min(n, m) and (abs(n - m) > 100 or bound <= common + 0.5 * (n - common) + 3)
        assert bound == near.at_most(near.signature(b), near.signature(a), m, n)


def test_what_a_prefix_token_moves_does_not_grow_with_the_partitions(spark):
    """More partitions hold fewer tokens of one text each; a row's share of the shuffle stays as it is, so the shuffle grows as the input."""
    r = random.Random(5)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(300)) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:200])], "doc_id long, text string").repartition(2)
    held = near.C.written(near.shingled(df, 4, "doc_id", "text", True), "sets")
    sc, moved = spark.sparkContext, []
    for partitions in (4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            sc.setJobGroup(group := f"prefixes {partitions}", "")
            near.prefixed(held, 85, *near._sketch(held), 16)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            sc._jsc.clearJobGroup()
        stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
        store = sc._jsc.sc().statusStore()
        moved.append(sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages))
    tokens = sum(300 - 3 - -(-85 * 297 // 100) + 1 for _ in texts)
    assert moved[1] < 1.15 * moved[0], [m / tokens for m in moved]
