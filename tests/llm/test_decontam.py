import itertools
import random
import re

import numpy as np

from pagewright.llm import decontam as D


def words(t):
    return re.findall(r"(?:[^\x00-\x7f]|[a-z0-9])+", (t or "").lower())


def brute(doc, item):
    """Longest stretch on any diagonal by trying all of them."""
    a, b, best = words(doc), words(item), 0
    for o in range(-len(b) + 1, len(a)):
        lo, hi = max(0, -o), min(len(b), len(a) - o)
        eq = [a[o + i] == b[i] for i in range(lo, hi)]
        for i in range(len(eq)):
            for j in range(i + 1, len(eq) + 1):
                if eq[i] and eq[j - 1] and 100 * sum(eq[i:j]) >= D.SHARE * (j - i):
                    best = max(best, j - i)
    return best if b and best >= min(D.MIN_WORDS, len(b)) else 0


def test_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice("abcdé") + r.choice("fghi") + r.choice("jklm")
    items = [[word() for _ in range(n)] for n in (3, 8, 12, 14, 30, 45)] + [[], None]
    docs = [None, "", "x"]
    for _ in range(60):
        w = [word() for _ in range(r.randrange(0, 40))]
        item = r.choice(items[:6])
        part = list(item) if r.random() < 0.6 else item[: r.randrange(1, len(item) + 1)]
        for i in range(r.choice([0, 0, 1])):
            part[r.randrange(len(part))] = word()
        w += [x.upper() + r.choice(["", ",", "."]) if r.random() < 0.2 else x for x in part] + [word() for _ in range(r.randrange(0, 20))]
        docs.append(" ".join(w))
    d = spark.createDataFrame([(i, t, i, 0) for i, t in enumerate(docs)] + [(None, docs[5], 0, 0), (5, docs[5], 0, 0)], "doc_id long, text string, seed int, id int").repartition(3)
    b = spark.createDataFrame([(i, None if t is None else " ".join(t), 0) for i, t in enumerate(items)] + [(4, " ".join(items[4]), 0)], "item_id long, text string, id int")
    got = {(x.doc_id, x.item_id): x.n_words for x in D.contaminated(d, b).collect()}
    want = {(i, j): n for i, t in enumerate(docs) for j, it in enumerate(items) if (n := brute(t, " ".join(it or [])))}
    assert {k: v for k, v in got.items() if want.get(k) != v} == {}
    assert set(want) == set(got)
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0
    bad = {k[0] for k in got}
    assert sorted(x.doc_id for x in D.clean(d, b).where("doc_id IS NOT NULL").select("doc_id").collect()) == [i for i in range(len(docs)) if i not in bad]


def test_stretch():
    r = np.random.default_rng(1)
    for _ in range(300):
        e = r.random(r.integers(1, 30)) < r.choice([0.3, 0.7, 0.9])
        a, z = D.stretch(e)
        ok = [j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if e[i] and e[j - 1] and 100 * e[i:j].sum() >= D.SHARE * (j - i)]
        assert z - a == max(ok, default=0)
        assert z == a or (e[a] and e[z - 1] and 100 * e[a:z].sum() >= D.SHARE * (z - a))


def spots(n, mask):
    return [sum(1 << (i + s) for i, c in enumerate(mask) if c == "1") for s in range(n - len(mask) + 1)]


def test_masks_meet_all_that_verify_accepts():
    for n in range(1, 24):
        places = [x for m in (D.SHORT[n] if n < D.MIN_WORDS else D.MASKS) for x in spots(n, m)]
        for gone in itertools.combinations(range(1, n - 1), n * (100 - D.SHARE) // 100):
            left = (1 << n) - 1 - sum(1 << i for i in gone)
            assert any(x & left == x for x in places), (n, gone)


def test_masks_meet_long_stretches():
    """Best score (1 an equal word, -4 another; 0 is SHARE percent) of rows without any mask: below 0 from 12 to 23 words, so for all longer ones, being made of such."""
    span, whole = max(map(len, D.MASKS)), [int(m, 2) for m in D.MASKS]
    best = {(0, 0): 0}
    for n in range(1, 2 * D.MIN_WORDS):
        new = {}
        for (row, size), score in best.items():
            for equal in (0, 1):
                x = (row << 1 | equal) & ((1 << span) - 1)
                if not any(x & w == w for w in whole):
                    at = x & ((1 << (span - 1)) - 1), min(size + 1, span)
                    new[at] = max(new.get(at, -999), score + (1 if equal else -4))
        best = new
        assert n < D.MIN_WORDS or max(best.values()) < 0


def test_replaced_words_are_found(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    items, docs = [], []
    for n in (5, 7, 10, 11, 12, 13, 15, 16, 18, 20, 25):
        for _ in range(30):
            item = [word() for _ in range(n)]
            part = list(item)
            for i in r.sample(range(1, n - 1), n // 5):
                part[i] = word()
            items.append(" ".join(item))
            docs.append(" ".join([word() for _ in range(r.randrange(9))] + part + [word() for _ in range(r.randrange(9))]))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in D.contaminated(d, b).collect()) == [(i, i) for i in range(len(docs))]


def test_other_keys_and_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    for kind, key in (("int", 3), ("string", "q"), ("short", 4)):
        b = spark.createDataFrame([(key, item), (None, item)], f"item_id {kind}, text string")
        d = spark.createDataFrame([(1, f"x {item} y", 0, 0), (2, "clean", 0, 0), (None, item, 0, 0)], "doc_id int, text string, _bad int, item int")
        assert [(r.doc_id, r.item_id, r.n_words) for r in D.contaminated(d, b).collect()] == [(1, key, 20)]
        left = D.clean(d, b)
        assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "None"]
