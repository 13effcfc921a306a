import math
import random
from collections import Counter, defaultdict

import pytest

from pagewright.llm import lm


def brute(train, texts, order=lm.ORDER):
    """Perplexities by plain recursion over the counts."""
    counts = {order: Counter()}
    for t in train:
        s = lm.START * (order - 1) + t
        counts[order].update(s[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, total, left = {}, defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        n = Counter(c.values())
        d[k] = lm.discounts(n[1], n[2], n[3], n[4])
        for g, x in c.items():
            total[k, g[:-1]] += x
            left[k, g[:-1]] += d[k][min(x, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        t = total.get((k, g[:-1]))
        if not t:
            return p(g[1:])
        c = counts[k].get(g, 0)
        return (c - d[k][min(c, 3) - 1] if c else 0) / t + left[k, g[:-1]] / t * p(g[1:])

    out = []
    for t in texts:
        s = lm.START * (order - 1) + (t or "")
        logs = [math.log(p(s[i : i + order])) for i in range(len(t or ""))]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_MB", 0.001)
    monkeypatch.setattr(lm, "CHUNK", 150)
    r = random.Random(1)
    texts = ["".join(r.choice("aabbcdeé 🙂日\n") for _ in range(r.randrange(0, 90))) for _ in range(60)] + [None, "", "x" * 400]
    docs = spark.createDataFrame([(i, t, "en", "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, gram string, block int").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    got = {x.doc_id: x for x in lm.perplexities(docs, good).collect()}
    want = brute([texts[i] for i in range(0, 60, 2)], texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i].n_chars == len(texts[i] or "")
        assert (got[i].perplexity is None) if w is None else got[i].perplexity == pytest.approx(w, rel=1e-5)


def test_judged(spark):
    r = random.Random(2)
    word = lambda: r.choice(["the", "then", "and", "hand", "sand", "there"])
    rows = [(i, " ".join(word() for _ in range(40)), "en") for i in range(300)]
    rows += [(1000 + i, "".join(r.choice("QWXZ#$%") for _ in range(100)), "en") for i in range(10)]
    rows += [(None, rows[0][1], None), (2000, None, "en"), (2001, rows[1][1], None), (2001, rows[1][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(250)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    out = lm.judged(docs, labels).collect()
    assert len(out) == len(rows)
    kept = {x.doc_id: x.kept for x in out}
    assert not any(kept[1000 + i] for i in range(10)) and not kept[2000] and kept[None] and kept[2001]
    assert sum(kept[i] for i in range(300)) >= 285
    stay = lm.keep_good(docs, labels)
    assert stay.columns == docs.columns and stay.count() == sum(x.kept or x.doc_id is None for x in out)
    assert lm.judged(docs.limit(0), labels).count() == 0
    assert all(x.kept for x in lm.judged(docs.where("doc_id < 5"), labels.limit(0)).collect())


def test_languages_with_few_trusted_rows(spark):
    r = random.Random(5)
    some = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rare = ["".join(r.choice("αβγδεζηθικλμ") for _ in range(5)) for _ in range(400)]
    none = ["".join(r.choice("бвгджзклмнпр") for _ in range(5)) for _ in range(400)]
    rows = [(i, some(["the", "then", "and", "hand", "sand"], 40), "en") for i in range(300)]
    rows += [(1000 + i, some(rare, 30), "el") for i in range(30)] + [(2000 + i, some(none, 30), "ru") for i in range(30)] + [(3000, None, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(250), *range(1000, 1012)]], "doc_id long, quality int")
    out = {x.doc_id: x for x in lm.judged(docs, labels).collect()}
    assert all(out[2000 + i].kept for i in range(30)) and not out[3000].kept
    assert all(out[1000 + i].kept for i in range(12)) and all(out[1000 + i].threshold > out[0].threshold for i in range(30))
