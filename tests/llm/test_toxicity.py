import itertools
import math
import random

import numpy as np
import pytest

from pagewright.llm import toxicity as X


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    lengths = [0, 1, 5, 3, 0, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e, pairs = r.normal(0, 2, first[-1]), r.normal(0, 1, (2, 2))
    got = X.marginals(e, first, pairs)
    for a, z in zip(first[:-1], first[1:]):
        total, ones = 0.0, np.zeros(z - a)
        for y in itertools.product((0, 1), repeat=z - a):
            w = math.exp(sum(e[a + i] * v for i, v in enumerate(y)) + sum(pairs[u, v] for u, v in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        assert np.allclose(got[a:z], ones / total)


def likelihood(e, first, pairs, label):
    """Negative log-likelihood of some chains, by the forward sums of both labels."""
    out = 0.0
    for a, z in zip(first[:-1], first[1:]):
        total = None
        for t in range(a, z):
            here = np.array([0.0, e[t]])
            total = here if total is None else here + np.log(np.exp(total[:, None] + pairs).sum(0))
            out -= e[t] * label[t] + (pairs[int(label[t - 1]), int(label[t])] if t > a else 0.0)
        out += 0.0 if total is None else np.log(np.exp(total).sum())
    return out


def test_slopes_against_differences():
    r = np.random.default_rng(5)
    lengths = [0, 1, 6, 2, 0, 9]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e, pairs, label = r.normal(0, 2, first[-1]), r.normal(0, 1, (2, 2)), r.integers(0, 2, first[-1]).astype(float)
    each, both = X.slopes(e, first, pairs, label)
    step = 1e-6
    for i in range(len(e)):
        d = np.eye(len(e))[i] * step
        assert abs((likelihood(e + d, first, pairs, label) - likelihood(e - d, first, pairs, label)) / (2 * step) - each[i]) < 1e-5
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = step
        assert abs((likelihood(e, first, pairs + d, label) - likelihood(e, first, pairs - d, label)) / (2 * step) - both[i, j]) < 1e-5


def corpus(n, seed):
    r = random.Random(seed)
    syllable = ["an", "the", "re", "ti", "on", "éb", "ur", "lo"]
    word = lambda: "".join(r.choice(syllable) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 90))]
        toxic = int(r.random() < 0.2)
        for _ in range(r.randrange(1, 3) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["Scum,", "zgrok" + word(), "vilk" + word()]))
        rows.append((i, " ".join(w), toxic, "x"))
    return rows


def test_held_out(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, spans string")
    model = X.train(docs, docs.where("doc_id < 600").selectExpr("doc_id", "score AS toxic"))
    out = {r.doc_id: r for r in X.score(docs, model).collect()}
    for i, text, toxic, _ in rows[600:]:
        for s in out[i].spans:
            assert text[s.start : s.end].lower().startswith(("scum", "zgrok", "vilk"))
    assert sum(out[i].predicted == toxic for i, _, toxic, _ in rows[600:]) >= 297


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "scum " * 4000), (2, "scum " * 4000)], "doc_id long, text string")
    out = X.score(docs, None).collect()
    assert [r.score for r in out] == [0.0] * 4
    model = X.fit([r[1] for r in corpus(300, 2)], [r[2] for r in corpus(300, 2)])
    got = X.score(docs, model).collect()
    assert [r.predicted for r in got] == [0, 0, 1, 1] and all(0 <= r.score <= 1 for r in got)
    assert X.score(docs.limit(0), model).count() == 0
    assert X.train(docs, docs.limit(0).selectExpr("doc_id", "1 AS toxic")) is None


@pytest.mark.parametrize("copies", [1, 40])
def test_copies_make_no_markers(copies):
    r = random.Random(3)
    plain = lambda: [f"w{r.randrange(50)}" for _ in range(20)]
    toxic = [[*plain(), "bad" + r.choice("abcdefgh") + "x", *plain()] for _ in range(40)] + [["w1", "badix", "copy", "w2"]] * copies
    got = X.markers(toxic, [plain() for _ in range(100)])
    assert "copy" not in got and any("badqx".startswith(m.rstrip("*")) for m in got)
