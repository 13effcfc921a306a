import random
import re

import numpy as np
import pyarrow as pa

from pagewright.llm import common as C
from pagewright.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
        lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts(n, seed=1):
    r = random.Random(seed)
    out = [None, "", "  ", "\n\n", "a", "a\na\n a\na", "é#\r\né#\r\n", "x\n\n\nx\n"]
    for _ in range(n):
        out.append("".join(r.choice(["ab", "é", " ", " ", "\n", "#", "c d e f g h i j k ", "\t", "日本 "]) for _ in range(r.randrange(1, 120))))
    return out


def test_statistics_against_brute_force():
    got = []
    for p in C.pieces(pa.array(texts(300))):
        s = rules.statistics(p)
        got += list(zip(*(s[c].tolist() for c in rules.COUNTS[:5])))
    assert got == [brute(t) for t in texts(300)]


def test_forest_isolates_what_is_far():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (500, 3)), r.normal(12, 1, (5, 3))])
    s = rules.Forest(x).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.95)


def test_verdicts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(60)) if i % 9 else " ".join(word().upper() + "!!#" for _ in range(60)), 1) for i in range(400)] + [(None, None, 1), (1000, "", 0), (1001, "few words", 0), (1001, "few words", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(i, int(i % 9 > 0), None) for i in range(300)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in rules.rule_verdicts(docs, labels).collect()}
    assert not out[1000].kept and out[1001].base_failed and not out[None].kept
    junk = [out[i].kept for i in range(400) if i % 9 == 0]
    fine = [out[i].kept for i in range(400) if i % 9]
    assert sum(junk) == 0 and sum(fine) > 0.97 * len(fine)
    assert rules.rule_verdicts(docs.limit(0), labels).count() == 0
    assert rules.rule_verdicts(docs, labels.limit(0)).where("kept").count() == 400
