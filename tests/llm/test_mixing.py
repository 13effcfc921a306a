from fractions import Fraction

import pandas as pd
from oracle import of_spark, rows

from pagewright.llm import mixing

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, copies long, rows int"


def test_matches_sql(spark):
    assert of_spark(mixing.op10_mixing(spark, SF)) == rows(mixing.OP10_SQL, SF)


def test_small_tables(spark):
    data = [(1, "a b c", "en", "s", 1, 2), (1, "a b c", "en", "s", 1, 2), (2, None, None, None, 1, 2), (None, "", "en", "t", 1, 2), (3, "x " * 5000, "de", "t", 1, 2), (4, "x", "de", None, 1, 2)]
    df = spark.createDataFrame(data, KIND)
    frame = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "c", "r"]).astype({"doc_id": "Int64"})
    assert of_spark(mixing.mix(df)) == rows(mixing.OP10_SQL, documents=frame)
    assert mixing.mix(df.limit(0)).count() == 0


def fill(children, budget):
    """Shares by weight with capacities, a shortage going to the rest again and again."""
    got, open_ = {}, dict(children)
    while open_:
        w = sum(v[1] for v in open_.values())
        full = [k for k, (c, x) in open_.items() if Fraction(budget * x, w) >= c]
        if not full:
            return got | {k: budget * x // w for k, (c, x) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[0]
            budget -= got[k]
    return got


def test_shortages_go_to_siblings_first(spark):
    leaves = {("web", "en", "a"): 10, ("web", "en", "b"): 1000, ("web", "de", "c"): 1000, ("books", "en", "d"): 30, ("forum", "en", "e"): 5000, ("forum", "fr", "f"): 70}
    df = spark.createDataFrame([(*k, v, 1) for k, v in leaves.items()], "domain string, lang string, source string, tokens long, rows long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, mixing.WEIGHTS, 40, 1).collect()}
    under = lambda *p: sum(v for k, v in leaves.items() if k[: len(p)] == p)
    top = fill({d: (under(d), mixing.WEIGHTS["domain"][d]) for d in ("web", "books", "forum")}, sum(leaves.values()) * 40 // 100)
    want = {}
    for d in top:
        langs = fill({l: (under(d, l), mixing.WEIGHTS["lang"][l]) for l in {k[1] for k in leaves if k[0] == d}}, top[d])
        for l in langs:
            for s, b in fill({k[2]: (v, 1) for k, v in leaves.items() if k[:2] == (d, l)}, langs[l]).items():
                want[(d, l, s)] = b
    assert got == want
