"""Every stage on its own input against a plain version, over a small folder of tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from oracle import of_spark, rows
from test_decontam import words
from test_lm import brute as perplexities
from test_near import brute as near_brute
from test_suffixes import brute as repeats_brute

import corpus_pipeline
from pagewright.llm import decontam, lm, mixing

SF = "/root/testdata/sf0.001"


def contaminated(texts, items):
    where = defaultdict(list)
    for j, t in enumerate(items):
        for k, w in enumerate(words(t)):
            where[w].append((j, k))
    items = [words(t) for t in items]
    bad = set()
    for i, t in enumerate(texts):
        doc, hits = words(t), Counter()
        for k, w in enumerate(doc):
            hits.update((j, k - at) for j, at in where.get(w, ()))
        for (j, o), n in hits.items():
            if n < 0.8 * min(decontam.MIN_WORDS, len(items[j])):
                continue
            lo, hi = max(0, -o), min(len(items[j]), len(doc) - o)
            a, z = decontam.stretch(np.array([doc[o + k] == items[j][k] for k in range(lo, hi)]))
            if z - a >= min(decontam.MIN_WORDS, len(items[j])):
                bad.add(i)
    return bad


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return [*(d.toPandas().sort_values("doc_id").reset_index(drop=True) for d in out), docs]


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for d in steps[1:5]:
        assert list(d.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (d.n_chars == d.text.str.len()).all()


def test_quality(steps):
    before, after = steps[0], set(steps[1].doc_id)
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    good = set(labels[labels.quality == 1].doc_id)
    held = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}
    p = dict(zip(before.doc_id, perplexities([t for i, t in zip(before.doc_id, before.text) if i in good - held], before.text)))
    by = defaultdict(list)
    for i, lang in zip(before.doc_id, before.lang):
        if i in held and p[i] is not None:
            by[lang].append(p[i])
    cut = lambda v: sorted(v)[max(0, int(np.ceil(lm.QUANTILE * len(v))) - 1)]
    every = cut(sum(by.values(), []))
    want = {i for i, lang in zip(before.doc_id, before.lang) if p[i] is not None and p[i] <= (cut(by[lang]) if len(by[lang]) >= lm.FEW else every) * (1 + 1e-6)}
    assert after == want


def test_near_duplicates(steps):
    before = steps[1]
    keep = {before.doc_id[i] for i, _, root in near_brute(list(before.text), 5, 80) if i == root}
    assert set(steps[2].doc_id) == keep


def test_repeated_passages(steps):
    before, after = steps[2], dict(zip(steps[3].doc_id, steps[3].text))
    drop = defaultdict(set)
    for (d, _), at in repeats_brute(list(before.text), 50).items():
        drop[d] |= at
    for d, (i, t) in enumerate(zip(before.doc_id, before.text)):
        left = [w for k, w in enumerate(t.split()) if k not in drop.get(d, ())]
        assert after.get(i, "").split() == left
        if not drop.get(d):
            assert after[i] == t


def test_decontamination(steps):
    before = steps[3]
    bad = contaminated(list(before.text), list(pd.read_parquet(f"{SF}/benchmark.parquet").text))
    assert set(steps[4].doc_id) == set(before.doc_id) - {before.doc_id[i] for i in bad}


def test_mix_and_run(spark, steps):
    want = rows(mixing.OP10_SQL, documents=steps[4])
    assert of_spark(steps[5]) == want
    assert of_spark(corpus_pipeline.run(spark, SF)) == want
