"""What an executor holds beside Spark's own memory stays small: batches for Python workers, and the workers' arrays."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from pagewright.llm import common as C
from pagewright.llm import lm, near

SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_small_inside_only(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    docs = spark.range(4000).selectExpr("id", "repeat('x', 3000) AS text").repartition(1)
    largest = lambda: max(r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect())
    with C.small_batches(spark):
        assert largest() < 5e6
    assert largest() > 1e7 and spark.conf.get(SIZE, None) is None
    spark.conf.set(SIZE, "1m")
    try:
        with C.small_batches(spark):
            assert largest() < 2e6
        assert spark.conf.get(SIZE) == "1m"
    finally:
        spark.conf.unset(SIZE)


def test_quality_and_near_groups_run_with_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i % 3} here", "en") for i in range(20)], "doc_id long, text string, lang string")
    at = []
    sketch, perplexities = near._sketch, lm.perplexities
    monkeypatch.setattr(near, "_sketch", lambda held: (at.append(spark.conf.get(SIZE, None)), sketch(held))[1])
    monkeypatch.setattr(lm, "perplexities", lambda *x: (at.append(spark.conf.get(SIZE, None)), perplexities(*x))[1])
    near.near_groups(docs).collect()
    lm.judged(docs, docs.selectExpr("doc_id", "1 AS quality")).collect()
    assert at == [C.BATCH, C.BATCH] and spark.conf.get(SIZE, None) is None


def test_small_batches_share_bundles(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 20) AS text", "'en' AS lang").repartition(1)
    monkeypatch.setattr(C, "BATCH", "16k")
    with C.small_batches(spark):
        got = lm.bundles(docs, "doc_id", "text", "lang", 3).select("block", "keys").collect()
    assert sorted(r.block for r in got) == [0, 1, 2] and sorted(k for r in got for k in r["keys"]) == list(range(3000))


def test_a_set_is_given_once_over_small_batches(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same words in every one of these rows' AS text").repartition(1)
    monkeypatch.setattr(C, "BATCH", "16k")
    with C.small_batches(spark):
        assert near.shingled(docs, 4, "doc_id", "text", True).where("tok IS NOT NULL").count() == 1


@pytest.mark.parametrize("bundle, n", [(1, 1000), (8, 500)])
def test_counting_a_block_takes_little_memory(bundle, n):
    import zstandard

    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    rows = []
    for j in range(bundle):
        texts = [" ".join(r.choice(words) for _ in range(400)).encode() for _ in range(n)]
        rows.append((0, list(range(1000 * j, 1000 * j + len(texts))), ["en"] * len(texts), [len(t) for t in texts], zstandard.compress(b"".join(texts))))
    names = ["block", "keys", "langs", "sizes", "texts"]
    types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
    t = pa.table({n: pa.array(x, k) for n, x, k in zip(names, zip(*rows), types)})
    tracemalloc.start()
    out = lm._counted(t, pa.table({"key": pa.array([0, 1], pa.int64())}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == len(set(out.column("gram").to_pylist()))
    assert sum(out.column("count").to_pylist()) == sum(sum(x[:2]) for _, keys, _, x, _ in rows if 0 in keys)
    assert peak < 50e6, peak
