"""The event cap as a stream, over restarts and with state that expires."""

import pytest

from pagewright.streaming import events as S

SCHEMA = "k string, ts timestamp, v int"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_cap_over_restarts(spark, store, tmp_path):
    """Counts go on over two restarts; a key that was silent for an hour of event time has no state left and counts anew."""
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    spark.createDataFrame([], SCHEMA).write.parquet(source)

    def run(rows):
        df = spark.createDataFrame([(k, v) for k, v in rows], "k string, v int").selectExpr("k", "timestamp_seconds(v * 60) AS ts", "v")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = S.capped(spark.readStream.schema(SCHEMA).parquet(source), "k", "ts", most=3, late="0 seconds", silence="1 hour")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").start()
        q.processAllAvailable()
        rows_held = sum(o.numRowsTotal for o in q.lastProgress.stateOperators) if q.lastProgress else 0
        q.stop()
        return sorted((r.k, r.v) for r in spark.read.schema(SCHEMA).parquet(out).collect()), rows_held

    first, _ = run([("a", 2), ("a", 1), ("b", 1)])
    assert first == [("a", 1), ("a", 2), ("b", 1)]
    second, before = run([("a", 3), ("a", 4), ("b", 5)])
    assert second == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 5)]
    third, held = run([("c", 100), ("c", 101)])  # the watermark passes a's and b's last events by more than an hour
    assert third == second + [("c", 100), ("c", 101)] and (before, held) == (2, 1)
    fourth, held = run([("a", 102)])
    assert fourth == sorted(third + [("a", 102)]) and held == 2
