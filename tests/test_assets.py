"""Assets on the disk: what is told of them, tasks that are tried again, jobs that fail, and media that items name."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from pagewright.sources import assets as A


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if "/.assets-" not in d)


def test_what_lies_on_the_disk(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("a/b.json", '{"ä": 1}\n'), ("c.txt", None), ("a/d.txt", "x" * 5000)], "path string, content string").repartition(3)
    got = {r.path: (r.bytes, r.sha256) for r in A.write_assets(df, root).collect()}
    assert files(root) == ["a/b.json", "a/d.txt", "c.txt"] == sorted(got)
    for path, (size, digest) in got.items():
        body = (tmp_path / "out" / path).read_bytes()
        assert (len(body), hashlib.sha256(body).hexdigest()) == (size, digest)
    twice = spark.createDataFrame([("c.txt", b"1"), ("c.txt", b"2"), ("e", bytes(range(256)))], "path string, content binary")
    again = A.write_assets(twice, root).collect()
    assert sorted(r.path for r in again) == ["c.txt", "e"] and (tmp_path / "out/e").read_bytes() == bytes(range(256)) and (tmp_path / "out/c.txt").read_bytes() in (b"1", b"2")
    assert A.write_assets(df.limit(0), root).count() == 0


def test_a_task_that_is_tried_again(tmp_path):
    """Two tries of a task: only what the committed one wrote gets a name."""
    from pyspark.sql import Row

    w = A._Writer(str(tmp_path), str(tmp_path / ".assets-x" / "listing.tsv"))
    w.write(iter([Row(path="a", content="lost"), Row(path="b", content="lost")]))
    w.commit([w.write(iter([Row(path="a", content="kept")]))])
    assert files(str(tmp_path)) == ["a"] and (tmp_path / "a").read_text() == "kept"


def test_jobs_that_fail_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("ok.txt", "x"), ("../out.txt", "y")], "path string, content string").coalesce(1)
    with pytest.raises(Exception, match="below the folder"):
        A.write_assets(df, root)
    assert files(root) == []


def test_media(spark, tmp_path):
    (tmp_path / "pic ä.png").write_bytes(b"\x89PNG")
    at = f"file://{tmp_path}/pic%20%C3%A4.png?v=1#f"
    items = spark.createDataFrame([(1, at), (2, f"file://{tmp_path}/gone.png"), (3, "http://h/x.png"), (4, ""), (5, None), (6, at)], "id int, source string")
    got = {r.id: r for r in A.read_media(spark, items, str(tmp_path)).collect()}
    assert {i: r.error for i, r in got.items()} == {1: None, 2: "no such file", 3: "not a file", 4: "no source", 5: "no source", 6: None}
    assert bytes(got[1].content) == b"\x89PNG" == bytes(got[6].content) and got[1].bytes == 4 and got[1].sha256 == hashlib.sha256(b"\x89PNG").hexdigest() and got[2].content is None
    assert spark.range(1).select(A.media_paths(F.lit("FILE:///a+b")).alias("p")).first().p == "/a+b"
