"""The cache as documents: damage, versions, writers that fail."""

import pytest

from sonolith.sources import cache

ROWS = "path string, size long, mtime_ns long, rules string, bucket string, seen long"


def entries(spark, *rows):
    return spark.createDataFrame([(p, 10, 20, "r1", b, s) for p, b, s in rows], ROWS)


def held(spark, folder, rules="r1"):
    return sorted((r.path, r.bucket, r.seen) for r in cache.read(spark, folder, rules).collect())


def test_write_update_read(spark, tmp_path):
    folder = f"{tmp_path}/cache"
    assert held(spark, folder) == [] and cache.pointers(folder) == []
    assert cache.update(spark, folder, entries(spark, ("a", "x", 1), ("b", "y", 1)), "r1")
    assert cache.update(spark, folder, entries(spark, ("b", "z", 2), ("c", "w", 2)), "r1")
    assert held(spark, folder) == [("a", "x", 1), ("b", "z", 2), ("c", "w", 2)]
    before = cache.pointers(folder)
    assert not cache.update(spark, folder, entries(spark, ("b", "q", 3)).where("false"), "r1") and cache.pointers(folder) == before
    assert [n for n, _ in before] == [1, 2] and held(spark, folder, "r2") == []


def test_damaged_documents_are_left_out(spark, tmp_path):
    good = '{"format":1,"path":"%s","size":1,"mtime_ns":2,"rules":"r1","bucket":"k"}'
    texts = [
        good % "ok", "﻿" + good % "bom", good % "cut"[:3] + "x", (good % "half")[:40], "", "null", "3", "[1]", '"text"', "[" * 5000, good.replace('"format":1', '"format":2') % "other", good.replace('"size":1', '"size":"1"') % "text size",
        good.replace('"size":1', '"size":1.5') % "part", good.replace('"size":1,', "") % "none", good.replace('"bucket":"k"', '"bucket":null') % "no bucket", good.replace('"bucket":"k"', '"bucket":{"a":1}') % "deep", good.replace('"r1"', '"r2"') % "rules",
        (good % "more").replace("}", ',"new":[1,{"a":null}],"seen":7}'), good.replace('"path":"%s"', '"path":5'), '{"format":1}', good.replace('"mtime_ns":2', '"mtime_ns":1700000000000000000') % "long",
    ]
    folder = f"file://{tmp_path}/c"
    cache.publish(spark.createDataFrame([(t,) for t in texts], "value string"), folder)
    assert held(spark, folder) == [("bom", "k", 0), ("long", "k", 0), ("more", "k", 7), ("ok", "k", 0)]
    assert held(spark, folder, "r2") == [("rules", "k", 0)]


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "c")
    cache.update(spark, folder, entries(spark, ("a", "x", 1)), "r1")
    bad = entries(spark, ("b", "y", 1)).selectExpr("path", "size", "mtime_ns", "rules", "if(seen = 1, raise_error('lost'), bucket) bucket", "seen")
    with pytest.raises(Exception, match="lost"):
        cache.publish(cache.documents(bad), folder)
    assert held(spark, folder) == [("a", "x", 1)] and len(cache.pointers(folder)) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "c")
    cache.update(spark, folder, entries(spark, ("a", "x", 1)), "r1")
    monkeypatch.setattr(cache, "pointers", lambda _: [])
    with pytest.raises(RuntimeError, match="another writer"):
        cache.publish(cache.documents(entries(spark, ("b", "y", 1))), folder)
    monkeypatch.undo()
    assert held(spark, folder) == [("a", "x", 1)]


def test_the_same_path_twice_in_a_version(spark, tmp_path):
    folder = str(tmp_path / "c")
    cache.publish(cache.documents(entries(spark, ("a", "x", 1), ("a", "y", 3), ("a", "z", 2))), folder)
    assert held(spark, folder) == [("a", "y", 3)]
