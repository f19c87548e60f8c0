"""Keyed tables: buckets, snapshots, killed commits, types and awkward rows."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import merge as M


def _files(path):
    return {str(p.relative_to(path)): hashlib.sha1(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def _table(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def path(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.range(200).selectExpr("id AS k", "concat('v', id) AS v")
    assert M.create(df, p, "k", buckets=16) == 1
    return p


def test_merge_rewrites_only_its_buckets(spark, path):
    before = M.version(spark, path)
    files = _files(path)
    assert M.merge(spark.createDataFrame([(5, "new"), (1000, "more")], "k int, v string"), path) == 2
    got = dict(M.read(spark, path).collect())
    assert len(got) == 201 and got[5] == "new" and got[1000] == "more" and got[6] == "v6"
    after = M.version(spark, path)
    moved = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(moved) <= 2
    assert files.items() <= _files(path).items()
    assert dict(M.read(spark, path, 1).collect())[5] == "v5"


def test_killed_commit_leaves_the_last_version(spark, path, monkeypatch):
    want = _table(M.read(spark, path))
    open_before = M.read(spark, path)
    listed, died = M._listed, []

    def dies(s, folder):
        if "/data/" in folder:
            died.append(folder)
            raise KeyboardInterrupt
        return listed(s, folder)

    monkeypatch.setattr(M, "_listed", dies)
    with pytest.raises(KeyboardInterrupt):
        M.merge(spark.createDataFrame([(5, "lost")], "k long, v string"), path)
    monkeypatch.undo()
    assert died and _table(M.read(spark, path)) == want
    # a manifest without its _SUCCESS is no version, and its number isn't used again
    half = Path(path) / "manifest" / "v000000002"
    half.mkdir()
    (half / "part-0.json").write_text('{"bucket":0,"folder":"x"}')
    assert M.versions(spark, path) == [1]
    assert M.merge(spark.createDataFrame([(5, "kept")], "k long, v string"), path) == 3
    assert dict(M.read(spark, path).collect())[5] == "kept"
    assert _table(open_before) == want
    assert M.vacuum(spark, path) > 0
    assert M.versions(spark, path) == [3] and dict(M.read(spark, path).collect())[5] == "kept"
    assert M.read(spark, path).count() == 200


def test_two_writers_of_one_version(spark, path):
    v, number, cast, hit, _ = M._changed(spark, path, spark.createDataFrame([(1, "a")], "k long, v string"), True)
    M.merge(spark.createDataFrame([(1, "b")], "k long, v string"), path)
    with pytest.raises(Exception, match="(?i)exist"):
        M._commit(spark, path, cast, v, number, v.keys, v.buckets, hit)
    assert dict(M.read(spark, path).collect())[1] == "b"


def test_groups_null_keys_new_columns_and_deletes(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (None, "x", "c"), (2, None, "d")], "k long, `k.2` string, v string")
    M.create(df, p, ["k", "k.2"], buckets=4)
    up = spark.createDataFrame([(1, "x", "A", 7), (None, "x", "C", 8), (None, "x", "C", 8)], "k int, `k.2` string, v string, n int")
    M.merge(up, p)
    assert _table(M.read(spark, p)) == sorted(
        [(1, "x", "A", 7), (None, "x", "C", 8), (None, "x", "C", 8), (2, None, "d", None)], key=repr)
    M.insert_absent(spark.createDataFrame([(2, None, "z"), (3, "y", "f"), (3, "y", "e")], "k long, `k.2` string, v string"), p)
    got = _table(M.read(spark, p))
    assert (3, "y", "e", None) in got and len(got) == 5 and (2, None, "d", None) in got
    last = M.version(spark, p).number
    none = up.where("false")
    assert M.merge(none, p) == M.insert_absent(none, p) == M.delete(none, p) == last
    M.delete(M.read(spark, p), p)
    assert M.read(spark, p).count() == 0
    M.merge(up.limit(1), p)
    assert M.read(spark, p).count() == 1


def test_empty_table_and_bad_calls(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(ValueError):
        M.read(spark, p)
    empty = spark.createDataFrame([], "k long, v string")
    M.create(empty, p, "k")
    assert M.read(spark, p).schema.names == ["k", "v"] and M.read(spark, p).count() == 0
    with pytest.raises(ValueError):
        M.create(empty, p, "k")
    with pytest.raises(ValueError):
        M.create(empty.withColumn(M.BUCKET, F.lit(1)), p + "2", "k")


def test_insert_adds_and_few_changed_keys_shuffle_no_present_row(spark, path, monkeypatch):
    M.insert_absent(spark.range(190, 210).selectExpr("id AS k", "concat('w', id) AS v"), path)
    first, second = M.version(spark, path, 1), M.version(spark, path, 2)
    # the rows that were there are in the files that they were in
    assert {f for of in first.folders.values() for f in of} <= {f for of in second.folders.values() for f in of}
    got = dict(M.read(spark, path).collect())
    assert len(got) == 210 and got[195] == "v195" and got[205] == "w205"
    assert M.insert_absent(spark.range(5).selectExpr("id AS k", "'z' AS v"), path) == 2  # nothing absent
    up = spark.createDataFrame([(205, "n", 1), (300, "n", 2), (None, "n", 3)], "k long, v string, m int")
    calls, commit = [], M._commit
    monkeypatch.setattr(M, "_commit", lambda *a: (calls.append(len(a)), commit(*a))[1])
    want = sorted([r for r in [(k, v, None) for k, v in got.items()] if r[0] != 205] + [tuple(r) for r in up.collect()], key=repr)
    assert M.merge(up, path) == 3 and _table(M.read(spark, path)) == want and calls.pop() == 9
    M.delete(spark.createDataFrame([(None,), (300,)], "k long"), path)
    assert _table(M.read(spark, path)) == [r for r in want if r[0] not in (None, 300)] and calls.pop() == 9
    monkeypatch.setattr(M, "KEY_BYTES", 0)   # many keys: rows meet them in a shuffle
    M.merge(up, path)
    assert _table(M.read(spark, path)) == want and calls.pop() == 8
    assert M.vacuum(spark, path) > 0 and _table(M.read(spark, path)) == want
