"""Stored tables: a stop at any step loses no row, and only touched buckets are written."""

import glob
import os

import pytest
from caselake.sources import stored
from caselake.sources.stored import StoredTable, manifest_upsert
from caselake.streaming import attempts

SCHEMA = "id long, run int, note string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(df):
    return sorted(map(tuple, df.collect()), key=repr)


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["before data", "half of the data", "before the commit", "half a commit", "before cleaning"])
def test_a_stop_between_any_two_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "m")
    manifest_upsert(path, make(spark, [(i, 1, "a") for i in range(40)]), "id", ["run"])
    manifest_upsert(path, make(spark, [(1, 2, "b")]), "id", ["run"])

    def stop(self, *args):
        if step == "half a commit":
            os.makedirs(f"{path}/commits", exist_ok=True)
            open(f"{path}/commits/2.json", "w").write('{"buckets": 16, "he')
        raise Stop

    with monkeypatch.context() as m:
        if step == "before data":
            m.setattr(stored, "upsert", stop)
        elif step == "half of the data":
            os.makedirs(f"{path}/data/v=2/bucket=3")
            open(f"{path}/data/v=2/bucket=3/part-broken.parquet", "w").write("PAR1")
            m.setattr(stored, "upsert", stop)
        else:
            m.setattr(StoredTable, "_clean" if step == "before cleaning" else "_commit", stop)
        with pytest.raises(Stop):
            manifest_upsert(path, make(spark, [(2, 3, "c"), (99, 3, "new")]), "id", ["run"])
    got = state(StoredTable(spark, path, "id", ["run"], make(spark, []).schema).read())
    old = sorted([(0, 1, "a"), (1, 2, "b")] + [(i, 1, "a") for i in range(2, 40)], key=repr)
    new = sorted([(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (99, 3, "new")] + [(i, 1, "a") for i in range(3, 40)], key=repr)
    assert got == (new if step == "before cleaning" else old)
    assert state(manifest_upsert(path, make(spark, [(2, 3, "c"), (99, 3, "new"), (None, 3, "no key")]), "id", ["run"])) == new


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    table = StoredTable(spark, path, "id", ["run"], make(spark, []).schema, 8)
    assert table.read().count() == 0
    table.merge(make(spark, [(i, 1, "a") for i in range(100)]))
    table.merge(make(spark, [(7, 2, "b")]))
    assert len(glob.glob(f"{path}/data/v=1/bucket=*")) == 1 and len(glob.glob(f"{path}/data/v=0/bucket=*")) == 8
    assert table.merge(make(spark, [(7, 9, "again")]), 1) == 1  # a version that is there already
    assert table.merge(make(spark, []), 5) == 5
    assert state(table.read()) == sorted([(i, 1, "a") for i in range(100) if i != 7] + [(7, 2, "b")], key=repr)
    # other numbers of buckets change nothing, and files that no commit names go
    wide = StoredTable(spark, path, "id", ["run"], make(spark, []).schema, 3)
    for run in range(6, 9):
        wide.merge(make(spark, [(i, run, "z") for i in range(100)]))
    assert state(wide.read()) == sorted([(i, 8, "z") for i in range(100)], key=repr)
    assert sorted(os.listdir(f"{path}/data")) == ["v=7", "v=8"]


def test_streams_start_again_with_and_without_new_files(spark, tmp_path):
    source, target, home = (str(tmp_path / x) for x in ("in", "out", "state"))
    make(spark, [(1, 1, "a"), (2, 1, "a")]).write.parquet(source)
    schema = make(spark, []).schema

    def start():
        return state(attempts.stream_upsert(attempts.read_log(spark, source, schema, 1), target, home, "id", ["run"], 4))

    first = start()
    assert first == [(1, 1, "a"), (2, 1, "a")] and start() == first
    make(spark, [(2, 2, "b"), (3, 1, "c")]).write.mode("append").parquet(source)
    assert start() == [(1, 1, "a"), (2, 2, "b"), (3, 1, "c")] == start()


def test_best_status_starts_again(spark, tmp_path):
    source, target, home = (str(tmp_path / x) for x in ("in", "out", "state"))
    make(spark, [(1, 1, "fail"), (2, 1, "ok")]).write.parquet(source)

    def start():
        log = attempts.read_log(spark, source, make(spark, []).schema, 1)
        return state(attempts.stream_best_status(log, home, target, ["id"], "note", {"ok": 2, "fail": 1}, ["ok", "fail"], "none"))

    assert start() == [(1, "fail", 1), (2, "ok", 1)] == start()
    make(spark, [(1, 2, "ok")]).write.mode("append").parquet(source)
    assert start() == [(1, "ok", 2), (2, "ok", 1)]
