"""Stored tables: only touched buckets are written, and a crash leaves a table as it was."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strata3d.sources.register import Register


def files(base, table):
    return {str(p): p.stat().st_mtime_ns for p in Path(base, table).rglob("*.parquet")}


def rows(reg, table="t"):
    return sorted((r.k, r.v) for r in reg.read(table).collect())


def test_an_upsert_of_one_row_writes_one_bucket(spark, tmp_path):
    reg = Register(spark, str(tmp_path), buckets=4)
    reg.upsert("t", spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")), ["k"], "b1")
    before = files(tmp_path, "t")
    assert len(before) == 4
    reg.upsert("t", spark.createDataFrame([(7, "new")], "k long, v string"), ["k"], "b2")
    after = files(tmp_path, "t")
    assert before.items() <= after.items() and len(after) == 5
    assert rows(reg) == [(k, "new" if k == 7 else "old") for k in range(100)]
    reg.upsert("t", spark.createDataFrame([(7, "twice")], "k long, v string"), ["k"], "b2")      # a replay
    assert files(tmp_path, "t") == after and rows(reg)[7] == (7, "new")
    reg.upsert("t", spark.createDataFrame([], "k long, v string"), ["k"], "b3")
    assert files(tmp_path, "t") == after


def test_an_earlier_batch_replayed_leaves_no_bucket_in_two_states(spark, tmp_path):
    reg = Register(spark, str(tmp_path), buckets=3)
    first = spark.range(30).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    reg.upsert("t", first, ["k"], "b1")
    reg.upsert("t", spark.createDataFrame([(4, "b")], "k long, v string"), ["k"], "b2")
    reg.upsert("t", first.filter("k < 3"), ["k"], "b1")
    assert rows(reg) == [(k, "b" if k == 4 else "a") for k in range(30)]


def test_columns_types_and_other_writes_meet_buckets(spark, tmp_path):
    reg = Register(spark, str(tmp_path), buckets=2)
    reg.replace("t", spark.createDataFrame([(1, "x", "P"), (2, "y", "Q")], "k int, v string, project_id string"), "b0")
    reg.upsert("t", spark.createDataFrame([(3, "z", "P", 5)], "k int, v string, project_id string, w int"), ["k"], "b1")
    assert rows(reg) == [(1, "x"), (2, "y"), (3, "z")] and reg.read("t").filter("w = 5").count() == 1
    reg.upsert("t", spark.createDataFrame([(4, "u", "P", 2 ** 40)], "k int, v string, project_id string, w long"), ["k"], "b2")
    assert {(r.k, r.w) for r in reg.read("t").collect()} == {(1, None), (2, None), (3, 5), (4, 2 ** 40)}
    reg.forget("t", "P", "b3")
    assert rows(reg) == [(2, "y")]
    reg.upsert("e", spark.createDataFrame([], "k int, v string"), ["k"], "b1")
    assert reg.has("e") and rows(reg, "e") == []
    reg.upsert("e", spark.createDataFrame([(None, "n")], "k int, v string"), ["k"], "b2")
    assert rows(reg, "e") == [(None, "n")]


def test_a_crash_before_the_pointer_moves_loses_nothing(spark, tmp_path, monkeypatch):
    reg = Register(spark, str(tmp_path), buckets=2)
    reg.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"], "b1")

    def crash(*_, **__):
        raise RuntimeError("lost")

    new = spark.createDataFrame([(1, "c")], "k int, v string")
    with monkeypatch.context() as m:
        m.setattr(Register, "_move", crash)
        for write in (lambda: reg.upsert("t", new, ["k"], "b2"), lambda: reg.replace("t", new, "b2")):
            with pytest.raises(RuntimeError):
                write()
    assert rows(reg) == [(1, "a"), (2, "b")]
    reg.upsert("t", new, ["k"], "b2")
    assert rows(reg) == [(1, "c"), (2, "b")]
    assert len(spark.read.text(f"{tmp_path}/t/_pointer_").collect()) == 2      # lines are added, none is lost


def test_a_project_is_forgotten_in_logs_and_in_bucketed_tables(spark, tmp_path):
    reg = Register(spark, str(tmp_path), buckets=2)
    df = spark.createDataFrame([("A", 1), ("B", 2)], "project_id string, k int")
    reg.append("finding", df, "r1")
    reg.upsert("raster_tile", df, ["project_id", "k"], "t1")
    for table in ("finding", "raster_tile"):
        reg.forget(table, "B", "c2")
        assert [tuple(r) for r in reg.read(table).collect()] == [("A", 1)]
    reg.append("finding", df.filter("k = 2"), "r2")
    assert reg.read("finding").count() == 2
