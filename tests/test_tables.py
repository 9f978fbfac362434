"""Tables that are written whole, and tables of which only touched buckets are written."""

import pytest
from pyspark.sql import functions as F

from logloom.sources import tables


def rows_at(spark, path):
    return {r.k: r.v for r in tables.current(spark, path).collect()}


def test_upsert(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "record")
    assert tables.current(spark, path) is None
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    assert len(tables.upsert(rows, path, ["k"])) == 64
    want = dict.fromkeys(range(20_000), 0)
    changed = spark.createDataFrame([(5, 1), (900, 1), (20_001, 1), (None, 7)], "k long, v int")
    assert len(tables.upsert(changed, path, ["k"])) <= 4
    want |= {5: 1, 900: 1, 20_001: 1, None: 7}
    assert rows_at(spark, path) == want and tables.current(spark, path).count() == len(want)
    assert {r.k: r.v for r in tables.touching(changed, path, ["k"]).collect()} == {5: 1, 900: 1, 20_001: 1, None: 7}
    # A run that breaks off before the pointer shows the state before, and harms no later run.
    monkeypatch.setattr(tables, "_write_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.upsert(spark.createDataFrame([(5, 2)], "k long, v int"), path, ["k"])
    monkeypatch.undo()
    assert rows_at(spark, path) == want
    before = len(tables.names(spark, path))
    for v in (3, 4, 5):
        tables.upsert(spark.createDataFrame([(5, v), (5, v + 10)], "k long, v int").limit(1), path, ["k"])
    assert rows_at(spark, path) == want | {5: 5}
    assert sum(len(tables.names(spark, f"{path}/{v}")) for v in tables.names(spark, path) if v.startswith("version=")) <= 64 + 64 + 4 and before
    assert tables.upsert(changed.limit(0), path, ["k"]) == []


def test_put_and_ledger(spark, tmp_path):
    """A folder is replaced whole; a run's ledger lines are there once, however often it runs."""
    path = str(tmp_path / "t" / "batch=1")
    for n in (3, 2):
        tables.put(spark.range(n), path)
        assert spark.read.parquet(path).count() == n and tables.names(spark, str(tmp_path / "t")) == ["batch=1"]
    for _ in range(2):
        tables.append_ledger(spark.range(2), str(tmp_path / "ledger"), 7)
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2
    tables.append_ledger(spark.range(1), str(tmp_path / "ledger"), 8)
    assert spark.read.json(str(tmp_path / "ledger")).count() == 3
