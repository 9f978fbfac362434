"""Lookups read a small part of a table, and pages by key cost alike, by what the scans report."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import search
from logloom.sources import clustered

N = 200_000


def scanned(df):
    """(rows, how many rows the scan gave on)"""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return rows, sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered"))
    ip = lambda salt: F.concat_ws(".", F.lit("10"), *[F.pmod(F.xxhash64("id", F.lit(salt + k)), F.lit(250)).cast("string") for k in range(3)])
    rows = spark.range(N).select(
        F.col("id").alias("ingest_seq"), F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 256).alias("raw_event_id"),
        F.struct(ip(1).alias("ip")).alias("source"), F.struct(ip(5).alias("ip")).alias("destination"),
        F.timestamp_seconds(1_767_225_600 + F.pmod(F.xxhash64("id"), F.lit(86_400 * 5))).alias("timestamp_utc"),
    )
    clustered.store(rows, path, files=20, block=256 << 10)
    return path


def test_point_lookups_open_few_row_groups(spark, table):
    rows = clustered.rows_of(spark, table)
    some = rows.where("ingest_seq = 77").first()
    for column, value in [("event_id", some.event_id), ("raw_event_id", some.raw_event_id)]:
        found, read = scanned(search.by_id(rows, column, value))
        assert [r.ingest_seq for r in found] == [77] and read <= N * 0.05
    found, read = scanned(search.search_events(rows, source_ip=some.source.ip))
    assert 77 in [r.ingest_seq for r in found] and read <= N * 0.05
    assert scanned(search.by_id(rows, "event_id", "none"))[0] == []


def test_times_open_their_files(spark, table):
    start = datetime(2026, 1, 3)
    found, read = scanned(search.search_events(clustered.rows_of(spark, table), since=start, until=start + timedelta(minutes=10)))
    assert 0 < len(found) <= read <= N * 0.05


def test_page_thousand_costs_what_the_first_costs(spark, table):
    rows = clustered.rows_of(spark, table)
    order = rows.orderBy(F.desc("timestamp_utc"), F.desc("ingest_seq")).select("timestamp_utc", "ingest_seq").collect()
    assert clustered.total(spark, table) == N == len(order)
    first, read = scanned(clustered.page(spark, table))
    assert [r.ingest_seq for r in first] == [r.ingest_seq for r in order[:25]]
    at = order[25 * 1000 - 1]
    late, read_late = scanned(clustered.page(spark, table, (at.timestamp_utc, at.ingest_seq)))
    assert [r.ingest_seq for r in late] == [r.ingest_seq for r in order[25_000:25_025]]
    assert read_late <= 2 * read + 5_000 <= N * 0.2


def test_pages_over_ties_and_ends(spark, tmp_path):
    """Many rows of one second and of one minute, null times, no rows: all pages are the order, cut."""
    rng, path, start = random.Random(3), str(tmp_path / "t"), datetime(2026, 1, 1)
    data = [(i, "e", "r", ("1.1.1.1",), ("2.2.2.2",), start + timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 600, 86_400]))) for i in range(200)] + [(200, "e", "r", None, None, None)]
    frame = spark.createDataFrame(data, "ingest_seq long, event_id string, raw_event_id string, source struct<ip:string>, destination struct<ip:string>, timestamp_utc timestamp")
    clustered.store(frame, path, files=3)
    want = [d[0] for d in sorted((d for d in data if d[5]), key=lambda d: (d[5], d[0]), reverse=True)]
    got, before = [], None
    while rows := clustered.page(spark, path, before, 30).collect():
        got, before = got + [r.ingest_seq for r in rows], (rows[-1].timestamp_utc, rows[-1].ingest_seq)
    assert got == want
    clustered.store(frame.limit(0), path)
    assert clustered.page(spark, path).collect() == [] and clustered.total(spark, path) == 0
