"""Chunks of a batch, checked by a third party's own few lines, and by Spark."""

import hashlib

import pytest
from pyspark.sql import functions as F

from logloom.operators import bundles, lineage
from logloom.sources.tables import materialised

SIZES = [1, 2, 5, 1024, 1025, 3000]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def third_party(row):
    """The batch's root, from one chunk."""
    nodes = row.leaves
    for _ in range(row.level):
        nodes = [digest(nodes[i] + (nodes[i + 1] if i + 1 < len(nodes) else nodes[i])) for i in range(0, len(nodes), 2)]
    assert len(nodes) == 1 and nodes[0] == row.subtree_root
    root = nodes[0]
    for s in row.path:
        root = digest(s["hash"] + root if s["side"] == "LEFT" else root + s["hash"])
    return root


@pytest.fixture(scope="module")
def made(spark):
    rows = [(n, i, f"raw{n}-{i}", digest(f"{n}/{i}")) for n in SIZES for i in range(n)]
    leaves = materialised(spark.createDataFrame(rows, "batch_number long, leaf_index long, raw_event_id string, hash string"), "leaves")
    plain = leaves.select("batch_number", "leaf_index", "hash")
    return leaves, materialised(lineage.roots(plain), "roots"), materialised(bundles.chunks(plain), "chunks")


def test_each_chunk_proves_itself(made):
    leaves, roots, found = made
    want = {r.batch_number: r.merkle_root for r in roots.collect()}
    rows = found.collect()
    assert all(third_party(r) == want[r.batch_number] for r in rows)
    assert {n: sum(r.batch_number == n for r in rows) for n in SIZES} == {n: -(-n // 1024) for n in SIZES} and max(len(r.leaves) for r in rows) == 1024
    assert all(r.verified and r.leaf_count == r.batch_number for r in bundles.verified(found, roots).collect())


def test_a_changed_leaf_is_found_by_its_chunk(made):
    _, roots, found = made
    bent = found.withColumn("leaves", F.when((F.col("batch_number") == 3000) & (F.col("chunk") == 1), F.transform("leaves", lambda x, i: F.when(i == 7, F.sha2(x, 256)).otherwise(x))).otherwise(F.col("leaves")))
    wrong = bundles.check(bent, roots).where("not (leaves_match and path_matches)").collect()
    assert [(r.batch_number, r.chunk) for r in wrong] == [(3000, 1)]
    assert [r.batch_number for r in bundles.verified(bent, roots).where("not verified").collect()] == [3000]


def test_missing_repeated_and_empty(spark, made):
    _, roots, found = made
    lost = found.where("not (batch_number = 3000 and chunk = 1)")
    twice = found.unionByName(found.where("batch_number = 1025 and chunk = 1"))
    failed = lambda rows, sealed=roots: [r.batch_number for r in bundles.verified(rows, sealed).where("not verified").collect()]
    assert failed(lost) == [3000] and failed(twice) == [1025]
    nothing = spark.createDataFrame([(9, 0, lineage.EMPTY_ROOT)], "batch_number long, event_count long, merkle_root string")
    assert failed(found, roots.unionByName(nothing)) == [] and failed(found.limit(0), nothing) == []


def test_periods(spark, made):
    leaves, roots, _ = made
    rows = leaves.where("batch_number = 5").select("raw_event_id", F.timestamp_seconds(F.col("leaf_index") * 60).alias("received_at"))
    told = {r.batch_number: r for r in bundles.header(roots, leaves, rows).collect()}
    assert (told[5].period_end - told[5].period_start).total_seconds() == 240 and told[1].period_start is None and len(told) == len(SIZES)
