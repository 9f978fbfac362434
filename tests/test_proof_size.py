"""What proofs of all leaves shuffle grows with the nodes, not with the levels of each proof."""

from pyspark.sql import functions as F

from logloom.operators import lineage
from logloom.sources.tables import materialised


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_node_is_shuffled_once(spark):
    leaves = materialised(spark.range(5_000).select(F.lit(1).cast("long").alias("batch_number"), F.col("id").alias("leaf_index"), F.sha2(F.col("id").cast("string"), 256).alias("hash")), "leaves")
    nodes = materialised(lineage.tree_nodes(leaves), "nodes")
    roots = materialised(lineage.roots(leaves, nodes), "roots")
    before, bound = shuffled(spark), {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the leaves were too many to be broadcast
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lineage.verify(lineage.proofs(leaves, leaves, nodes), roots).agg(F.count(F.when(F.col("verified"), 1)).alias("n"), F.max(F.size("proof")).alias("levels")).first()
    finally:
        for c, v in bound.items():
            spark.conf.set(c, v)
    assert (found.n, found.levels) == (5_000, 13)
    assert shuffled(spark) - before < 6 * 5_000


def test_places_apart(spark):
    """Proofs of some places, of trees of unlike height: those of places without a leaf are left out."""
    leaves = spark.createDataFrame([(n, i, f"{n}-{i}") for n in (1, 1024, 1030) for i in range(n)], "batch_number long, leaf_index long, hash string").withColumn("hash", F.sha2("hash", 256))
    wanted = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1024, 1023), (1030, 1029), (1030, 1030), (1030, None), (7, 0)], "batch_number long, leaf_index long")
    found = lineage.verify(lineage.proofs(leaves, wanted), lineage.roots(leaves)).collect()
    assert sorted((r.batch_number, r.leaf_index, len(r.proof), r.verified) for r in found) == [(1, 0, 0, True), (1024, 1023, 10, True), (1030, 1029, 11, True)]
