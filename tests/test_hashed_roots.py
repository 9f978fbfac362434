"""How the roots of trees are found."""

from logloom.operators import lineage
from logloom.sources.tables import materialised


def test_roots_sort_first_nodes_only(spark):
    """The greatest of texts is found by sorting: of one node a level, not of all nodes as before."""
    leaves = spark.createDataFrame([(b, i, f"{b}-{i}") for b, n in ((1, 1), (2, 5), (3, 2_100)) for i in range(n)], "batch_number long, leaf_index long, hash string")
    nodes = materialised(lineage.tree_nodes(leaves), "tree")
    found = lineage.roots(leaves, nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") <= 2 and "EqualTo(index,0)" in plan
    top = {r.batch_number: r.hash for r in nodes.orderBy("level").collect()}
    assert {r.batch_number: (r.event_count, r.merkle_root) for r in found.collect()} == {b: (n, top[b]) for b, n in ((1, 1), (2, 5), (3, 2_100))}
