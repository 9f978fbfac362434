"""Trees that grow: roots from peaks against those of whole trees, under any split into appends."""

import hashlib
import random

from pyspark.sql import functions as F

from logloom.operators import lineage


def whole_root(nodes):
    while len(nodes) > 1:
        nodes = [lineage._digest(nodes[i], nodes[min(i + 1, len(nodes) - 1)]) for i in range(0, len(nodes), 2)]
    return nodes[0] if nodes else lineage.EMPTY_ROOT


def test_roots_of_every_size():
    """Peaks kept leaf by leaf give the root of the whole tree at every size to 3,000."""
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    peaks, levels = {}, []
    for n, leaf in enumerate(leaves, 1):
        at, node = 0, leaf
        while at in peaks:
            node, at = lineage._digest(peaks.pop(at), node), at + 1
        peaks[at] = node
        if n < 300 or n % 97 < 2 or n in (1023, 1024, 1025, 2047, 2048, 2049, 3000):
            assert lineage.root_of(n, peaks) == whole_root(leaves[:n])
            levels.append(len(peaks))
    assert lineage.root_of(0, {}) == lineage.EMPTY_ROOT and max(levels) == 11


def test_appends_in_any_split(spark):
    """Several trees at once, appends of no leaf to thousands; roots equal those of ``tree_nodes``."""
    rng, sizes, held, frontier = random.Random(7), {}, [], None
    for step in range(4):
        new = []
        for tree in (1, 2, 3, 9):
            n = rng.choice([0, 1, 7, 900, 1024, 1500]) if tree != 9 else 2100 * (step == 1)
            new += [(tree, i, hashlib.sha256(f"{tree} {sizes.get(tree, 0) + i}".encode()).hexdigest()) for i in range(n)]
            held += [(tree, sizes.get(tree, 0) + i, h) for t, i, h in new if t == tree]
            sizes[tree] = sizes.get(tree, 0) + n
        rows = spark.createDataFrame(new, "tree long, place long, hash string")
        frontier = lineage.materialised(lineage.frontier(rows, frontier), "frontier")
        got = {r.tree: (r.n, r.merkle_root) for r in lineage.frontier_roots(frontier).collect()}
        all_leaves = spark.createDataFrame(held, "batch_number long, leaf_index long, hash string")
        want = {r.batch_number: (r.event_count, r.merkle_root) for r in lineage.roots(all_leaves).collect()}
        assert got == want
        assert frontier.groupBy("tree").agg((F.count("*") == F.max(F.bit_count("n"))).alias("ok")).where("not ok").count() == 0
