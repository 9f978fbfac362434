"""Connected components by alternating star contractions (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm._spark import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 100_000_007), F.sum(F.xxhash64("b") % 100_000_007)).first()
    return tuple(row)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) to (node long, component long): every node that has an edge,
    and the smallest node that it reaches.

    A round joins each edge with the smallest neighbour of its end. The smallest neighbours are summed up before the shuffle and
    written before they are joined, so that Spark can split the partitions of hot nodes. The edges never leave the executors;
    the driver sees a count and two sums a round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = written(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "lowest")
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        large = written(large.distinct(), "large")
        low = written(large.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m")), "lowest")
        rest = large.join(low, F.col("a") == F.col("w")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(rest.union(low.select("w", "m")).distinct(), "edges")
        last, mark = mark, _mark(e)
        if last == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
