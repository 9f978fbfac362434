"""Running totals over groups of any size.

A window over a group puts the whole group into one task. Here rows are range-partitioned by
group and order, each partition sums what it holds, and only one row for each partition is
carried over: a group with a third of all rows spreads over as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm._spark import partitions, written


def _local_totals(group: list[str], measure: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = False
            for g in group:
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(g)[0].as_py() for g in group)
            value = batch.column(measure).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(value) - value
            starts = np.flatnonzero(new)
            base = np.repeat(before[starts], np.diff(np.append(starts, n)))
            local = before - base
            if first == last:
                end = starts[1] if len(starts) > 1 else n
                local[:end] += carried
            last = tuple(batch.column(g)[n - 1].as_py() for g in group)
            carried = int(local[-1] + value[-1])
            yield batch.append_column(out, pa.array(local, pa.int64()))

    return run


def running_totals(df: DataFrame, group: list[str], order: list[str], measure: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``measure`` (a long, not null) over the rows of the same group that
    come before in ``order``. Null groups are a group. ``order`` should name the rows uniquely;
    equal rows stay together in one partition, in any order.

    Each partition continues at most one group of the partition before it, so what is
    carried, and broadcast, has at most a row for each partition.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in [*group, *order]]
    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = ranged.mapInArrow(_local_totals(group, measure, "__local"), f"{schema}, __local bigint")
    kept = written(local.withColumn("__pid", F.spark_partition_id()), "scan")
    sums = kept.groupBy(*group, "__pid").agg(F.sum(measure).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("__base", F.sum("__sum").over(before)).where("__base is not null")
    carried = carried.select(F.col("__pid").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__base")
    same = F.col("__pid") == F.col("__p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = kept.join(F.broadcast(carried), same, "left")
    return joined.select(*df.columns, (F.col("__local") + F.coalesce("__base", F.lit(0))).alias(out))
