"""Sharding by longest-processing-time scheduling.

Rows with equal texts are a group and stay together. Groups, the largest first, go to the least-loaded shard through a
heap. So that this scales, it runs in two steps of the same rule. Groups of at least one part in ``HEADS`` of
all bytes, of which there are at most ``HEADS``, are items of their own. All others are dealt by hash into buckets,
and in each bucket a heap packs them, the largest first, into ``BINS`` bins of nearly equal size. Then one heap
deals the items, large groups and bins, to the shards: at most ``HEADS`` + buckets * ``BINS`` of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm._scan import running_totals
from logloom.llm._spark import partitions, written

SHARDS = 16
HEADS = 4096
BINS = 32
BUCKETS = 1024  # fixed, so that shards don't depend on the session; the driver sees at most HEADS + BUCKETS * BINS items


def longest_first(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """(size, name) to the shard of each name. Equal sizes go by name; of equally loaded shards the lowest takes."""
    heap, found = [(0, s) for s in range(shards)], {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        found[name] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return found


def _bins(bins: int):
    """Rows (bucket, size, group), sorted by bucket and falling size, to (group, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, heap = None, []
        for batch in batches:
            items = []
            for b, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket:
                    bucket, heap = b, [(0, i) for i in range(bins)]
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                items.append(b * bins + i)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(items, pa.int64())], ["grp", "bytes", "item"])

    return run


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", heads: int = HEADS, bins: int = BINS) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, shard (0 ..), slot (its place in the shard, gapless from 0, by id).

    size is the UTF-8 bytes of the text plus one. Null texts have none and are a group of their own; empty texts are another.
    A group that is larger than a shard's fair part makes its shard larger, since it stays together. Rows that are equal
    in id and text take the slots next to each other. Null ids come first in their shard. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("grp"),
    )
    rows = written(rows, "sized")
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    floor = max(1, -(-total // heads))
    head = groups.where(F.col("bytes") >= floor)
    tail = groups.where(F.col("bytes") < floor).select(F.pmod(F.xxhash64("grp"), F.lit(BUCKETS)).cast("int").alias("bucket"), "bytes", "grp")
    tail = tail.repartition(min(BUCKETS, partitions(spark)), "bucket").sortWithinPartitions("bucket", F.desc("bytes"), "grp")
    binned = written(tail.mapInArrow(_bins(bins), "grp string, bytes bigint, item bigint"), "bins")
    items = [(r.bytes, f"bin {r.item:012d}") for r in binned.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()]
    items += [(r.bytes, r.grp) for r in head.collect()]
    placed = longest_first(items, shards)
    by_bin = [(int(k[4:]), s) for k, s in placed.items() if k.startswith("bin ")]
    by_head = [(k, s) for k, s in placed.items() if not k.startswith("bin ")]
    binned = binned.join(F.broadcast(spark.createDataFrame(by_bin, "item bigint, shard int")), "item").select("grp", "shard")
    home = binned.unionByName(spark.createDataFrame(by_head, "grp string, shard int"))
    dealt = rows.join(home, "grp").select("doc_id", "size", "text_crc32", "shard", "grp", F.lit(1).cast("long").alias("one"))
    return running_totals(dealt, ["shard"], ["doc_id", "grp"], "one", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
