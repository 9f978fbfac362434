"""Audit bundles that a third party can check: all leaves of a batch, in chunks that each prove their place in the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.lineage import STEP, _parents, line_key, one_a_batch, proof_root, proofs, tree_nodes

CHUNK = 1 << STEP


def chunks(leaves: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(batch_number, chunk, first_leaf, leaves, level, subtree_root, path): each 1,024 neighbours of a batch, the root of the subtree that they are
    ``level`` levels below, and its siblings from there to the batch's root. A batch of fewer leaves is one chunk, with an empty path. No row
    holds more than 1,024 leaves. Batches without leaves have no chunk."""
    nodes = nodes if nodes is not None else tree_nodes(leaves)
    height = one_a_batch(nodes.groupBy("batch_number").agg(F.least(F.max("level"), F.lit(STEP)).alias("base")), "bases")
    above = nodes.join(height, "batch_number").where(F.col("level") >= F.col("base")).select("batch_number", (F.col("level") - F.col("base")).alias("level"), "index", "hash")
    tops = above.where("level = 0").select("batch_number", F.col("index").alias("leaf_index"), "hash")
    paths = proofs(tops, tops, above).select("batch_number", F.col("leaf_index").alias("chunk"), F.col("hash").alias("subtree_root"), F.col("proof").alias("path"))
    listed = leaves.groupBy("batch_number", F.shiftright("leaf_index", STEP).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_index", "hash"))), lambda x: x["hash"]).alias("leaves"))
    joined = listed.join(paths, ["batch_number", "chunk"]).join(height, "batch_number")
    return joined.select("batch_number", "chunk", (F.col("chunk") * CHUNK).alias("first_leaf"), "leaves", F.col("base").alias("level"), "subtree_root", "path")


def header(sealed: DataFrame, leaves: DataFrame, rows: DataFrame) -> DataFrame:
    """(batch_number, event_count, merkle_root, period_start, period_end): a batch and the times between which its lines (raw_event_id, received_at)
    came; null where none of them is known."""
    period = leaves.join(rows.select(*(key := line_key(leaves, rows)), "received_at"), key).groupBy("batch_number").agg(F.min("received_at").alias("period_start"), F.max("received_at").alias("period_end"))
    return sealed.select("batch_number", "event_count", "merkle_root").join(period, "batch_number", "left")


def subtree_root(leaves: Column, level: Column) -> Column:
    """The node ``level`` levels above an array of leaves."""
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), F.transform(leaves, F.lower), lambda acc, i: F.when(i > level, acc).otherwise(_parents(acc))), 0)


def check(found: DataFrame, sealed: DataFrame) -> DataFrame:
    """(batch_number, chunk, leaf_count, leaves_match, path_matches): whether a chunk's leaves give its recorded subtree root, and whether what they
    give leads to the batch's root. Each chunk is checked by itself, so one that is changed is found without the others."""
    joined = found.join(sealed.select("batch_number", "merkle_root"), "batch_number", "left").withColumn("again", subtree_root(F.col("leaves"), F.col("level")))
    true = lambda x: F.coalesce(x, F.lit(False))
    return joined.select(
        "batch_number", "chunk", F.size("leaves").cast("long").alias("leaf_count"), true(F.col("again") == F.lower("subtree_root")).alias("leaves_match"), true(proof_root(F.col("again"), F.col("path")) == F.lower("merkle_root")).alias("path_matches")
    )


def verified(found: DataFrame, sealed: DataFrame) -> DataFrame:
    """(batch_number, leaf_count, verified): sealed batches whose chunks are all there, once, and all right, with as many leaves as were sealed. An
    empty batch is verified if it has no chunk."""
    told = check(found, sealed).groupBy("batch_number").agg(
        F.sum("leaf_count").alias("leaf_count"), F.count_distinct("chunk").alias("kinds"), F.count("*").alias("rows"), F.max("chunk").alias("last"), F.every(F.col("leaves_match") & F.col("path_matches")).alias("right")
    )
    whole = F.col("right") & (F.col("kinds") == F.col("rows")) & (F.col("last") + 1 == F.col("rows"))
    joined = sealed.select("batch_number", "event_count").join(told, "batch_number", "left").withColumn("leaf_count", F.coalesce("leaf_count", F.lit(0).cast("long")))
    return joined.select("batch_number", "leaf_count", (F.coalesce(whole, F.lit(True)) & (F.col("leaf_count") == F.col("event_count"))).alias("verified"))
