"""Integrity of stored events, and Merkle batches of any size.

A tree's inner node is the SHA-256 of its children's hex digests put together; a node without a sibling is its own. Leaves
are numbered in (received_at, ingest_seq) order. Levels are built ten at a time, within groups of 1,024 neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.tables import materialised

EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # the SHA-256 of nothing
STEP = 10  # levels of a group


def line_key(*tables: DataFrame) -> list[str]:
    """What tells raw lines apart in all of these tables. The id alone has 64 bits, half of them from the text, so of many equal lines some share
    an id; with the line's number, where the tables have it, it is one line's."""
    return ["raw_event_id", *(["ingest_seq"] if all("ingest_seq" in t.columns for t in tables) else [])]


def integrity(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """Recomputes the hash of each stored event's raw line and holds it against both recorded hashes."""
    key = line_key(normalized, raw)
    kept = raw.select(*key, F.col("raw_message").alias("kept_message"), F.col("raw_hash").alias("kept_hash"))
    joined = normalized.select("event_id", *key, "raw_hash", "parser_name", "parser_version").join(kept, key, "left")
    again = F.sha2("kept_message", 256)
    verified = F.coalesce((again == F.lower("kept_hash")) & (again == F.lower("raw_hash")), F.lit(False))
    status = (
        F.when(F.col("kept_hash").isNull(), F.concat(F.lit("Raw event not found: "), F.col("raw_event_id")))
        .when(verified, "Integrity verified: the raw line gives the recorded digests")
        .otherwise("Integrity FAILED: the raw line does not give the recorded digests")
    )
    return joined.select("event_id", *key, again.alias("recomputed_hash"), verified.alias("verified"), F.octet_length("kept_message").cast("long").alias("raw_bytes"), status.alias("status_message"), "parser_name", "parser_version")


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds each row's number from zero in its group. Groups are spread over range partitions, so one of any size is no single
    task; a group's rows in a partition follow each other, and one count for each of these stretches is added up."""
    keys = [*group, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id's upper bits are the partition, its lower bits the place there; writing it down fixes both.
    kept = materialised(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__pid", F.shiftright("__at", 33))
    stretches = kept.groupBy(*group, "__pid").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select(*group, "__pid", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return kept.join(offsets, [*group, "__pid"]).withColumn(out, F.col("__offset") + F.col("__at") - F.col("__first")).select(*rows.columns, out)


def seal(raw: DataFrame, sealed: DataFrame | None = None, batch_number: int | None = None, by: Sequence[str] = ("raw_event_id",)) -> DataFrame:
    """Leaves (batch_number, leaf_index, raw_event_id, hash, ingest_seq) of a batch of all raw events that no sealed batch holds. Lines are told
    apart ``by`` their ids; where numbers stay the same from batch to batch, by ``line_key``, since ids can be shared.

    The order is total, so it is the same on every run."""
    if sealed is not None:
        raw = raw.join(sealed.select(*by), [*by], "left_anti")
        batch_number = batch_number or (sealed.agg(F.max("batch_number")).first()[0] or 0) + 1
    rows = raw.select(F.lit(batch_number or 1).cast("long").alias("batch_number"), "received_at", "ingest_seq", "raw_event_id", F.col("raw_hash").alias("hash"))
    return numbered(rows, ["batch_number"], ["received_at", "ingest_seq", "raw_event_id"], "leaf_index").select("batch_number", "leaf_index", "raw_event_id", "hash", "ingest_seq")


def one_a_batch(rows: DataFrame, tag: str) -> DataFrame:
    """Rows, one for each batch, to be joined with leaves or nodes: written, and broadcast up to 10,000 of them, so that a batch's leaves need not
    meet in one partition. Of more, Spark splits a large batch, as no sum stands below the join."""
    kept = materialised(rows, tag)
    return F.broadcast(kept) if kept.count() <= 10_000 else kept


def _parents(nodes: Column) -> Column:
    """The level above an array of nodes."""
    at = lambda i: F.coalesce(F.get(nodes, i), F.get(nodes, i - 1))
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) + 1) / 2).cast("int") - 1), lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), at(2 * i + 1)), 256))


def _levels(nodes: Column, steps: Column) -> Column:
    """All levels from the nodes up, as an array of arrays."""
    grow = lambda acc, i: F.when(i > steps, acc).otherwise(F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), F.array(nodes), grow)


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """Leaves (batch_number, leaf_index, hash) to all nodes (batch_number, level, index, hash) of their trees, leaves at level 0."""
    level = leaves.select("batch_number", F.col("leaf_index").alias("index"), "hash")
    found, height, most = [level.withColumn("level", F.lit(0))], 0, 2
    while most > 1:
        sizes = one_a_batch(level.groupBy(F.col("batch_number").alias("b")).agg(F.count("*").alias("n")), "sizes")
        groups = level.join(sizes, F.col("batch_number") == F.col("b")).groupBy("batch_number", "n", F.shiftright("index", STEP).alias("g"))
        nodes = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"]).alias("nodes"))
        # A batch of one group ends at its root; where there are more, each group is carried up all its levels.
        steps = F.when(F.col("n") > 1 << STEP, STEP).otherwise(F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))
        built = nodes.where("n > 1").select("batch_number", "g", F.posexplode(_levels(F.col("nodes"), steps)).alias("up", "row")).where("up > 0")
        built = built.select("batch_number", (F.col("up") + height).alias("level"), "g", "up", F.posexplode("row").alias("i", "hash"))
        built = built.select("batch_number", F.col("level").cast("int").alias("level"), (F.shiftleft("g", STEP) / F.pow(F.lit(2), F.col("up")) + F.col("i")).cast("long").alias("index"), "hash")
        built = materialised(built, "nodes")
        found.append(built.select("batch_number", "index", "hash", "level"))
        height += STEP
        level = built.where(F.col("level") == height).select("batch_number", "index", "hash")
        most = level.groupBy("batch_number").count().agg(F.max("count")).first()[0] or 0
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(leaves: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(batch_number, event_count, merkle_root)"""
    nodes = nodes if nodes is not None else tree_nodes(leaves)
    # A root is the first node of its level. Spark sorts for the greatest of texts, so only first nodes, one a level, are asked; leaves are counted by hash.
    top = nodes.where("`index` = 0").groupBy("batch_number").agg(F.max_by("hash", "level").alias("merkle_root"))
    counts = nodes.where("level = 0").groupBy("batch_number").agg(F.count("*").alias("event_count"))
    return top.join(counts, "batch_number", "left").select("batch_number", "event_count", "merkle_root")


def _digest(a: str, b: str) -> str:
    return hashlib.sha256((a + b).encode()).hexdigest()


def root_of(n: int, peaks: dict[int, str]) -> str:
    """The root of a tree of n leaves from its peaks, the roots of its whole subtrees by level: one for each bit of n."""
    carried, level = None, 0
    while n:
        whole = n >> level
        if whole + (carried is not None) == 1:
            return carried or peaks[level]
        if whole & 1:  # the last whole node, with the unfinished one or, without one, with itself
            carried = _digest(peaks[level], carried or peaks[level])
        elif carried is not None:
            carried = _digest(carried, carried)
        level += 1
    return EMPTY_ROOT


_PEAKS = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string())])


def _fold(level: int):
    """A group's old peaks and new nodes to its node ``STEP`` levels up, once it is whole (with an index), or to its peaks (without)."""

    def run(key, rows):
        tree, group = (k.as_py() for k in key)
        nodes = [(r["index"] is not None, r["index"] or 0, -r["level"], r["hash"]) for r in rows.to_pylist()]
        peaks: dict[int, str] = {}
        for new, _, below, node in sorted(nodes):
            at = -below
            while new and at in peaks:
                node = _digest(peaks.pop(at), node)
                at += 1
            peaks[at] = node
        whole = peaks.pop(level + STEP, None)
        out = [(tree, at, None, node) for at, node in peaks.items()] + ([(tree, level + STEP, group, whole)] if whole else [])
        return pa.Table.from_pylist([dict(zip(_PEAKS.names, r, strict=True)) for r in out], _PEAKS)

    return run


def frontier(leaves: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The frontier (tree, n, level, hash) of append-only trees: how many leaves each has, and its peaks, at most one for each level.

    ``leaves`` (tree, place, hash) come after those that ``before``, an earlier frontier, stands for; places count from 0 in each tree. Only new
    leaves and old peaks are read. Levels are built ``STEP`` at a time, within groups of 1,024 neighbours, side by side. Trees without new
    leaves stay. The roots (``frontier_roots``) are those of ``tree_nodes``, however the leaves were split into appends.
    """
    old = before if before is not None else leaves.sparkSession.createDataFrame([], "tree long, n long, level int, hash string")
    counts = old.groupBy("tree").agg(F.max("n").alias("n0"))
    added = leaves.groupBy("tree").agg(F.count("*").alias("m"))
    sizes = materialised(added.join(counts, "tree", "full").select("tree", F.coalesce("n0", F.lit(0)).alias("n0"), (F.coalesce("n0", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")), "sizes")
    nodes = leaves.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "tree").select("tree", F.lit(0).alias("level"), (F.col("n0") + F.col("place")).alias("index"), "hash")
    most, level, peaks = sizes.agg(F.max("n")).first()[0] or 0, 0, None
    while most >> level:
        # Old peaks of these levels belong to the group that was begun.
        begun = old.where((F.col("level") >= level) & (F.col("level") < level + STEP)).select("tree", "level", F.lit(None).cast("long").alias("index"), "hash", F.shiftright("n", level + STEP).alias("group"))
        grouped = nodes.withColumn("group", F.shiftright("index", STEP)).unionByName(begun).groupBy("tree", "group")
        found = materialised(grouped.applyInArrow(_fold(level), "tree long, level int, index long, hash string"), "peaks")
        kept, level = found.where("index is null").select("tree", "level", "hash"), level + STEP
        peaks, nodes = kept if peaks is None else peaks.unionByName(kept), found.where("index is not null")
    if peaks is None:
        return old
    return peaks.join(sizes.select("tree", "n"), "tree").select("tree", "n", "level", "hash")


def frontier_roots(peaks: DataFrame) -> DataFrame:
    """(tree, n, merkle_root) of a frontier."""
    root = F.udf(lambda n, found: root_of(n, {x["level"]: x["hash"] for x in found}), "string")
    gathered = peaks.groupBy("tree").agg(F.max("n").alias("n"), F.collect_list(F.struct("level", "hash")).alias("peaks"))  # one row a level
    return gathered.select("tree", "n", root("n", "peaks").alias("merkle_root"))


def empty_root() -> Column:
    return F.sha2(F.lit(""), 256)


def with_empty(sealed: DataFrame, batches: DataFrame) -> DataFrame:
    """The roots of all ``batches`` (batch_number): those without leaves have the root of nothing."""
    joined = batches.select("batch_number").distinct().join(sealed, "batch_number", "left")
    return joined.select("batch_number", F.coalesce("event_count", F.lit(0).cast("long")).alias("event_count"), F.coalesce("merkle_root", empty_root()).alias("merkle_root"))


def totals(sealed: DataFrame) -> DataFrame:
    """(batches, events): how many batches there are, and the sum of their events."""
    return sealed.agg(F.count("*").alias("batches"), F.coalesce(F.sum("event_count"), F.lit(0).cast("long")).alias("events"))


def leaf_records(leaves: DataFrame, normalized: DataFrame) -> DataFrame:
    """Each leaf with the line it stands for, and the event that was stored of it, if one was."""
    key = line_key(leaves, normalized)
    kept = normalized.select(*key, "raw_message", F.when(F.col("outcome.code") == "NORMAL", F.col("event_id")).alias("event_id"), "parser_name")
    return leaves.join(kept, key, "left").select("batch_number", "leaf_index", "hash", *key, "raw_message", "event_id", "parser_name")


def proofs_by_hash(leaves: DataFrame, wanted: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """For each wanted (batch_number, hash), in any case: the proof of the first leaf with that hash; an empty one where there is none."""
    asked = materialised(wanted.select("batch_number", F.lower("hash").alias("hash")).distinct(), "asked")  # it may cost a pass over the leaves, and two joins read it
    # The wanted hashes are met by the leaves as they are; of equal leaves the first is found before the shuffle.
    first = leaves.withColumn("hash", F.lower("hash")).join(asked, ["batch_number", "hash"], "left_semi").groupBy("batch_number", "hash").agg(F.min("leaf_index").alias("leaf_index"))
    first = materialised(first, "first-leaves")
    found = proofs(leaves, first, nodes).select("batch_number", F.lower("hash").alias("hash"), "leaf_index", "proof")
    joined = asked.join(found, ["batch_number", "hash"], "left")
    return joined.withColumn("proof", F.coalesce("proof", F.filter(F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("hash"), F.lit("").alias("side"))), lambda _: F.lit(False))))


_KIND = {"leaf": -1, "asked": -2, "above": -3}  # rows of a group beside its nodes, which have their level (0 to 9)
_ENTRY = pa.struct([("level", pa.int32()), ("hash", pa.string()), ("side", pa.string())])
_PROOF_DDL = "array<struct<level:int,hash:string,side:string>>"


def _climb(height: int):
    """A group's nodes, the places that are asked for, and the group's own path upward, to the proof of each place."""
    starts = (2 << STEP) - ((2 << STEP) >> np.arange(STEP + 1))  # of each level's slots

    def run(key, rows):
        group = key[1].as_py()
        kind, index = rows.column("kind").to_numpy(), rows.column("index").to_numpy()
        hashes, above = rows.column("hash").combine_chunks(), np.flatnonzero(kind == _KIND["above"])
        nodes, at = np.flatnonzero(kind >= 0), np.full(2 << STEP, -1)
        at[starts[kind[nodes]] + index[nodes] - (group << (STEP - kind[nodes]))] = nodes
        steps = STEP if len(above) else int(kind[nodes].max(initial=0))
        own_rows = np.flatnonzero(kind == _KIND["leaf"])
        asked = np.unique(index[kind == _KIND["asked"]])
        asked = np.intersect1d(asked, index[own_rows if height == 0 else kind == 0])  # smaller trees end below; places without a leaf have no proof
        order = own_rows[np.argsort(index[own_rows], kind="stable")]
        leaf = order[np.searchsorted(index[order], asked)] if height == 0 else np.full(len(asked), -1)
        own = (asked - (group << STEP))[:, None] >> np.arange(steps)
        other = at[starts[:steps] + (own ^ 1)]
        alone = other < 0
        sibling = np.where(alone, at[starts[:steps] + own], other).ravel()
        upper = rows.column("proof").combine_chunks().take(pa.array(above[:1])).flatten()
        n, more = len(asked), len(upper)
        side = np.where(alone | (own % 2 == 0), "RIGHT", "LEFT").ravel().astype(object)
        level = np.tile(np.arange(height, height + steps, dtype=np.int32), n)
        lower = pa.StructArray.from_arrays([pa.array(level), hashes.take(pa.array(sibling, mask=sibling < 0)), pa.array(side, pa.string())], fields=[*_ENTRY])
        every = pa.concat_arrays([lower, upper.cast(_ENTRY)])
        places = np.hstack([np.arange(n * steps).reshape(n, steps), np.broadcast_to(n * steps + np.arange(more), (n, more))]).ravel()
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (steps + more)), every.take(pa.array(places)))
        batch = rows.column("batch_number").combine_chunks()
        return pa.Table.from_arrays([batch.take(pa.array(np.zeros(n, np.int64))), pa.array(asked), hashes.take(pa.array(leaf, mask=leaf < 0)), proof], ["batch_number", "leaf_index", "hash", "proof"])

    return run


def proofs(leaves: DataFrame, wanted: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """For each wanted (batch_number, leaf_index): its hash and ``proof``, the siblings from below (level, hash, side). A node without
    a sibling has itself on its right.

    Paths are found from the top down, ``STEP`` levels at a time, in groups of 1,024 neighbours: a group's nodes, the places asked for in it and its
    own path upward meet once. So each node of a wanted group is shuffled once, however many proofs it is part of."""
    nodes = nodes if nodes is not None else tree_nodes(leaves)
    kind = leaves.schema["batch_number"].dataType.simpleString()
    c, none = F.col, F.lit(None)
    row = lambda k, index, group, hash_=none, proof=none: [c("batch_number").cast(kind).alias("batch_number"), group.cast("long").alias("group"), k.cast("int").alias("kind"), index.cast("long").alias("index"), hash_.cast("string").alias("hash"), proof.cast(_PROOF_DDL).alias("proof")]
    most = nodes.agg(F.max("level")).first()[0] or 0
    place = wanted.select("batch_number", c("leaf_index").cast("long").alias("index"))
    found = None
    for height in range(most - most % STEP, -1, -STEP):
        asked = place if height == 0 else place.select("batch_number", F.shiftright("index", height).alias("index")).distinct()
        groups = materialised(place.select(c("batch_number").alias("b"), F.shiftright("index", height + STEP).alias("group_")).distinct(), "groups")
        few = F.broadcast(groups) if groups.count() <= 200_000 else groups
        up = c("level") - height
        own = nodes.where((c("level") >= height) & (c("level") < height + STEP)).select(*row(up, c("index"), F.expr(f"shiftright(index, {STEP + height} - level)"), c("hash")))
        if height == 0:
            own = own.unionByName(leaves.select(*row(F.lit(_KIND["leaf"]), c("leaf_index"), F.shiftright("leaf_index", STEP), c("hash"))))
        rows = own.join(few, (c("batch_number") == c("b")) & (c("group") == c("group_")), "left_semi").unionByName(asked.select(*row(F.lit(_KIND["asked"]), c("index"), F.shiftright("index", STEP))).where("`group` IS NOT NULL"))
        if found is not None:
            rows = rows.unionByName(found.select(*row(F.lit(_KIND["above"]), c("leaf_index"), c("leaf_index"), proof=c("proof"))))
        found = rows.groupBy("batch_number", "group").applyInArrow(_climb(height), f"batch_number {kind}, leaf_index long, hash string, proof {_PROOF_DDL}")
        found = found if height == 0 else materialised(found, "paths")
    return found


def proof_root(leaf: Column, proof: Column) -> Column:
    """The root that a proof gives."""
    return F.aggregate(proof, leaf, lambda h, s: F.when(s["side"] == "LEFT", F.sha2(F.concat(s["hash"], h), 256)).otherwise(F.sha2(F.concat(h, s["hash"]), 256)))


def verify(proven: DataFrame, sealed: DataFrame) -> DataFrame:
    """Proofs against the roots of sealed batches, with a status text for each. What a proof gives is worked out before it meets its batch."""
    given = proven.withColumn("__root", proof_root(F.lower("hash"), F.col("proof")))
    joined = given.join(one_a_batch(sealed.select("batch_number", "merkle_root"), "sealed-roots"), "batch_number", "left")
    good = F.coalesce(F.col("__root") == F.lower("merkle_root"), F.lit(False))
    text = F.when(F.col("merkle_root").isNull(), "Batch not found").when(good, "Inclusion proof VERIFIED").otherwise("Inclusion proof FAILED")
    return joined.withColumn("verified", good).withColumn("status_message", text).drop("__root")


def inclusion(wanted: DataFrame, rows: DataFrame, leaves: DataFrame, sealed: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, batch_number, leaf_index, verified, status_message) for wanted ids, which may be those of events or of raw lines, each once; a raw id that
    lines share has a row for each of them."""
    key = line_key(rows, leaves)
    known = rows.select(F.explode(F.array_compact(F.array("event_id", "raw_event_id"))).alias("id"), *key)
    found = wanted.select("id").distinct().join(known, "id", "left").join(leaves.select(*key, "batch_number", "leaf_index"), key, "left")
    places = found.where("leaf_index is not null").select("batch_number", "leaf_index").distinct()
    proven = verify(proofs(leaves.select("batch_number", "leaf_index", "hash"), places, nodes), sealed).select("batch_number", "leaf_index", "verified", "status_message")
    joined = found.join(proven, ["batch_number", "leaf_index"], "left")
    status = (
        F.when(F.col("raw_event_id").isNull(), F.concat(F.lit("Event not found: "), F.col("id")))
        .when(F.col("leaf_index").isNull(), "Not in a batch yet")
        .otherwise(F.col("status_message"))
    )
    return joined.select("id", "batch_number", "leaf_index", F.coalesce("verified", F.lit(False)).alias("verified"), status.alias("status_message"))


def audit_bundle(sealed: DataFrame, leaves: DataFrame) -> DataFrame:
    """One JSON document for each sealed batch: what was recorded, and whether its leaves still give the root."""
    again = roots(leaves).select("batch_number", F.col("merkle_root").alias("recomputed_root"), F.col("event_count").alias("leaf_count"))
    joined = sealed.join(again, "batch_number", "left")
    body = F.struct("batch_number", "event_count", "merkle_root", "recomputed_root", (F.col("recomputed_root") == F.col("merkle_root")).alias("verified_root_matches_tree"))
    return joined.select("batch_number", F.to_json(body).alias("bundle"))
