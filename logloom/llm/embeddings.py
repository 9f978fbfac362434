"""Embedding near-duplicates by int8 tile products with error bounds.

Each vector x of length one is quantised to scale * q with q in int8, and the length e of what is lost is kept. For two vectors

    |x . y - s_x s_y q_x . q_y|  <=  e_x |s_y q_y| + e_y

so only pairs whose int8 product is within that bound of the threshold, or above, may reach it; these, and no others, are
computed again in double precision. Vectors are compared within their label, tile by tile. Equal vectors are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm._components import connected_components
from logloom.llm._spark import small, written

THRESHOLD = 0.98
TILE = 2048
SLACK = 1e-9  # for the rounding of the bounds themselves


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of length one to int8 rows, their scales, the lengths of the quantised vectors and of the errors."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    q = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows. Sums over 1024 columns stay below 2**24, so single precision holds them exactly."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        total += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return total


class Vectors:
    """Vectors of one tile in double precision, and their quantised forms."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw.astype(np.float64)
        # The largest component is divided out first, so that lengths neither overflow nor vanish.
        scaled = self.raw / np.abs(self.raw).max(axis=1, keepdims=True)
        self.unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        self.q, self.scale, self.length, self.error = quantised(self.unit)


def links(a: Vectors, b: Vectors, threshold: float = THRESHOLD, block: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whether each row of that block of ``a`` links with each row of ``b``)."""
    for at in range(0, len(a.q), block):
        to = slice(at, at + block)
        near = products(a.q[to], b.q) * a.scale[to, None] * b.scale[None, :]
        bound = a.error[to, None] * b.length[None, :] + b.error[None, :] + SLACK
        i, j = np.nonzero(near + bound >= threshold)
        found = np.zeros(near.shape, bool)
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            found[x, y] = np.einsum("ij,ij->i", a.unit[to][x], b.unit[y]) >= threshold
        yield at, found


class _Sets:
    """Labels of rows; joining two sets gives one edge."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.label, self.edges = ids, np.arange(len(ids)), []

    def merge(self, found: np.ndarray, rows: np.ndarray) -> None:
        for i in np.flatnonzero(found.any(axis=1)):
            first, *rest = np.unique(np.append(self.label[found[i]], self.label[rows[i]]))
            if rest:
                self.edges += [(int(self.ids[first]), int(self.ids[x])) for x in rest]
                self.label[np.isin(self.label, rest)] = first


SELF, LOW, HIGH = 0, 1, 2  # a tile that meets itself; the two sides of a pair of tiles


def _matched(threshold: float):
    """Rows (grp, lo, hi, side, node, times, embedding), sorted by the first four, to (node, links, null) and edges (node, null, other)."""

    def compared(sides: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if sides[LOW] and not sides[HIGH] or sides[HIGH] and not sides[LOW]:
            return
        held = {s: [np.concatenate(c) for c in zip(*rows, strict=True)] for s, rows in sides.items() if rows}
        ids, times, raw = held[SELF] if SELF in held else held[LOW]
        a = Vectors(raw)
        if SELF in held:
            sets, counts = _Sets(ids), np.zeros(len(ids), np.int64)
            for at, found in links(a, a, threshold):
                rows = np.arange(at, at + len(found))
                found[np.arange(len(found)), rows] = False
                counts[rows] += found @ times
                sets.merge(found, rows)
        else:
            more, more_times, raw = held[HIGH]
            n = len(ids)
            ids = np.append(ids, more)
            sets, counts = _Sets(ids), np.zeros(len(ids), np.int64)
            for at, found in links(a, Vectors(raw), threshold):
                rows = np.arange(at, at + len(found))
                counts[rows] += found @ more_times
                counts[n:] += times[rows] @ found
                sets.merge(np.hstack([np.zeros((len(found), n), bool), found]), rows)
        used = np.flatnonzero(counts)
        one, two = [x for x, _ in sets.edges], [y for _, y in sets.edges]
        columns = ([*ids[used].tolist(), *one], [*counts[used].tolist(), *[None] * len(one)], [*[None] * len(used), *two])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat, sides = None, {SELF: [], LOW: [], HIGH: []}
        for batch in batches:
            grp, lo, hi, side, ids, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (grp, lo, hi, side)], axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if s == e:
                    continue
                if (grp[s], lo[s], hi[s]) != seat:
                    if any(sides.values()):
                        yield from compared(sides)
                    seat, sides = (grp[s], lo[s], hi[s]), {SELF: [], LOW: [], HIGH: []}
                flat = batch.column(6).slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                sides[side[s]].append((ids[s:e], times[s:e], flat))
        if any(sides.values()):
            yield from compared(sides)

    return run


def usable(vector: Column) -> Column:
    """Not null, of some length, finite and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine reaches ``threshold``. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; so do vectors of different lengths.
    n_links counts rows, so repeated rows count as often as they occur. component_id is the smallest id that is
    reached, null where there is none. An empty table gives no rows. Other columns are ignored.
    """
    kind = vectors.schema[vector_col].dataType.elementType
    vector = F.transform(F.col(vector_col), lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("v"))
    fine = F.coalesce(F.col("label").isNotNull() & usable(F.col("v")), F.lit(False))
    rows = written(rows.withColumn("fine", fine), "vectors")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    # A class is all rows of equal label and vector; it is numbered as it is written.
    classes = rows.where("fine").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("times"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    split = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("splits"))
    split = written(split.withColumn("grp", F.monotonically_increasing_id()), "splits")
    dealt = classes.join(small(split, 10_000), ["label", "dim"]).withColumn("at", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int"))
    seats = dealt.select("grp", "at", "node", "times", "v", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("with"))
    seat = ["grp", "lo", "hi"]
    side = F.when(F.col("at") == F.col("with"), SELF).when(F.col("at") < F.col("with"), LOW).otherwise(HIGH)
    seats = seats.select("grp", F.least("at", "with").alias("lo"), F.greatest("at", "with").alias("hi"), side.alias("side"), "node", "times", "v")
    seats = seats.repartition(*seat).sortWithinPartitions(*seat, "side")
    found = written(seats.mapInArrow(_matched(threshold), "node bigint, links bigint, other bigint"), "links")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    reached = written(reached.join(classes.select("node", "least"), "node"), "reached")
    lowest = written(reached.groupBy("component").agg(F.min("least").alias("lowest")), "lowest")
    reached = reached.join(lowest, "component").select("node", "lowest")
    known = classes.join(counts, "node", "left").join(reached, "node", "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("lowest", "least").alias("component_id")
    )
    known = written(known, "known")
    members = rows.where("fine").join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("id", "n_links", "component_id")
    return members.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
