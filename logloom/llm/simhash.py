"""SimHash near-duplicates by tiled exact comparison.

Tiles hold fingerprints with the same population counts in each of ``PARTS`` equal parts
of their bits. Two fingerprints differ in at least as many bits as these counts differ in sum, so
a tile pair whose counts differ beyond the radius is skipped, and no pair within
it is lost. What remains is compared exactly, with exclusive-or and bit counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm._components import connected_components
from logloom.llm._spark import text_rows, word_blocks, written

SEED = 42
WIDTH = 3  # words of a shingle
RADIUS = 2
PARTS = 4  # parts of the 64 bits that are counted on their own; more parts make smaller tiles
TILE = 4096  # fingerprints held at once by a task; larger tiles are split


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a text; null and texts without words have 0."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for block in word_blocks((text or "").encode().lower()):
        words = tail + block
        if len(words) < width:
            tail = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.append(0, ends[:-1] + 1)
        pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        counts, total = _add(counts, [digest(joined[s:e], SEED) for s, e in pairs]), total + len(words) - width + 1
        tail = words[len(words) - width + 1 :]
    if not total and tail:
        counts, total = _add(counts, [xxhash.xxh64_intdigest(b" ".join(tail), SEED)]), 1
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


def _add(counts: np.ndarray, hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return counts + bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, row_col: str | None = None) -> DataFrame:
    """(doc_id long, fp long): the fingerprint of each row, as a signed long; with ``row_col`` (a long) also row."""
    rows = [F.col(row_col).alias("row")] if row_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_rows(batches, 256):
            fps = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps), *part.columns[2:]], ["doc_id", "fp", "row"][: part.num_columns])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *rows).mapInArrow(run, "doc_id long, fp long" + (", row long" if rows else ""))


def _steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of counts that are within the radius, first the zero, then one of each pair of opposites."""
    near = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    return [s for s in near if s >= (0,) * parts]


class _Tile:
    """The fingerprints of one tile, and which of them have been linked so far."""

    def __init__(self, own: np.ndarray, radius: int):
        self.own, self.radius = own, radius
        self.label = np.arange(len(own))  # the first fingerprint of those linked so far
        self.edges: list[tuple[int, int]] = []
        for at in range(0, len(own), 256):
            self._merge(self._near(own[at : at + 256]))

    def _near(self, some: np.ndarray) -> np.ndarray:
        return np.bitwise_count(some.view(np.uint64)[:, None] ^ self.own.view(np.uint64)[None, :]) <= self.radius

    def _merge(self, near: np.ndarray) -> None:
        """Links what is near to the same row. Each edge joins two sets, so there are fewer edges than fingerprints."""
        low = np.where(near, self.label, len(self.own)).min(axis=1, initial=len(self.own))
        for i in np.flatnonzero((near & (self.label != low[:, None])).any(axis=1)):
            first, *rest = np.unique(self.label[near[i]])
            if rest:
                self.edges += [(int(self.own[first]), int(self.own[x])) for x in rest]
                self.label[np.isin(self.label, rest)] = first

    def meet(self, guests: np.ndarray) -> None:
        """A guest gets one edge; those of the tile that it is near to are linked with each other."""
        for at in range(0, len(guests), 256):
            some = guests[at : at + 256]
            near = self._near(some)
            self._merge(near)
            hit = np.flatnonzero(near.any(axis=1))
            self.edges += zip(some[hit].tolist(), self.own[near[hit].argmax(axis=1)].tolist(), strict=True)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tile = None, [], None

        def begun() -> _Tile:
            return _Tile(np.concatenate(held), radius)

        def found(x: _Tile) -> Iterator[pa.RecordBatch]:
            if x.edges:
                a, b = np.array(x.edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                x.edges = []

        for batch in batches:
            keys, guest, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (guest[1:] != guest[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if s == e:
                    continue
                if keys[s] != key:
                    if held and tile is None:
                        tile = begun()
                    if tile is not None:
                        yield from found(tile)
                    key, held, tile = keys[s], [], None
                if not guest[s]:
                    held.append(fp[s:e])
                elif held:
                    tile = tile or begun()
                    tile.meet(fp[s:e])
                    if len(tile.edges) > 100_000:
                        yield from found(tile)
        if held and tile is None:
            tile = begun()
        if tile is not None:
            yield from found(tile)

    return run


def near_edges(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """``prints`` (fp long, distinct) to edges (a, b) that connect all pairs within ``radius`` bits.

    A pair may be left out only where other edges already connect it, so a group of n near
    fingerprints costs about n edges. A tile of more than ``tile`` fingerprints is split by hash;
    its later splits visit the earlier ones, so no task holds more than about one split.
    """
    width = 64 // parts
    base = width + 1 + 2 * radius
    mask = (1 << width) - 1 if parts > 1 else -1
    cell = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask))) + radius for i in range(parts)]
    code = lambda step: sum((c + s) * base**i for i, (c, s) in enumerate(zip(cell, step, strict=True)))
    home = prints.select("fp", code((0,) * parts).cast("long").alias("cell"))
    cells = home.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("splits"))
    steps = _steps(parts, radius)
    calls = F.array(*[F.struct(code(s).cast("long").alias("cell"), F.lit(int(any(s))).alias("guest")) for s in steps])
    dealt = prints.select("fp", F.inline(calls)).join(cells, "cell")
    split = F.pmod(F.xxhash64("fp"), F.col("splits")).cast("int")
    # In its own tile a fingerprint is at home in its split and a guest in those before it; elsewhere it is a guest in all.
    seats = dealt.withColumn("at", split).select(
        "fp", "cell", "guest", "at", F.explode(F.sequence(F.lit(0), F.when(F.col("guest") == 1, F.col("splits") - 1).otherwise(F.col("at")))).alias("seat")
    )
    guest = ((F.col("guest") == 1) | (F.col("seat") < F.col("at"))).cast("int")
    rows = seats.select((F.col("cell") * 1_000_003 + F.col("seat")).alias("key"), guest.alias("guest"), "fp")
    rows = rows.repartition("key").sortWithinPartitions("key", "guest")
    return rows.mapInArrow(_compare(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS, tile: int = TILE, width: int = WIDTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (signed), component_id.

    component_id is the smallest id that is reached over fingerprints within ``radius`` bits, the
    row's own included; rows without an id take the component of their fingerprint, null if
    it has no ids. Null, empty and wordless texts have fingerprint zero and link like any other.
    Repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    own = written(fingerprints(docs, id_col, text_col, width), "prints")
    prints = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = near_edges(prints.select("fp"), radius, parts, tile)
    reached = connected_components(edges)
    linked = written(reached.join(prints, F.col("node") == F.col("fp")).select("node", "component", "least"), "linked")
    lowest = written(linked.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("lowest")), "lowest")
    linked = linked.join(lowest, F.col("component") == F.col("of")).select("node", "lowest")
    known = prints.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("print"), F.coalesce("lowest", "least").alias("component_id"))
    known = written(known, "known")
    return own.join(known, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS, tile: int = TILE, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay.

    A wide ``radius`` needs few ``parts``: the tiles that a fingerprint visits grow with the radius to the power of the parts.
    """
    kept = simhash_components(docs, id_col, text_col, radius, parts, tile, width).where("doc_id = component_id").select("doc_id").distinct()
    match = F.col(id_col) == F.col("__kept")
    return docs.where(F.col(id_col).isNull()).unionByName(docs.join(kept.select(F.col("doc_id").alias("__kept")), match, "left_semi"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS, tile: int = TILE, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, the first written of repeated rows; rows without an id come last."""
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    own = written(fingerprints(numbered, id_col, text_col, width, "__row"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    prints = written(own.groupBy("fp").agg(first), "distinct")
    reached = connected_components(near_edges(prints.select("fp"), radius, parts, tile))
    grouped = prints.join(reached, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("of")).agg(F.min("first").alias("first"))
    kept = grouped.select(F.col("first.row").alias("__kept"))
    return numbered.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")
