"""A prefix trie of conversations, built by adaptive radix trees.

A turn (role, text) is a big-endian id of 16 bytes, a conversation the bytes of its turns' ids, one after the other. Conversations are
sorted by these bytes over range partitions; each task puts slices of bounded size into adaptive radix trees and emits a node for each
depth at which a turn ends, whatever the tree has compressed. Nodes that a slice shares with its neighbours are partial rows, added up
afterwards. So no turn, however common, and no group of equal conversations has to fit a task. Conversations longer than a band are cut
into bands, worked on from the deepest up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm._scan import running_totals
from logloom.llm._spark import partitions, written

WIDTH = 16
#: Turns of a band; a conversation has one row for each.
BAND = 4096
#: Key bytes of a radix tree.
SLICE = 4 << 20
#: Conversation ids of a piece of text to be hashed.
CHUNK = 1 << 16
ROOT = bytes(WIDTH)
EMPTY = hashlib.sha256(b"").hexdigest()

FINAL, PARTIAL, HANGING, BORDER, ENDS = range(5)
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary())]
    + [(c, pa.int64()) for c in ("depth", "low", "parent_low", "n_convs", "n_children", "n_leaves", "saved")]
    + [("ends", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("chars", pa.list_(pa.int64()))]
)
_DDL = "kind int, node binary, parent binary, depth bigint, low bigint, parent_low bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, part bigint, at bigint, first binary, last binary, chars array<bigint>"


class Node:
    """A node of an adaptive radix tree: the bytes that all keys below share, the value of a key that ends after them, and children by next byte.

    Up to 16 children have sorted bytes beside them (the list's room grows from 4 to 16), up to 48 an index of 256 places, more an array of 256.
    """

    __slots__ = ("index", "kids", "layout", "shared", "value")

    def __init__(self, shared: bytes, value: int | None = None):
        self.shared, self.value, self.layout, self.index, self.kids = shared, value, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def add(self, byte: int, node: Node) -> None:
        """A child for a byte that has none."""
        if self.layout <= 16 and len(self.kids) == self.layout:
            self._grow()
        elif self.layout == 48 and len(self.kids) == 48:
            self.layout, self.kids = 256, [self.child(b) for b in range(256)]
        if self.layout <= 16:
            at = next((i for i, b in enumerate(self.index) if b > byte), len(self.index))
            self.index.insert(at, byte)
            self.kids.insert(at, node)
        elif self.layout == 48:
            self.kids.append(node)
            self.index[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
            return
        places = bytearray(256)
        for i, byte in enumerate(self.index):
            places[byte] = i + 1
        self.layout, self.index = 48, places

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.layout <= 16:
            return self.kids
        if self.layout == 48:
            return [self.kids[at - 1] for at in self.index if at]
        return [k for k in self.kids if k]

    def split(self, at: int) -> None:
        """Only the first ``at`` shared bytes stay here, the rest goes to a child."""
        lower = Node(self.shared[at + 1 :], self.value)
        lower.layout, lower.index, lower.kids = self.layout, self.index, self.kids
        byte, self.shared, self.value = self.shared[at], self.shared[:at], None
        self.layout, self.index, self.kids = 4, bytearray([byte]), [lower]


def common(a: bytes, b: bytes) -> int:
    """How many bytes two keys begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def insert(tree: Node, key: bytes, value: int) -> None:
    node, at = tree, 0
    while True:
        alike = common(node.shared, key[at : at + len(node.shared)])
        if alike < len(node.shared):
            node.split(alike)
        at += alike
        if at == len(key):
            node.value = value
            return
        below = node.child(key[at])
        if below is None:
            node.add(key[at], Node(key[at + 1 :], value))
            return
        node, at = below, at + 1


class Entry:
    """A distinct key: how many conversations have it, the smallest of them, code points by turn, what hangs below it in the next band."""

    __slots__ = ("below", "chars", "chunks", "ends", "ids", "key", "low", "n")

    def __init__(self, key: bytes, chars: list[int]):
        self.key, self.chars, self.n, self.low = key, chars, 0, None
        self.ids, self.chunks, self.ends, self.below = [], 0, None, None


def node_id(key: bytes) -> bytes:
    """The id of the node that a key (its band's node, then turn ids) leads to."""
    if len(key) == WIDTH:
        return key
    return hashlib.sha256(key[:WIDTH] + hashlib.sha256(key[WIDTH:]).digest()).digest()[:WIDTH]


def _path_ids(key: bytes, most: int) -> dict[int, bytes]:
    """Ids of the nodes on the way to a key, by depth in bytes."""
    out, running = {WIDTH: key[:WIDTH]}, hashlib.sha256()
    for at in range(WIDTH, most, WIDTH):
        running.update(key[at : at + WIDTH])
        out[at + WIDTH] = hashlib.sha256(key[:WIDTH] + running.digest()).digest()[:WIDTH]
    return out


def _row(kind: int, **values) -> tuple:
    return tuple({"kind": kind, **values}.get(name) for name in _SCHEMA.names)


def _aligned(depth: int) -> int:
    return depth - depth % WIDTH


def slice_rows(entries: list[Entry], before: bytes | None, after: bytes | None, first_depth: int) -> Iterator[tuple]:
    """The nodes of sorted distinct keys. ``before`` and ``after`` are the neighbouring keys of the same task, None at its borders, where every node of
    the way may be shared. What the slice before has counted isn't counted again."""
    tree = Node(b"")
    for i, e in enumerate(entries):
        insert(tree, e.key, i)
    first, last, end = entries[0].key, entries[-1].key, len(entries) - 1
    counted = _aligned(common(before, first)) if before is not None else 0
    left = counted if before is not None else len(first)
    right = _aligned(common(after, last)) if after is not None else len(last)
    extended = after is not None and right == len(last)
    names = {0: _path_ids(first, left), end: _path_ids(last, right)} if end else {0: _path_ids(first, max(left, right))}
    done: dict[int, tuple] = {}
    stack = [(tree, 0, False)]
    while stack:
        node, start, ready = stack.pop()
        stop = start + len(node.shared)
        if not ready:
            stack.append((node, start, True))
            stack += [(k, stop + 1, False) for k in node.children()]
            continue
        parts = [done.pop(id(k)) for k in node.children()]
        i, j = (parts[0][0], parts[-1][1]) if parts else (node.value, node.value)
        n, lows, leaves, saved = sum(p[2] for p in parts), [p[3] for p in parts], sum(p[4] for p in parts), sum(p[5] for p in parts)
        tops = [t for p in parts for t in p[6]]
        here = None
        if node.value is not None:
            here, i = entries[node.value], node.value
            n, lows = n + here.n, [*lows, here.low]
        low = min(lows)
        chars = entries[i].chars
        for depth in range(_aligned(stop), max(start, WIDTH) - 1, -WIDTH):
            ends_here = here is not None and depth == stop
            children = len(tops) - (bool(tops) and i == 0 and depth + WIDTH <= counted)
            if ends_here and here.below:
                children, leaves, saved = children + here.below[0], leaves + here.below[1], saved + here.below[2]
            elif ends_here and not tops and not (extended and j == end):
                leaves += 1
            own = chars[depth // WIDTH - 2] if depth > WIDTH else 0
            saved += n * own - (0 if i == 0 and depth <= counted else own)
            name = names[0].get(depth) if i == 0 and depth <= max(left, right if not end else 0) else names[end].get(depth) if j == end and depth <= right else None
            if name is None and (depth == WIDTH or (ends_here and (here.below or here.chunks))):
                name = node_id(entries[i].key[:depth])
            top = dict(node=name, depth=first_depth + depth // WIDTH - 1, low=low, n_convs=n, n_children=children, n_leaves=leaves, saved=saved, ends=here.ends if ends_here else None)
            yield from (_linked(t, top) for t in tops)
            tops = [top]
        done[id(node)] = (i, j, n, low, leaves, saved, tops)
    yield from (_linked(t, None) for t in done.pop(id(tree))[6])


def _linked(top: dict, parent: dict | None) -> tuple:
    """A node's row: partial if it has an id, else final, or hanging at a parent that is partial. ``parent_low`` is that of a final parent."""
    whole = parent is not None and parent["node"] is None
    kind = PARTIAL if top["node"] is not None else FINAL if whole else HANGING
    return _row(kind, parent=parent and parent["node"], parent_low=parent["low"] if whole else None, **top)


def _nodes(first_depth: int, slice_bytes: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        entries: list[Entry] = []
        out: list[tuple] = []
        entry, before, first, size = None, None, None, 0

        def flush(e: Entry) -> None:
            out.append(_row(ENDS, node=node_id(e.key), part=part, at=e.chunks, ends=",".join(map(str, e.ids))))
            e.chunks, e.ids = e.chunks + 1, []

        def close(e: Entry, border: bool) -> None:
            """Hashes the ids of a key; those of a key that goes on in another task are hashed later."""
            if e.ids and (border or e.chunks):
                flush(e)
            elif e.ids:
                e.ends, e.ids = hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), []

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
            out.clear()
            return rows

        for rows in batches:
            columns = [rows.column(c) for c in ("prefix", "key", "conv_id", "ended", "chars", "n_children", "n_leaves", "saved")]
            for i in range(rows.num_rows):
                key = columns[0][i].as_py() + columns[1][i].as_py()
                if entry is None or key != entry.key:
                    if entry is not None:
                        close(entry, entry.key == first)
                        if size >= slice_bytes:
                            out += slice_rows(entries, before, key, first_depth)
                            before, entries, size = entry.key, [], 0
                            yield batch()
                    entry = Entry(key, columns[4][i].as_py())
                    entries.append(entry)
                    first, size = first or key, size + len(key)
                conv = columns[2][i].as_py()
                entry.n, entry.low = entry.n + 1, conv if entry.low is None else min(conv, entry.low)
                if columns[3][i].as_py():
                    entry.ids.append(conv)
                    if len(entry.ids) >= chunk:
                        flush(entry)
                else:
                    entry.below = tuple(c[i].as_py() for c in columns[5:])
        if entry is not None:
            close(entry, True)
            out += slice_rows(entries, before, None, first_depth)
            below = entry.below or (None, None, None)
            out.append(_row(BORDER, part=part, first=first, last=entry.key, chars=entry.chars, n_children=below[0], n_leaves=below[1], saved=below[2]))
            yield batch()

    return run


def border_rows(last: bytes, chars: list[int], below: tuple | None, first: bytes, first_depth: int) -> Iterator[tuple]:
    """What to add where two tasks have counted the same nodes: those on the way to the one's last and the other's first key."""
    alike = _aligned(common(last, first))
    if alike < WIDTH:
        return
    ended = alike == len(last)  # as a leaf, or with what hangs below it, it was counted too early
    names = _path_ids(last, alike)
    leaves = -(below[1] if below else 1) if ended else 0
    saved = -below[2] if ended and below else 0
    for depth in range(alike, 0, -WIDTH):
        saved += chars[depth // WIDTH - 2] if depth > WIDTH else 0
        children = -1 if depth < alike else -below[0] if ended and below else 0
        yield _row(PARTIAL, node=names[depth], n_convs=0, n_children=children, n_leaves=leaves, saved=saved)


def _borders(first_depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                below = (r["n_children"], r["n_leaves"], r["saved"]) if r["n_leaves"] is not None else None
                rows = list(border_rows(r["last"], r["chars"], below, r["next"], first_depth))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of text of a node, which come in order."""
    name, running, out = None, None, []
    for node, text in chain.from_iterable(zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True) for b in batches):
        if node != name:
            if name is not None:
                out.append((name, running.hexdigest()))
            name, running, separator = node, hashlib.sha256(), b""
        running.update(separator + text.encode())
        separator = b","
    if name is not None:
        out.append((name, running.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())], names=["id", "all_ends"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node at which each further band of a conversation begins. Bands come in order."""
    conv, node = None, ROOT
    for batch in batches:
        out = []
        for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            node = ROOT if c != conv else node
            conv, node = c, hashlib.sha256(node + digest).digest()[:WIDTH]
            out.append(node)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("band"), pa.array(out, pa.binary())], names=["c", "b", "after"])


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), id (hex of 16 bytes), chars of each turn, ordered by turn number, null first, then by id.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. Ranks are running totals over
    range partitions, so a conversation may hold any share of the rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", name.alias("id"), F.char_length(text).cast("bigint").alias("chars"), F.lit(1).cast("bigint").alias("one"))
    return running_totals(turns, ["conv_id"], ["turn", "id"], "one", "rank").select("conv_id", "rank", "id", "chars")


def grafted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on others: of conversation c the first h turns of c - c % 100 (all if fewer), then its own after its first h, with
    h = crc32 of the decimal c, modulo 6. Returns turns (conv_id, pos, id, chars) and members (conv_id, n turns)."""
    turns = turn_rows(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    counts = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "counts")
    heads = turns.where("conv_id % 100 = 0 and rank < 5").select(F.col("conv_id").alias("base"), "rank", "id", "chars")
    sizes = counts.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    plan = counts.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base")).join(sizes, "base", "left")
    plan = written(plan.select("conv_id", "own", "h", "base", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("got")), "grafts")
    taken = plan.select("conv_id", "base", "h").join(heads, "base").where("rank < h").select("conv_id", F.col("rank").alias("pos"), "id", "chars")
    short = plan.where("got < h").select(F.col("conv_id").alias("c"), F.col("got").alias("g"))
    own = turns.where(F.col("rank") >= h).join(short, F.col("conv_id") == F.col("c"), "left")
    own = own.select("conv_id", (F.col("rank") - h + F.coalesce("g", h)).alias("pos"), "id", "chars")
    return taken.unionByName(own), plan.select("conv_id", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def ungrafted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: turns and members."""
    turns = turn_rows(conversations)
    return turns.withColumnRenamed("rank", "pos"), turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def _keys(turns: DataFrame, members: DataFrame, deepest: int, band: int) -> DataFrame:
    """One row for each band of a conversation: conv_id, band, prefix, key, chars, ended, next (the node where it goes on)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "chars")))
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / band).alias("band")).agg(ordered.alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), ""))
    rows = rows.select("conv_id", "band", key.alias("key"), F.transform("t", lambda x: x["chars"]).alias("chars"))
    none = members.where("n = 0").select("conv_id", F.lit(0).cast("bigint").alias("band"), F.lit(b"").alias("key"), F.array().cast("array<bigint>").alias("chars"))
    rows, root = rows.unionByName(none), F.lit(ROOT)
    if not deepest:
        return rows.select("*", root.alias("prefix"), F.lit(True).alias("ended"), F.lit(None).cast("binary").alias("next"))
    last = members.select(F.col("conv_id").alias("c"), F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / band).alias("last"))
    rows = written(rows.join(last, F.col("conv_id") == F.col("c")).select("conv_id", "band", "key", "chars", (F.col("band") == F.col("last")).alias("ended")), "keys")
    links = rows.where("not ended").select("conv_id", "band", F.unhex(F.sha2("key", 256)).alias("digest"))
    links = links.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "band").mapInArrow(_chained, "c bigint, b bigint, after binary")
    links = written(links, "links")
    before = links.select("c", (F.col("b") + 1).alias("b"), F.col("after").alias("before"))
    same = lambda: (F.col("conv_id") == F.col("c")) & (F.col("band") == F.col("b"))
    rows = rows.join(before, same(), "left").drop("c", "b").join(links, same(), "left")
    return written(rows.select("conv_id", "band", "key", "chars", F.coalesce("before", root).alias("prefix"), "ended", F.col("after").alias("next")), "keys")


def prefix_trie(turns: DataFrame, members: DataFrame, band: int = BAND, slice_bytes: int = SLICE, chunk: int = CHUNK) -> DataFrame:
    """One row for each distinct sequence of first turns of conversations (a node), the empty one included: conv_id, the smallest of its
    conversations; depth; parent_conv_id (the root has none); n_convs; n_children; n_leaves, childless nodes of its subtree; saved_tokens, the sum over
    its subtree of (n_convs - 1) times the code points of the node's last text; ends_sha256, the hash of the ids of conversations that end
    there, ascending, joined by commas.

    ``turns`` has conv_id, pos (gapless from 0), id and chars; ``members`` has conv_id and its number n of turns, with a row for each conversation.
    No members, no rows. Ids that end at one node are hashed in order, in pieces of ``chunk`` ids, by one task: a hash is sequential.
    """
    spark = turns.sparkSession
    turns, members = written(turns, "turns"), written(members, "members")
    deepest = (turns.agg(F.max("pos")).first()[0] or 0) // band
    keys = _keys(turns, members, deepest, band)
    below, parts, merged = None, [], []
    for level in range(deepest, -1, -1):
        rows = keys.where(F.col("band") == level) if deepest else keys
        if below is None:
            rows = rows.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved")])
        else:
            rows = rows.join(below, F.col("next") == F.col("id"), "left")
        order = ["prefix", "key", "conv_id"]
        ranged = rows.select(*order, "ended", "chars", "n_children", "n_leaves", "saved").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        first = level * band
        found = written(ranged.mapInArrow(_nodes(first, slice_bytes, chunk), _DDL), "nodes")
        borders = found.where(F.col("kind") == BORDER).select("part", "last", "chars", "n_children", "n_leaves", "saved", F.lead("first").over(Window.orderBy("part")).alias("next"))
        mended = borders.where("next is not null").mapInArrow(_borders(first), _DDL)
        texts = found.where(F.col("kind") == ENDS).select("node", "part", "at", "ends")
        hashes = texts.repartition(partitions(spark), "node").sortWithinPartitions("node", "part", "at").mapInArrow(_hashed, "id binary, all_ends string")
        sums = [F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("low").alias("low"), F.max("parent_low").alias("parent_low"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends")]
        whole = found.where(F.col("kind") == PARTIAL).unionByName(mended).groupBy("node").agg(*sums)
        whole = written(whole.join(hashes, F.col("node") == F.col("id"), "left").withColumn("ends", F.coalesce("all_ends", "ends")).drop("id", "all_ends"), "merged")
        below = whole.where(F.col("depth") == first).select(F.col("node").alias("id"), "n_children", "n_leaves", "saved")
        parts.append(found)
        merged.append(whole.where(F.col("depth") > first) if level else whole)
    return _joined(parts, merged)


def _joined(parts: list[DataFrame], merged: list[DataFrame]) -> DataFrame:
    columns = ["depth", "low", "parent_low", "n_convs", "n_children", "n_leaves", "saved", "ends"]

    def out(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select(
            F.col("low").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
        )

    whole = merged[0]
    for m in merged[1:]:
        whole = whole.unionByName(m)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    lows = whole.select(F.col("node").alias("id"), F.col("low").alias("above"))
    hanging = found.where(F.col("kind") == HANGING).select("parent", *columns).unionByName(whole.select("parent", *columns))
    return out(found.where(F.col("kind") == FINAL), F.col("parent_low")).unionByName(out(hanging.join(lows, F.col("parent") == F.col("id"), "left"), F.coalesce("above", "parent_low")))
