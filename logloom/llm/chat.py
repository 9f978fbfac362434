"""Chat formatting with a prefix tree.

Conversations that begin with the same turns share them: a node of the tree is a turn with all turns before it, and its
tokens are emitted once. A node belongs to the smallest conversation that passes through it, so each distinct
conversation owns one segment: its turns from where it leaves the smaller ones, to its end. The tree's tokens are laid out
depth-first (a segment, then what branches off it, deepest first), every node with its place, the position ids of its
path, and the intervals of its ancestors that it may attend to.

No step holds a tree or a conversation: keys of prefixes are a polynomial over the turns' digests, which is put together
from parts of a conversation, and places are running totals over range partitions.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm._scan import running_totals
from logloom.llm._spark import partitions, text_rows, written

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Strings that chat templates use as control strings.
CONTROL = (
    "<|turn|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
)
ESCAPE = "␛"
_STARTS = re.compile("([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")

PRIME, BASE = 2**127 - 1, 0x5DEECE66D1234567890ABCDEF1234567


def escaped(text: str) -> str:
    """The text with a mark after the first character of every control string in it. ``unescaped`` undoes it."""
    return _STARTS.sub(lambda m: m[1] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescaped(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


class ChatTokens:
    """A turn's token ids: a start id, its role, a body id, its text, an end id. The three ids lie beyond the vocabulary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        size = self._tokenizer.get_vocab_size()
        self.turn, self.body, self.end = size, size + 1, size + 2
        # Roles are few and repeat, so what is known of them is kept.
        self._role_ids = lru_cache(4096)(lambda role: self._tokenizer.encode(escaped(role), add_special_tokens=False).ids)
        self._role = lru_cache(4096)(lambda ids: self.decode(list(ids)))

    def encode(self, roles: list[str], texts: list[str]) -> list[tuple[list[int], int]]:
        """(ids, where the text begins) of each turn; the text ends before the last id."""
        split = self._tokenizer.encode_batch([escaped(x) for x in texts], add_special_tokens=False)
        return [([self.turn, *r, self.body, *t.ids, self.end], len(r) + 2) for r, t in zip(map(self._role_ids, roles), split, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self._tokenizer.decode(ids, skip_special_tokens=False)

    def turns(self, ids: list[int]) -> tuple[str, str, str]:
        """(formatted text, role, text as formatted) of one turn's ids."""
        body = ids.index(self.body)
        if ids[0] != self.turn or ids[-1] != self.end:
            raise ValueError("not a turn")
        role, text = self._role(tuple(ids[1:body])), self.decode(ids[body + 1 : -1])
        return f"{TURN}{role}{BODY}{text}{END}", role, text


@dataclass(frozen=True)
class Forest:
    """``nodes``: tree, node, segment, depth, start, n_tokens, ids, loss_from, loss_to, position, ancestors (start, end), segment_start.

    A token of a node attends to the ancestors' intervals, and to its own segment from segment_start up to itself. All
    places count the tokens of the tree. loss_from and loss_to bound the tokens of the node that are under the loss mask.
    ``paths``: conv_id, depth, node for every turn of every conversation.
    """

    nodes: DataFrame
    paths: DataFrame


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; adds each row's number and key within what this partition has of its conversation."""
    conv, count, key = object(), 0, 0
    for part in text_rows(batches, 512):
        counts, keys = [], []
        for c, role, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            if c != conv:
                conv, count, key = c, 0, 0
            role, text = role.encode(), text.encode()
            own = int.from_bytes(hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest(), "big")
            count, key = count + 1, (key * BASE + own + 1) % PRIME
            counts.append(count)
            keys.append(f"{key:032x}")
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(counts, pa.int64()), pa.array(keys)], ["conv_id", "role", "text", "depth", "node"])


def _carried(ranged: DataFrame) -> dict[int, tuple[int | None, int, int]]:
    """For each partition that continues a conversation: which, how many turns it has before, and their key. One row a partition."""
    last = F.max_by(F.struct("conv_id", "depth", "node"), F.struct("row"))
    first = F.min_by("conv_id", F.struct("row"))
    rows = ranged.groupBy("pid").agg(first.alias("first"), last.alias("last"), F.min_by("depth", F.struct("row")).alias("one")).orderBy("pid").collect()
    found, before = {}, None
    for r in rows:
        count, key = r.last.depth, int(r.last.node, 16)
        if before is not None and r.first == before[0]:
            found[r.pid] = before
            if r.last.conv_id == before[0]:
                count, key = before[1] + count, (before[2] * pow(BASE, r.last.depth, PRIME) + key) % PRIME
        before = (r.last.conv_id, count, key)
    return found


def _joined_up(carried: dict[int, tuple[int | None, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            depths, nodes = [], []
            for conv, depth, node, pid in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                before = carried.get(pid)
                if before is not None and before[0] == conv:
                    node = f"{(before[2] * pow(BASE, depth, PRIME) + int(node, 16)) % PRIME:032x}"
                    depth += before[1]
                depths.append(depth)
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(depths, pa.int64()), pa.array(nodes), *part.columns[4:]], ["conv_id", "depth", "node", "role", "text"])

    return run


def _token_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = ChatTokens(path)
        for part in text_rows(batches, 128):
            roles, texts = part.column(3).to_pylist(), part.column(4).to_pylist()
            ids, starts, ends, counts = [], [], [], []
            for role, (found, at) in zip(roles, chat.encode(roles, texts), strict=True):
                ids.append(found)
                counts.append(len(found))
                starts.append(at if role == "assistant" else 0)
                ends.append(len(found) - 1 if role == "assistant" else 0)
            columns = [pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], ["segment", "depth", "node", "n_tokens", "ids", "loss_from", "loss_to"])

    return run


def prefix_forest(turns: DataFrame, tokenizer: str) -> Forest:
    """``turns`` (conv_id, turn, role, text) to the prefix tree of all conversations.

    A conversation's rows are ordered by turn, then role, then text; nulls come first, so turns that tie or repeat
    are all kept, in that order. Null roles and texts are empty. Rows without a conv_id are one conversation, whose
    id is null. Other columns are ignored; an empty table gives an empty forest.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    keyed = ranged.mapInArrow(_prefixes, "conv_id bigint, role string, text string, depth bigint, node string")
    keyed = written(keyed.withColumn("pid", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    joined = keyed.select("conv_id", "depth", "node", "pid", "role", "text").mapInArrow(
        _joined_up(_carried(keyed.select("conv_id", "depth", "node", "pid", "row"))), "conv_id bigint, depth bigint, node string, role string, text string"
    )
    joined = written(joined.withColumn("row", F.monotonically_increasing_id()), "turns")
    paths = joined.select("conv_id", "depth", "node")
    # A node's row is picked by keys alone: its text is looked up by row, so a turn that many share is one row there, not a hot key.
    picked = joined.groupBy("node").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "row")).alias("first"))
    owned = joined.join(picked.select(F.col("first.row").alias("r")), F.col("row") == F.col("r"), "left_semi").withColumnRenamed("conv_id", "segment")
    schema = "segment bigint, depth bigint, node string, n_tokens bigint, ids array<int>, loss_from int, loss_to int"
    nodes = written(owned.select("segment", "depth", "node", "role", "text").mapInArrow(_token_rows(tokenizer), schema), "nodes")
    # What a conversation has of each segment on its way.
    sizes = nodes.select(F.col("node").alias("n"), "segment", "n_tokens")
    chain = paths.join(sizes, F.col("node") == F.col("n")).groupBy("conv_id", "segment").agg(F.min("depth").alias("from_depth"), F.sum("n_tokens").alias("tokens"))
    chain = written(chain, "chain")
    steps = chain.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("from_depth", "segment", "tokens"))).alias("steps"))
    own = steps.where(F.element_at("steps", -1)["segment"].eqNullSafe(F.col("conv_id"))).select(
        F.col("conv_id").alias("segment"),
        F.col("steps")[0]["segment"].alias("tree"),
        F.transform(F.slice("steps", 2, F.size("steps")), lambda s: F.struct((-s["from_depth"]).alias("up"), s["segment"].alias("to"))).alias("route"),
        F.element_at("steps", -1)["tokens"].alias("tokens"),
        F.aggregate(F.slice("steps", 1, F.size("steps") - 1), F.lit(0).cast("long"), lambda a, s: a + s["tokens"]).alias("position"),
    )
    laid = written(running_totals(own, ["tree"], ["route"], "tokens", "segment_start").drop("route"), "segments")
    starts = laid.select(F.col("segment").alias("s"), "segment_start")
    ancestors = chain.where(~F.col("conv_id").eqNullSafe(F.col("segment"))).join(starts, F.col("segment").eqNullSafe(F.col("s")))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("from_depth", F.col("segment_start").alias("start"), (F.col("segment_start") + F.col("tokens")).alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    ancestors = ancestors.groupBy(F.col("conv_id").alias("c")).agg(spans.alias("ancestors"))
    laid = laid.join(ancestors, F.col("segment").eqNullSafe(F.col("c")), "left").select(F.col("segment").alias("s"), "tree", "segment_start", F.col("position").alias("segment_position"), "ancestors")
    laid = written(laid, "laid")
    inside = running_totals(nodes.select("segment", "depth", "node", "n_tokens"), ["segment"], ["depth", "node"], "n_tokens", "inside")
    # Places are put together before the tokens join them, so that tokens are shuffled once.
    places = inside.select(F.col("node").alias("n"), F.col("segment").alias("own"), "inside").join(laid, F.col("own").eqNullSafe(F.col("s"))).drop("own", "s")
    placed = nodes.join(places, F.col("node") == F.col("n"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    nodes = placed.select(
        "tree", "node", "segment", "depth", (F.col("segment_start") + F.col("inside")).alias("start"), "n_tokens", "ids", "loss_from", "loss_to",
        (F.col("segment_position") + F.col("inside")).alias("position"), F.coalesce("ancestors", empty).alias("ancestors"), "segment_start",
    )
    return Forest(nodes, paths)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _texts(path: str):
    """Rows (node, ids, loss_from, loss_to) to (node, said, under, chars): role, line feed, text, line feed of the turn; its text
    under the loss mask; how long it is as formatted. Each node is decoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = ChatTokens(path)
        for part in text_rows(batches, 256):
            said, under, chars = [], [], []
            for ids, start, end in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                formatted, role, text = chat.turns(ids)
                chars.append(len(formatted))
                said.append(f"{unescaped(role)}\n{unescaped(text)}\n")
                # The mask counts tokens; where it spans the whole text, that is decoded already.
                whole = start == ids.index(chat.body) + 1 and end == len(ids) - 1
                under.append(unescaped(text if whole else chat.decode(ids[start:end])) if end > start else "")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(under, pa.string()), pa.array(chars, pa.int64())], ["node", "said", "under", "chars"])

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, depth, said, under, chars), sorted by conversation and depth, to ``DIGESTS``."""
    conv, state = object(), None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])

    def row() -> tuple:
        return conv, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]

    for part in text_rows(batches, 256):
        done = []
        for c, said, under, chars in zip(part.column(0).to_pylist(), *(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            if c != conv:
                if state:
                    done.append(row())
                conv, state = c, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            state["turns"] += 1
            state["chars"] += chars
            state["all"].update(said.encode())
            state["loss"].update(under.encode())
            state["loss_chars"] += len(under)
        if done:
            yield batch_of(done)
    if state:
        yield batch_of([row()])


def read_back(forest: Forest, tokenizer: str) -> DataFrame:
    """``DIGESTS`` of every conversation, from the forest's tokens: each node's tokens are decoded once, its text goes to the
    conversations that pass through it, and these are read turn by turn; of a conversation no more than digests is held.

    Null and empty texts are empty, as in the forest; the conversation without an id has a row of its own; an empty forest gives no rows."""
    texts = forest.nodes.select("node", "ids", "loss_from", "loss_to").mapInArrow(_texts(tokenizer), "node string, said string, under string, chars bigint")
    texts = written(texts, "texts").withColumnRenamed("node", "n")
    rows = forest.paths.join(texts, F.col("node") == F.col("n")).select("conv_id", "depth", "said", "under", "chars")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_digested, DIGESTS)


def attention(nodes: list[dict]) -> np.ndarray:
    """The attention mask of one tree, from its rows of ``Forest.nodes``: true where the row's token may attend to the column's."""
    size = max(n["start"] + n["n_tokens"] for n in nodes)
    mask = np.zeros((size, size), bool)
    for n in nodes:
        for i in range(n["start"], n["start"] + n["n_tokens"]):
            mask[i, n["segment_start"] : i + 1] = True
            for a in n["ancestors"]:
                mask[i, a["start"] : a["end"]] = True
    return mask
