"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. A round fills a window of ``WINDOW`` tokens (or ``stretch`` of them): each queue earns credit
in proportion to its weight, and is served as many whole bursts of ``BURST`` tokens as its credit allows; what it isn't served
stays as its deficit for the next round. Queues start with staggered deficits, so that queues of equal weight take turns.
Credit runs on over all rounds and partitions: after any number of rounds, a queue has had what its weight asks for, give or take
a burst. A queue that ends leaves its share to the others. Documents are cut freely, so no window but the last has padding.

What a queue has been served before a round has a closed form (its credit by then, in whole bursts), so every task finds the
places of its own tokens without the rounds before. Only token counts by queue are gathered: at most ``QUEUES`` rows and
one for each given weight.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm._scan import running_totals
from logloom.llm._spark import partitions, small, text_rows, written
from logloom.llm.tokens import WordTokenizer

WINDOW = 2048
BURST = 16
STRETCH = 1  # windows of a round
QUEUES = 4096  # sources with a queue of their own, the largest, beside those with given weights
SHARED = 1024  # queues, by hash, of all other sources
CARRIED = 200_000  # rows of totals by source and partition that are broadcast; more are joined by shuffle
MANY = 256  # queues beyond which rows of a round are put side by side, as each round's places cost as much as there are queues
VECTOR = 64  # queues beyond which a round is worked out in numpy
END = 1  # the id after each document

_PHASE, _GOLDEN = 1 << 20, 648_055  # starting deficits are multiples of the golden ratio, in parts of a burst


class Plan:
    """The order in which the tokens of all queues fill the windows.

    In virtual time v queue i has earned ``weights[i] * v`` tokens, up to all it has. Round k begins when all queues together have
    earned k rounds' tokens. All of this is exact, in whole numbers.
    """

    def __init__(self, tokens: list[int], weights: list[int], window: int, burst: int, stretch: int = STRETCH):
        self.tokens, self.weights, self.window, self.burst, self.size = tokens, weights, window, burst, window * stretch
        self.total = sum(tokens)
        self._phase = [i * _GOLDEN % _PHASE for i in range(len(tokens))]
        # Queues end in this order; between two ends the earned tokens grow evenly: done[s] + rate[s] * v.
        ends = sorted(range(len(tokens)), key=lambda i: Fraction(tokens[i], weights[i]))
        self._done = [0, *accumulate(tokens[i] for i in ends)]
        whole = sum(weights)
        self._rate = [whole, *(whole - x for x in accumulate(weights[i] for i in ends))]
        # The last whole number of earned tokens before each end, and (rounded) when that end is.
        self._until = [-(-(d * weights[i] + r * tokens[i]) // weights[i]) - 1 for i, d, r in zip(ends, self._done, self._rate, strict=False)]
        self._times = [tokens[i] / weights[i] for i in ends]
        self._float_done, self._float_rate, self._float_times = (np.array(x, np.float64) for x in (self._done, self._rate, self._times))
        self._float_tokens, self._float_weights = np.array(tokens, np.float64), np.array(weights, np.float64)
        self._float_phase = np.array(self._phase, np.float64) / _PHASE
        self._known: dict[int, tuple[list[int], list[int], list[int]]] = {}
        self._most = max(16, 400_000 // max(1, len(tokens)))
        self._last = [0] * len(tokens)

    def served(self, k: int) -> list[int]:
        """What each queue is served before round k."""
        earned = k * self.size
        if earned >= self.total:
            return self.tokens
        s = bisect_left(self._until, earned)
        done, rate = earned - self._done[s], self._rate[s]
        if len(self.tokens) > VECTOR:
            return self._vector(done, rate).tolist()
        return [self._served(i, done, rate) for i in range(len(self.tokens))]

    def _served(self, i: int, done: int, rate: int) -> int:
        """What queue i is served by the time done / rate. The last burst may be a part of one; its start is staggered by that part of the phase."""
        t, w, p, unit = self.tokens[i], self.weights[i], self._phase[i], self.burst
        if (w * done - t * rate) * _PHASE + t % unit * p * rate >= 0:
            return t
        return min(t - t % unit, (w * done * _PHASE + unit * p * rate) // (unit * rate * _PHASE) * unit)

    def _vector(self, done: int, rate: int) -> np.ndarray:
        """``_served`` of all queues in floating point, and again in whole numbers where rounding might decide."""
        t, w, p = self._float_tokens, self._float_weights, self._float_phase
        earned, part = w * (done / rate), t % self.burst
        bursts = earned / self.burst + p
        over = earned + part * p - t
        unsure = (np.abs(bursts - np.rint(bursts)) <= 1e-9 + 1e-14 * bursts) | (np.abs(over) <= 1e-9 + 1e-14 * t)
        out = np.where(over >= 0, t, np.minimum(t - part, np.floor(bursts) * self.burst)).astype(np.int64)
        for i in np.flatnonzero(unsure).tolist():
            out[i] = self._served(i, done, rate)
        return out

    def round(self, k: int) -> tuple[list[int], list[int], list[int]]:
        """What each queue is served before round k, and by its end, and where its tokens of the round begin in all windows."""
        if k not in self._known:
            last = self._known.get(k - 1)
            if len(self._known) >= self._most:
                self._known.clear()
            before = last[1] if last else self.served(k)
            after = self.served(k + 1)
            if len(before) > VECTOR:
                starts = (np.cumsum(np.subtract(after, before)) - np.subtract(after, before) + sum(before)).tolist()
            else:
                starts = list(accumulate((y - x for x, y in zip(before, after, strict=True)), initial=sum(before)))
            self._known[k] = before, after, starts
        return self._known[k]

    def round_of(self, i: int, token: int, about: int = -1) -> int:
        """The round that serves a token of queue i; ``about`` is a round near it, if one is known."""
        k = about if about >= 0 else self._last[i]
        for _ in range(2):
            if k in self._known or not k or about >= 0:
                before, after, _places = self.round(k)
                if before[i] <= token < after[i]:
                    self._last[i] = k
                    return k
            k += 1
        k = int(self.estimated(i, token, 1)[0])
        while k and self.round(k)[0][i] > token:
            k -= 1
        while self.round(k)[1][i] <= token:
            k += 1
        self._last[i] = k
        return k

    def estimated(self, i: int, start: int, length: int) -> np.ndarray:
        """About the round of each burst of tokens start .. start + length of queue i, from its due time in floating point."""
        first = start // self.burst * self.burst
        at = np.arange(first, start + length, self.burst)
        due = (at + np.minimum(self.burst, self.tokens[i] - at) * (1 - self._phase[i] / _PHASE)) / self.weights[i]
        s = np.minimum(np.searchsorted(self._float_times, due, "right"), len(self.tokens) - 1)
        return np.maximum(0, (self._float_done[s] + self._float_rate[s] * due) / self.size).astype(np.int64)

    def cuts(self, i: int, start: int, length: int) -> list[tuple[int, int, int]]:
        """Tokens start .. start + length of queue i by about the rounds that serve them: (round, offset, length)."""
        rounds = self.estimated(i, start, length)
        new = np.flatnonzero(np.append(True, rounds[1:] != rounds[:-1]))
        offsets = np.maximum(new * self.burst - start % self.burst, 0)
        return list(zip(rounds[new].tolist(), offsets.tolist(), np.diff(np.append(offsets, length)).tolist(), strict=True))

    def pieces(self, i: int, start: int, length: int, about: int = -1) -> Iterator[tuple[int, int, int]]:
        """Cuts tokens start .. start + length of queue i into (offset in them, length, place in all windows)."""
        at, end = start, start + length
        while at < end:
            before, after, places = self.round(self.round_of(i, at, about))
            place = places[i] + at - before[i]
            n = min(min(end, after[i]) - at, self.window - place % self.window)
            yield at - start, n, place
            at += n

    def padded(self, sequence: int) -> int:
        """The length that a sequence is padded to."""
        return padded_length(min(self.window, self.total - sequence * self.window), self.window)


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    """A Python worker's tokenizer, with the words that it has met, of which it holds a bounded number, for all its tasks."""
    return WordTokenizer(path)


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pid, seen = _tokenizer(path), TaskContext.get().partitionId(), {}
        end = np.array([END], words.dtype).tobytes()
        size = len(end)
        for part in text_rows(batches, 256):
            counts, before, ids = [], [], []
            for text, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                packed = words.encode(text or "") + end
                ids.append(packed)
                counts.append(len(packed) // size)
                before.append(seen.get(source, 0))
                seen[source] = before[-1] + counts[-1]
            arrays = [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary()), pa.array([pid] * len(ids), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "source", "n", "before", "ids", "pid"])

    return run


def _cut(plan: Plan, dtype: str):
    """Documents cut where the rounds change that serve them, so that rows of a round can be put side by side."""
    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_rows(batches, 256):
            rows: list[tuple] = []
            which: list[int] = []
            for r, (queue, n, start, ids) in enumerate(zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)):
                for about, at, length in plan.cuts(queue, start, n):
                    rows.append((queue, n, start + at, ids[size * at : size * (at + length)], at, about))
                    which.append(r)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), *columns], ["id", "queue", "n", "start", "ids", "at", "about"])

    return run


def _packed(plan: Plan, dtype: str):
    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_rows(batches, 512):
            rows: list[tuple] = []
            which: list[int] = []
            for r, (queue, n, start, ids, base, about) in enumerate(zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4, 5, 6)), strict=True)):
                wide = np.frombuffer(ids, dtype).astype("<u4").tobytes() if size != 4 else ids
                for at, length, place in plan.pieces(queue, start, len(wide) // 4, about):
                    sequence = place // plan.window
                    rows.append((base + at, length, wide[4 * at : 4 * (at + length)], n, sequence, place % plan.window, plan.padded(sequence)))
                    which.append(r)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), *columns], names)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict | None = None,
    window: int = WINDOW,
    burst: int = BURST,
    stretch: int = STRETCH,
    queues: int = QUEUES,
) -> DataFrame:
    """One row for each piece: id, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    padded_length (of the sequence).

    ``weights`` (positive integers by source) sets the proportions in which the windows are filled; without it, or for sources
    that it lacks, a source's weight is its token count, so that all queues end together. A queue that runs out leaves its
    share to the others: all tokens are packed. The ``queues`` largest sources have a queue of their own, and so has each
    source with a given weight, however many sources there are. All other sources, each smaller than these, share ``SHARED``
    queues by hash, and each of those weighs as its tokens do. With more than ``MANY`` queues documents are cut where the round changes and
    the cuts sorted by round, so that each round's places are worked out once; with fewer, tokens aren't shuffled. A round fills ``stretch`` windows; longer rounds and bursts
    make longer pieces and coarser mixtures.

    Null and empty texts are their end id alone. Null ids are kept as null, and null sources are one source.
    Repeated rows are packed as often as they occur. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = written(rows.mapInArrow(_tokenized(tokenizer), f"id {kind}, source string, n bigint, before bigint, ids binary, pid int"), "tokens")
    held = written(tokens.groupBy("source", "pid").agg(F.sum("n").alias("held")), "held")
    sizes = held.groupBy("source").agg(F.sum("held").alias("total"))
    given = weights or {}
    largest = [r.source for r in sizes.orderBy(F.desc("total"), "source").limit(queues).collect()]
    own = sorted({*largest, *given}, key=lambda s: (s is not None, s))
    named = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(own)], "own string, place int"))
    shared = F.lit(len(own)) + F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("int")
    placed = held.join(named, F.col("source").eqNullSafe(F.col("own")), "left").select("source", "pid", "held", F.coalesce("place", shared).alias("queue"))
    placed = written(placed, "queues")
    totals = {r.queue: r.total for r in placed.groupBy("queue").agg(F.sum("held").alias("total")).collect()}
    counts = [totals.get(i, 0) for i in range(len(own) + SHARED)]
    while counts and not counts[-1]:
        counts.pop()
    plan = Plan(counts, [given.get(own[i], max(1, c)) if i < len(own) else max(1, c) for i, c in enumerate(counts)], window, burst, stretch)
    bases = running_totals(placed, ["queue"], ["pid", "source"], "held", "base").select(F.col("source").alias("s"), F.col("pid").alias("p"), "queue", "base")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("pid") == F.col("p"))
    based = tokens.join(small(bases, CARRIED), same).select("id", "queue", "n", (F.col("base") + F.col("before")).alias("start"), "ids", F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("about"))
    dtype = WordTokenizer(tokenizer).dtype
    if sum(c > 0 for c in counts) > MANY:
        cut = based.drop("at", "about").mapInArrow(_cut(plan, dtype), f"id {kind}, queue int, n bigint, start bigint, ids binary, at bigint, about bigint")
        based = cut.repartitionByRange(partitions(spark), "about").sortWithinPartitions("about")
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length int"
    return based.mapInArrow(_packed(plan, dtype), schema)


def padded_length(length: int, window: int = WINDOW) -> int:
    """Sequences are padded to the window, but one whose length is a power of two keeps it."""
    return length if length and not length & (length - 1) else window


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, ids array<bigint>, tokens): the padded sequences of ``pack``'s pieces, of at most ``window`` ids each, which is what bounds a
    group here. Null document ids make no difference; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                counts.append(len(ids))
                out.append(np.append(ids, np.full(padded_length(len(ids), window) - len(ids), pad)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["sequence_id", "ids", "tokens"])

    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(run, "sequence_id bigint, ids array<bigint>, tokens bigint")
