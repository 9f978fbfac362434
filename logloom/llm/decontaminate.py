"""Benchmark decontamination by a generalised suffix automaton.

The words of all test items go into one automaton (a block of bounded size; more items, more blocks), built in a Spark task.
Documents stream through it word by word: the state and the matching length say which sequence of item words ends at each
word. Windows of a set number of item words, and items shorter than a window, mark words as hit; runs of matched words over a
length limit, and whole documents over a coverage limit, are removed.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm._scan import running_totals
from logloom.llm._spark import text_rows, word_blocks, written

WINDOW = 10
#: Item words of one automaton. It has at most twice as many states and three times as many steps, about 100 MB as Python objects.
BLOCK_WORDS = 200_000
#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest of ASCII parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same, before letters are lower case
_SPANS = "array<struct<`from`:bigint,`to`:bigint>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """A suffix automaton of several word sequences. States are numbers; ``steps[state]`` maps a word to the next state."""

    def __init__(self) -> None:
        self.steps: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, steps: dict[bytes, int], link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` that ends no longer sequences than ``state`` and one word more; paths that lead there by ``word`` are turned to it."""
        copy = self._state(self.length[state] + 1, dict(self.steps[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: list[bytes]) -> None:
        """Adds all parts of ``sequence``; what other sequences have is shared."""
        last = 0
        for word in sequence:
            known = self.steps[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.steps[at]:
                self.steps[at][word] = new
                at = self.link[at]
            if at >= 0:
                target = self.steps[at][word]
                self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
            last = new

    def states(self, sequence: list[bytes], most: int) -> Iterator[tuple[int, int]]:
        """State and length after each word of a sequence that was added, for its last ``most`` words at most."""
        state = length = 0
        for word in sequence:
            state, length = self.steps[state][word], length + 1
            if length > most:
                length = most
                while self.length[self.link[state]] >= most:
                    state = self.link[state]
            yield state, length


class Index:
    """The automaton of a block of items, and for each state the windows that end there.

    ``ends[state]`` lists (window length, item ids): those of the state itself and of all shorter sequences that end with it, longest first.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        machine = Automaton()
        for _, sequence in items:
            machine.add(sequence)
        own: dict[int, tuple[int, set]] = {}
        for name, sequence in items:
            size = min(window, len(sequence))
            for state, length in machine.states(sequence, size):
                if length == size:
                    own.setdefault((state, size), (size, set()))[1].add(name)
        by_state: dict[int, list] = {}
        for (state, _), found in own.items():
            by_state.setdefault(state, []).append(found)
        self.ends: list[tuple] = [()] * len(machine.length)
        for state in sorted(range(1, len(machine.length)), key=machine.length.__getitem__):
            mine = sorted(by_state.get(state, ()), key=lambda x: -x[0])
            self.ends[state] = (*((size, tuple(sorted(names, key=str))) for size, names in mine), *self.ends[machine.link[state]])
        self.steps, self.link, self.length = machine.steps, machine.link, machine.length

    def scan(self, text: str | None, limit: int) -> tuple[int, list[list[int]], int, list[list[int]], set]:
        """Number of words; runs of words hit by windows; the longest match of any sequence of item words; matches of ``limit`` words or more (from,
        to) where they stop growing; the ids of items whose windows occur. Texts are read in pieces of about a megabyte."""
        steps, link, lengths, ends = self.steps, self.link, self.length, self.ends
        first = steps[0].get
        hits: list[list[int]] = []
        matches: list[list[int]] = []
        found: set = set()
        at = state = length = most = 0
        for block in word_blocks((text or "").encode().translate(_TABLE)):
            for word in block:
                at += 1
                if state:
                    after = steps[state].get(word)
                    if after is None:
                        most = max(most, length)
                        if length >= limit:
                            matches.append([at - 1 - length, at - 1])
                        while state and after is None:
                            state = link[state]
                            length = lengths[state]
                            after = steps[state].get(word)
                    if after is None:
                        continue
                else:
                    after = first(word)
                    if after is None:
                        continue
                state, length = after, length + 1
                if ends[state]:
                    longest = 0
                    for size, names in ends[state]:
                        if size <= length:
                            longest = longest or size
                            found.update(names)
                    if longest:
                        start = at - longest
                        while hits and hits[-1][0] >= start:
                            hits.pop()
                        if hits and hits[-1][1] >= start:
                            hits[-1][1] = at
                        else:
                            hits.append([start, at])
        if length >= limit:
            matches.append([at - length, at])
        return at, hits, max(most, length), matches, found


_INDEX: dict[str, Index] = {}  # the index that this Python process read last


def _index(name: str, data: bytes) -> Index:
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = pickle.loads(data)
    return _INDEX[name]


def item_pieces(name, sequence: list[bytes], window: int, most: int) -> Iterator[tuple]:
    """An item of more than ``most`` words in parts that share ``window`` - 1 words, so that each window is in one of them."""
    yield name, sequence[:most]
    for at in range(most - window + 1, len(sequence) - window + 1, most - window + 1):
        yield name, sequence[at : at + most]


def _split_items(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = [(n, s) for n, s in item_pieces(name, words(text), window, most) if s]
                if parts:
                    yield pa.RecordBatch.from_pydict({"item": [n for n, _ in parts], "words": [b" ".join(s).decode() for _, s in parts], "n": [len(s) for _, s in parts]}, pa.schema([("item", pa.string()), ("words", pa.string()), ("n", pa.int64())]))

    return run


def _build(window: int):
    def run(rows: pa.Table) -> pa.Table:
        items = [(name, text.encode().split(b" ")) for name, text in zip(rows.column("item").to_pylist(), rows.column("words").to_pylist(), strict=True)]
        data = pickle.dumps(Index(items, window), pickle.HIGHEST_PROTOCOL)
        return pa.table({"name": [hashlib.sha256(data).hexdigest()], "data": [data]}, pa.schema([("name", pa.string()), ("data", pa.binary())]))

    return run


def indexes(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """One row (name, data) for each block of items of at most ``block_words`` words and a part of an item. A block is built by one task; blocks side by side."""
    texts = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    parts = texts.mapInArrow(_split_items(window, max(window, block_words // 2)), "item string, words string, n bigint").distinct()
    placed = running_totals(parts.withColumn("all", F.lit(0)), ["all"], ["words", "item"], "n", "before")
    blocks = placed.withColumn("block", F.floor(F.col("before") / block_words))
    return written(blocks.select("block", "item", "words").groupBy("block").applyInArrow(_build(window), "name string, data binary"), "automata")


def _found(shared, name: str, with_text: bool):
    """Adds what the index finds to each row."""
    spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    schema = pa.schema([("n_words", pa.int64()), ("hits", spans), ("longest", pa.int64()), ("matched", spans), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared.value)
        for batch in text_rows(batches):
            rows = []
            for text in batch.column("__text").to_pylist():
                n, hits, longest, matches, items = index.scan(text, limit)
                rows.append((n, [{"from": a, "to": b} for a, b in hits], longest, [{"from": a, "to": b} for a, b in _merged(matches)], sorted(i for i in items if i is not None)))
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            kept = [c for c in batch.schema.names if with_text or c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *schema.names])

    return run


def _merged(spans) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _union(spans: Column) -> Column:
    """Spans of several blocks as runs of words."""

    def union(found: list) -> list:
        return _merged((x["from"], x["to"]) for x in found)

    return F.udf(union, _SPANS)(F.flatten(F.collect_list(spans)))


_FOUND = f"n_words bigint, hits {_SPANS}, longest bigint, matched {_SPANS}, items array<string>"


def overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, length_limit: int | None = None, block_words: int = BLOCK_WORDS, with_text: bool = True) -> DataFrame:
    """``docs`` with ``overlap``: n_words; hits, the runs of words (from, to; counted from 0) inside any occurrence of a window; longest, the longest
    sequence of item words found; matched, the runs of sequences of ``length_limit`` (``window`` if None) words or more; items, the ids of items
    whose windows occur, sorted as strings.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer. Null texts and texts without words have no words and
    no hits; items without words have no window. Null item ids mark words, but are not listed; repeated items count once. An empty table of
    items finds nothing; an empty table of documents gives no rows; repeated rows are each judged alike. A long item is cut into parts of
    half a block, which share all windows; ``longest`` ends at such a cut. Columns of any other name are kept, the text
    only ``with_text``.

    Each block's automaton is broadcast, of bounded size. With one block documents are read once and not shuffled; with more, rows with hits
    are written for each block and joined by a row number that is written with the texts.
    """
    if window < 1 or (length_limit is not None and length_limit < 1) or block_words < window:
        raise ValueError("window and length_limit are 1 or more, block_words at least a window")
    limit = length_limit or window
    table = indexes(items, item_id, item_text, window, block_words)
    names = sorted(r.name for r in table.select("name").collect())
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    held = docs.select(F.struct(F.lit(0).alias("__"), *others).alias("__row"), F.col(text_col).alias("__text"))
    if len(names) <= 1:
        found = _scanned(held, table, names[0] if names else None, limit, with_text)
    else:
        held = written(held.withColumn("__at", F.monotonically_increasing_id()), "numbered")
        parts = [written(_scanned(held.select("__at", "__text"), table, name, limit, False).where("longest > 0"), "overlaps") for name in names]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        once = every.groupBy(F.col("__at").alias("__id")).agg(_union(F.col("hits")).alias("h"), F.max("longest").alias("l"), _union(F.col("matched")).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
        joined = _scanned(held, table, None, limit, with_text).join(written(once, "overlaps"), F.col("__at") == F.col("__id"), "left")
        for name, short in (("hits", "h"), ("longest", "l"), ("matched", "m"), ("items", "i")):
            joined = joined.withColumn(name, F.coalesce(short, name))
        found = joined
    text = [F.col("__text").alias(text_col)] if with_text else []
    back = {c: F.col("__row")[c].alias(c) for c in docs.columns if c not in (text_col, "overlap")} | {text_col: x for x in text}
    return found.select(*[back[c] for c in docs.columns if c in back], F.struct("n_words", "hits", "longest", "matched", "items").alias("overlap"))


def _scanned(rows: DataFrame, table: DataFrame, name: str | None, limit: int, with_text: bool) -> DataFrame:
    """``rows`` with what the index of that name finds; without a name, an index of no items counts words."""
    data = table.where(F.col("name") == name).first().data if name else pickle.dumps(Index([], WINDOW))
    run = _found(rows.sparkSession.sparkContext.broadcast(data), name or "none", with_text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if with_text or f.name != "__text")
    return rows.mapInArrow(lambda batches: run(batches, limit), f"{fields}, {_FOUND}")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, length_limit: int | None = None, coverage_limit: float = 0.5, **options) -> DataFrame:
    """``docs`` without the passages that test items hold: runs of words that match item words over the length limit, and words hit by windows, are cut
    out of the texts; documents of which more than ``coverage_limit`` of the words would go, go whole. Others stay as they are; null texts stay."""
    found = overlaps(docs, items, text_col, window=window, length_limit=length_limit, **options)
    spans = F.concat("overlap.hits", "overlap.matched")
    cut = F.udf(without_words, "string")(F.col(text_col), spans)
    gone = F.udf(lambda x: sum(b - a for a, b in _merged((s["from"], s["to"]) for s in x)), "bigint")(spans)
    kept = found.where(gone <= F.col("overlap.n_words") * coverage_limit)
    return kept.withColumn(text_col, cut).select(*docs.columns)


def without_words(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    runs = _merged((s["from"], s["to"]) for s in spans)
    out, kept, run = [], 0, 0
    for i, m in enumerate(_WORD.finditer(text)):
        if run == len(runs):
            break
        if i == runs[run][0]:
            out.append(text[kept : m.start()])
        if i == runs[run][1] - 1:
            kept, run = m.end(), run + 1
    return "".join([*out, text[kept:]])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered query's row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = overlaps(docs.select(id_col, "text"), items, with_text=False)
    hit = F.aggregate("overlap.hits", F.lit(0).cast("bigint"), lambda a, x: a + x["to"] - x["from"])
    names = F.col("overlap.items")
    return found.select(
        id_col, F.col("overlap.n_words").alias("n_words"), hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("overlap.hits") > 0).alias("contaminated"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the registered query: every window of each length, joined by its words."""
    split = lambda text: f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {split("text")} AS w FROM benchmark),
      windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS x
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
      docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({split("text")}, []) AS w FROM documents),
      parts AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
      found AS (SELECT r, p.k, i, item FROM parts p JOIN windows v ON p.k = v.k AND p.x = v.x),
      hits AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, k, i FROM found)) GROUP BY r),
      names AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
      sha256(coalesce(m.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hits h USING (r) LEFT JOIN names m USING (r)"""
