"""Spelling variants: words one edit apart, found by a frontier of trie states that is joined level by level with an edge table.

A state is (word, position, node, edits): so much of the word has been read, on the way to that node of the trie of all words. At each level
states without an edit go on along their word, skip a letter of it, or take another letter's edge; states with an edit follow their
word's letters only. A state that has read its word with one edit and stands on a word is a pair. A pair is found from one side:
the longer word skips a letter, of two words of equal length the one with the smaller letter takes the larger one's edge.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm._spark import text_rows, word_blocks, written

#: Lower-case letters and U+00C0 to U+00FF stay, A to Z become lower case, all else parts words (in Latin-1).
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
LEAST_LENGTH, LEAST_COUNT = 5, 3
ALPHABET = 26 + 64
#: Words up to this length go through the trie, a level for each letter; edges name the lengths of the words below them in the bits of a long.
LONG = 62
#: Edges at these depths number at most ALPHABET, ALPHABET ** 2: small enough to be broadcast.
BROADCAST_DEPTH = 2
#: Distinct words that a task holds before it passes on their counts.
HELD = 200_000


def text_words(doc_id, text: str, chosen: int = 97) -> Iterator[list[bytes]]:
    """The words of a text in Latin-1, in blocks; those whose hash with the id is a multiple of ``chosen`` without one letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for block in word_blocks(text.encode("latin-1", "replace").translate(_TABLE)):
        known = list(set(block))
        hashes = np.fromiter(map(zlib.crc32, b" ".join(known).decode("latin-1").encode().split(b" "), repeat(start)), np.int64, len(known)) if known else np.zeros(0, np.int64)
        cut = {}
        for i in np.flatnonzero(hashes % chosen == 0).tolist():
            at = int(hashes[i]) % len(known[i])
            cut[known[i]] = known[i][:at] + known[i][at + 1 :]
        yield [cut.get(w, w) for w in block] if cut else block


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        kept = [(w, n) for w, n in found.items() if len(w) >= LEAST_LENGTH]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    for part in text_rows(batches):
        for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
            for block in text_words(doc, text or ""):
                found.update(block)
                if len(found) >= HELD:
                    yield out()
    if found:
        yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """Words of all whole texts with their counts: (word, n), of ``LEAST_LENGTH`` letters and ``least`` occurrences or more. Null texts have no
    words, a null id hashes as an empty one; repeated rows count as often as they occur."""
    parts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def trie_edges(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's edges (depth, child, lengths) and forks (depth, node, kids), written.

    ``depth`` counts the letters of the node above; nodes are named by their letters. ``lengths`` has a bit for each number of letters that
    words below the child have left. A fork is a node of several edges, at most ``ALPHABET``, with their letters, children and lengths.
    """
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("depth"))
    steps = steps.select("depth", F.substring("word", F.lit(1), F.col("depth") + 1).alias("child"), (F.char_length("word") - F.col("depth") - 1).alias("left"))
    edges = written(steps.groupBy("depth", "child").agg(F.bit_or(F.expr("shiftleft(1L, left)")).alias("lengths")), "edges")
    kids = edges.groupBy("depth", F.substring("child", F.lit(1), F.col("depth")).alias("node")).agg(F.collect_list(F.struct("child", "lengths")).alias("kids"))
    return edges, written(kids.where(F.size("kids") > 1), "forks")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (word, near) of the distinct ``words`` (a column word, at most ``LONG`` letters each) that differ by exactly one inserted, deleted or
    replaced letter. Each pair occurs once, in one direction.

    Edges near the root, at most 90 and 8,100, are broadcast; others are joined by shuffles, on the letters that lead to them, whose hot
    ones Spark can split. Each level's states are written, so a lost executor costs one level.
    """
    edges, forks = trie_edges(words)
    letter = lambda at: F.substring("word", at, F.lit(1))
    length = F.char_length("word")
    longest = words.agg(F.max(length)).first()[0] or 0
    states = words.sparkSession.createDataFrame([], "word string, pos int, node string")
    reached = []
    for level in range(longest):
        known, forking = (x.where(F.col("depth") == level).drop("depth") for x in (edges, forks))
        if level < BROADCAST_DEPTH:
            known, forking = F.broadcast(known), F.broadcast(forking)
        reading = words.where(length > level).select("word", F.substring("word", 1, level).alias("at"))
        # Another letter's edge, a larger one's, below which the rest of the word may fit.
        other = reading.join(forking, F.col("at") == F.col("node")).select("word", F.explode("kids").alias("kid"))
        other = other.where((F.col("kid.child") > F.substring("word", 1, level + 1)) & (F.getbit("kid.lengths", length - level - 1) == 1))
        # Without this letter, the last of equal ones; then all states with an edit follow the word's next letter.
        skipped = reading.where((length > level + 1) & (letter(F.lit(level + 1)) != letter(F.lit(level + 2)))).select("word", F.lit(level + 1).alias("pos"), F.col("at").alias("node"))
        going = states.where(F.col("pos") < length).unionByName(skipped)
        going = going.select("word", (F.col("pos") + 1).alias("pos"), F.concat("node", letter(F.col("pos") + 1)).alias("to"))
        going = going.join(known, F.col("to") == F.col("child")).where(F.getbit("lengths", length - F.col("pos")) == 1)
        states = written(going.select("word", "pos", F.col("to").alias("node")).unionByName(other.select("word", F.lit(level + 1).alias("pos"), F.col("kid.child").alias("node"))), "states")
        reached.append(states.where(F.col("pos") == length).select("word", F.col("node").alias("near")))
    # Without the last letter nothing is left to read.
    cut = words.select("word", F.expr("substring(word, 1, char_length(word) - 1)").alias("cut"))
    pairs = cut.join(words.select(F.col("word").alias("near")), F.col("cut") == F.col("near")).select("word", "near")
    for found in reached:
        pairs = pairs.unionByName(found)
    return pairs


_PRIMES, _BASE = (2_147_483_647, 2_147_483_629), 1_000_003


def deletion_hashes(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a word's letters, the last of equal ones that follow each other, and a hash of the word without that letter. The last hash is that of
    the whole word, with its length for a place."""
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    n, out = len(letters), []
    for prime in _PRIMES:
        powers = np.ones(1, np.int64)
        while len(powers) < n:
            powers = np.concatenate([powers, powers * (int(powers[-1]) * _BASE % prime) % prime])
        before = np.concatenate([[0], np.cumsum(letters * powers[:n] % prime) % prime])
        after = (before[n] - before[1:]) % prime * pow(_BASE, -1, prime) % prime
        out.append(np.append((before[:-1] + after) % prime, before[n]))
    places = np.append(np.flatnonzero(np.append(letters[1:] != letters[:-1], True)), n)
    return places, (out[0] << 31 | out[1])[places]


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            places, hashes = deletion_hashes(word)
            left = np.append(np.full(len(places) - 1, len(word) - 1), len(word))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(left, pa.int64()), pa.array(hashes, pa.int64())], names=["id", "left", "hash"])


def long_pairs(words: DataFrame) -> DataFrame:
    """``near_pairs`` of words of ``LONG`` letters or more, where at least one has more: a level for each letter would be too many. Words without
    one letter are joined by a rolling hash, in rows that are as many as the letters; what is joined is compared again."""
    long = written(words.where(F.char_length("word") >= LONG).select(F.sha2("word", 256).alias("id"), "word"), "long")
    if long.where(F.char_length("word") > LONG).isEmpty():
        return words.sparkSession.createDataFrame([], "word string, near string")
    keys = written(long.mapInArrow(_hash_rows, "id string, left bigint, hash bigint"), "hashes")
    a, b = keys.select("left", "hash", F.col("id").alias("a")), keys.select("left", "hash", F.col("id").alias("b"))
    pairs = written(a.join(b, ["left", "hash"]).where("a < b").select("a", "b").distinct(), "candidates")
    found = pairs.join(long.select(F.col("id").alias("a"), "word"), "a").join(long.select(F.col("id").alias("b"), F.col("word").alias("near")), "b")
    both = (F.char_length("word") > LONG) | (F.char_length("near") > LONG)
    return found.where(both & (F.levenshtein("word", "near", 1) == 1)).select("word", "near")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links that never lead back: what the links of a word end at, by doubling, in as many rounds as the logarithm of the
    longest way."""
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("w"), F.col("root").alias("r"))
        after = written(links.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        links = after.select("word", "root")


def variants(counts: DataFrame, factor: int = 2) -> DataFrame:
    """One row for each of the distinct words of ``counts`` (word, n): word, n, n_near, form, form_n, root.

    Near words differ by exactly one inserted, deleted or replaced letter. The form is the near word of largest n (the smallest in code-point
    order if several have it) if that is at least ``factor`` times n; the root is what the forms lead to, the word itself without a form.
    An empty table gives no rows.
    """
    counts = written(counts, "words")
    words = counts.select("word")
    pairs = written(near_pairs(words.where(F.char_length("word") <= LONG)).unionByName(long_pairs(words)), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    known = both.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    best = written(best.select(F.col("word").alias("w"), "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n")), "best")
    large = F.col("near_n") >= factor * F.col("n")
    found = counts.join(best, F.col("word") == F.col("w"), "left")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("near")).alias("form"), F.when(large, F.col("near_n")).alias("form_n")), "forms")
    roots = last_forms(found.where("form is not null")).select(F.col("word").alias("w"), "root")
    return found.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
