"""Quality rules: hashed n-gram log-likelihood ratio of trusted texts against the raw corpus.

Words and punctuation runs, and pairs of neighbours, are hashed into ``BUCKETS``. Two multinomials over the buckets are
counted: one over trusted documents, one over all documents. A document's score is the mean, over
its n-grams, of log p(trusted) - log p(raw). Every document is held against one threshold, which separates labelled documents
best: the ones of low quality from trusted ones that the counts don't include, since a document scores higher for
being counted. All labels are used, in joins and running totals. Base rules on counts come first.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.llm._scan import running_totals
from logloom.llm._spark import small, text_rows, written

BUCKETS = 1 << 14
SAMPLE = 20_000  # ids that the tests look at; `assess` has no such bound
BROADCAST = 100_000  # labelled ids that are broadcast at most; more are joined by a shuffle, with the same result
FEW_WORDS = 50
REPEATED = 50  # percent
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Packed 32-bit hashes of the tokens of a space-separated word."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 600_000:
            self.clear()
        packed = array("I", [zlib.crc32(t.encode()) for t in ([word] if word.isalnum() else _TOKEN.findall(word))]).tobytes()
        if len(word) < 200:
            self[word] = packed
        return packed


def ngram_buckets(text: str, known: dict, buckets: int = BUCKETS, block: int = 1 << 22) -> Iterator[np.ndarray]:
    """Buckets of all tokens and of all pairs of neighbours, in blocks, the last token of each carried over."""
    last = None
    for part in _blocks(text, block):
        tokens = np.frombuffer(b"".join(map(known.__getitem__, part.split())), np.uint32).astype(np.uint64)
        if not len(tokens):
            continue
        chain = tokens if last is None else np.append(last, tokens)
        pairs = (chain[:-1] * np.uint64(0x9E3779B97F4A7C15) + chain[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        yield (np.concatenate([tokens, pairs]) % np.uint64(buckets)).astype(np.int64)
        last = tokens[-1:]


def _blocks(text: str, block: int) -> Iterator[str]:
    """Cuts of a text before white space."""
    at = 0
    while at < len(text):
        end = at + block
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null is empty."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    joined = b"".join(words)
    chars = n and len(joined.decode())
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            repeats += line in lines
            lines.add(line)
    return n, chars, symbols, repeats, _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words in a window of three words that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # keeps the numbers of windows within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    often = np.zeros(len(windows), bool)
    often[order[1:]] |= same
    often[order[:-1]] |= same
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + len(windows)] |= often
    return int(covered.sum())


def _ids(labels: DataFrame, trusted: bool) -> DataFrame:
    """The distinct ids of trusted rows, or of rows of low quality."""
    if trusted:
        wanted = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    else:
        wanted = F.col("quality") == 0
    return labels.where(wanted & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def _sample(labels: DataFrame, trusted: bool, most: int) -> list[int]:
    """At most ``most`` labelled ids, the first by hash, as tests see the order that ``halves`` goes by."""
    return [r.doc_id for r in _ids(labels, trusted).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def halves(labels: DataFrame) -> DataFrame:
    """(doc_id, counted): every trusted id; by hash, every other one is counted and the rest are held out."""
    ids = _ids(labels, True).select("doc_id", F.xxhash64("doc_id").alias("__hash"), F.lit(1).cast("long").alias("__one"))
    placed = running_totals(ids, [], ["__hash", "doc_id"], "__one", "__place")
    return written(placed.select("doc_id", (F.col("__place") % 2 == 0).alias("counted")), "trusted")


def count_ngrams(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): counts over all documents, and over those whose id is in ``trusted`` (doc_id, distinct). Each task adds up what it reads."""
    marks = small(trusted.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__trusted")), BROADCAST)
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(marks, "__id", "left").select("__text", "__trusted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, target = _Hashes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in text_rows(batches):
            of_raw, of_target = [], []
            for text, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = [*ngram_buckets(text or "", known, buckets)]
                of_raw += found
                if own:
                    of_target += found
            if of_raw:
                raw += np.bincount(np.concatenate(of_raw), minlength=buckets)
            if of_target:
                target += np.bincount(np.concatenate(of_target), minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counts = marked.mapInArrow(run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray | None:
    """log p(trusted) - log p(raw) by bucket, both smoothed; None without trusted counts. ``counts`` has at most ``buckets`` rows."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return None
    # What a bucket would hold by the raw shares is its pseudo-count: unseen buckets then say little.
    share = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets)
    weight = SMOOTHING * buckets
    return np.log((target + weight * share) / (target.sum() + weight)) - np.log(share)


def score(text: str, ratios: np.ndarray, known: dict) -> float:
    total, n = 0.0, 0
    for found in ngram_buckets(text, known, len(ratios)):
        total, n = total + float(ratios[found].sum()), n + len(found)
    return total / n if n else 0.0


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut that tells good from bad best (the sum of both rates of right answers, the lowest of equals), halfway
    between the scores beside it. Without bad scores nothing is cut off, without good ones neither."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), values, "left") / len(good)
    caught = np.searchsorted(np.sort(bad), values, "left") / len(bad)
    best = int(np.argmax(np.round(kept + caught, 12)))
    return float(values[best]) if best == 0 else float((values[best - 1] + values[best]) / 2)


def cut(scores: DataFrame) -> float:
    """``threshold`` of a table (good boolean, score double) of any size. With the scores below a cut summed up, a bad one for as much as there
    are good ones and a good one for minus as much as there are bad ones, the best cut has the largest sum: whole numbers, so equals are equal."""
    n = scores.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if not n.good or not n.bad:
        return -np.inf
    steps = scores.groupBy("score").agg((F.count_if(~F.col("good")) * n.good - F.count_if("good") * n.bad).alias("step"))
    gains = written(running_totals(steps, [], ["score"], "step", "gain"), "gains")
    best = gains.orderBy(F.desc("gain"), "score").first().score
    below = gains.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return best if below is None else (below + best) / 2


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def scored(docs: DataFrame, ratios: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, the base counts and the score (0 without a model, and for texts without n-grams) of every row; with ``whole``
    also the row's own columns, named by their places."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)
    kept = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)] if whole else [F.col(text_col).alias("__0")]
    names = ["doc_id", *[c.split()[0] for c in SCORED.split(", ")], *([f"__{i}" for i in range(len(kept))] if whole else [])]
    at = 1 + (docs.columns.index(text_col) if whole else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part in text_rows(batches):
            texts = part.column(at).to_pylist()
            counts = [pa.array(c, pa.int64()) for c in zip(*map(base_counts, texts), strict=True)]
            scores = [0.0 if model.value is None else score(t or "", model.value, known) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(scores, pa.float64()), *(part.columns[1:] if whole else [])], names)

    given = docs.select(F.col(id_col).alias("doc_id"), *kept)
    schema = StructType([given.schema["doc_id"], *StructType.fromDDL(SCORED), *(given.schema.fields[1:] if whole else [])])
    return given.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, whole: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, score, base_failed and kept; with ``whole`` also the row's own
    columns, named by their places (__0, __1 and so on).

    ``labels`` (doc_id, quality, toxic) gives trusted ids (quality 1, not toxic), of which every other one is counted and the rest are held
    out for the threshold, and those of quality 0; all of them are used, and counts and scores cover all documents. Null ids are scored and never trusted. Null and empty texts have
    no words, so they fail the base rules. Without usable labels the base rules decide alone. Repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    trusted = halves(labels)
    counted = trusted.where("counted")
    ratios = None if counted.isEmpty() else log_ratios(count_ngrams(docs, counted, buckets, id_col, text_col), buckets)
    rows = written(scored(docs, ratios, id_col, text_col, whole), "scored")
    least = -np.inf
    if ratios is not None:
        held = trusted.where("not counted").select("doc_id", F.lit(True).alias("good"))
        known = written(held.unionByName(_ids(labels, False).withColumn("good", F.lit(False))), "known")
        told = rows.where(f"n_words >= {FEW_WORDS}").select("doc_id", "score").join(small(known, BROADCAST), "doc_id")
        least = cut(written(told.select("good", "score"), "told"))
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= least))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, each by the verdict on its own text: null ids and ids that occur repeatedly make no difference."""
    kept = assess(docs, labels, id_col, text_col, whole=True).where("kept")
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
