"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from logloom.llm import queries, spelling

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counted(docs, least=3):
    found = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= least}


def brute(counts):
    """Near words by the words without one letter, then compared one by one."""
    parts = {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            parts.setdefault(key, []).append(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: set() for w in counts}
    for group in parts.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return sorted(out)


def variants(spark, counts):
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(map(tuple, spelling.variants(rows).collect()))


def test_brute_force(spark):
    """Words of three letters that are dense in near ones, with repeated letters."""
    rng = random.Random(5)
    counts = {"".join(rng.choice("ab\u00e9") for _ in range(rng.randrange(5, 9))): rng.choice([3, 4, 6, 8, 12, 12, 100]) for _ in range(900)}
    assert variants(spark, counts) == brute(counts)


def test_long_words(spark):
    """Lengths around the last level of the trie, and far beyond it."""
    rng = random.Random(6)
    counts = {}
    for size in (60, 61, 62, 63, 64, 3000):
        word = "".join(rng.choice("abc") for _ in range(size))
        counts[word] = 50
        for _ in range(12):
            at = rng.randrange(size)
            for v in (word[:at] + word[at + 1 :], word[:at] + "d" + word[at + 1 :], word[:at] + "d" + word[at:]):
                counts.setdefault(v, rng.randrange(3, 60))
    assert variants(spark, counts) == brute(counts)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(counted(docs))


def test_odd_rows(spark):
    long = "z" * 3_000_000
    docs = [(None, "Straße \u00d7\u00f7 ÀÉ naïve NAÏVE na\u0131ve"), (1, None), (2, ""), (2, "naïve-naïve"), (2, "naïve-naïve"), (3, "words " * 400_000), (4, long), (5, long), (6, long)]
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.word_counts(rows).collect()}
    assert got == counted(docs)
    assert spelling.variants(spelling.word_counts(rows.limit(0))).collect() == []
