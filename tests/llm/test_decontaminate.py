"""Benchmark decontamination against brute force over all windows, and its odd cases."""

import hashlib
import random
import re

from logloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = split(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault((*w[i : i + k],), set()).add(name)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                found = windows.get((*w[i : i + k],))
                if found:
                    hit.update(range(i, i + k))
                    names |= found
        listed = sorted(str(n) for n in names if n is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def random_tables(seed):
    """Few words, so that windows overlap, repeat and lie within each other."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "\u00e9t\u00e9", "\u00c9", "x9"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 5, 8, 14, 30]) if rng.random() < 0.9 else 4)) for i in range(1, 25)]
    items = [(i, t) for i, t in items if len(split(t)) != 1] + [(3, items[5][1]), (None, "c c c c c"), (99, None), (98, " .,- ")]
    docs = [(i, text(rng.choice([0, 2, 7, 60, 200]))) for i in range(40)] + [(None, items[4][1]), (7, None), (7, None), (8, ".")]
    return docs, items


def test_brute_force(spark):
    for seed in range(3):
        docs, items = random_tables(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = sorted((tuple(r) for r in decontaminate.contaminated(d, b).collect()), key=str)
        assert got == sorted(brute(docs, items), key=str)


def test_blocks_find_the_same(spark):
    docs, items = random_tables(11)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontaminate.overlaps(d, b, window=5).drop("longest").collect()))
    many = decontaminate.overlaps(d, b, window=5, block_words=24)
    assert decontaminate.indexes(b, "item_id", "text", 5, 24).count() > 3
    strip = lambda rows: sorted(re.sub("longest=\\d+, ", "", x) for x in rows)
    assert strip(map(str, many.collect())) == strip(one)


def test_longest_matches():
    """The matching length after each word is that of the longest sequence of item words that ends there."""
    rng = random.Random(4)
    for _ in range(200):
        items = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        known = {(*x[i:j],) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        longest = [max((k for k in range(1, i + 1) if (*text[i - k : i],) in known), default=0) for i in range(1, 31)]
        index = decontaminate.Index([(str(i), x) for i, x in enumerate(items)], 4)
        n, _, most, matches, _ = index.scan(b" ".join(text).decode(), 3)
        ends = [(i + 1 - k, i + 1) for i, k in enumerate(longest) if k >= 3 and (i == 29 or longest[i + 1] <= k)]
        assert (n, most) == (30, max(longest)) and decontaminate._merged(map(tuple, matches)) == decontaminate._merged(ends)
        assert len(index.length) <= 2 * sum(map(len, items)) + 1


def test_removal(spark):
    """Passages go, with what stands between their words; documents that are mostly passage go whole; the rest stays."""
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"First, some Text before.\n{passage.upper()}! And a long rest of the text that stays, with many words of its own."), (2, f"x {passage}"), (3, "clean text"), (4, None), (5, "")]
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, overlap string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(d.drop("overlap"), b).collect()}
    assert got == {1: "First, some Text before.\n! And a long rest of the text that stays, with many words of its own.", 3: "clean text", 4: None, 5: ""}
    assert decontaminate.decontaminate(d.drop("overlap"), b, coverage_limit=1.0).count() == 5
    assert decontaminate.overlaps(d, b).columns == ["doc_id", "text", "overlap"]


def test_empty_tables_and_long_texts(spark):
    d = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.contaminated(d, none).collect()] == [(3, 0, 0)]
    assert decontaminate.contaminated(d.limit(0), spark.createDataFrame([(1, "one two")], "item_id long, text string")).count() == 0
    long = spark.createDataFrame([(1, "word other " * 900_000 + "a b c d e f g h i j k"), (2, "z" * 5_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "b c d e f g h i j k l"), (6, "q " * 500_000)], "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.contaminated(long, items).collect()) == [(1, 1_800_011, 10, 1), (2, 1, 0, 0)]
