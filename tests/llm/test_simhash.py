import numpy as np
import xxhash

from logloom.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert want == {i: simhash.fingerprint(t) for i, t in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect()}
    roots = components(want, 2)
    assert got == {i: (want[i], roots[i]) for i in want}


def test_dense_tiles(spark):
    """Many near fingerprints in few tiles, split small: same components as all pairs."""
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 5).tolist():
        for _ in range(120):
            prints.add(base ^ sum({1 << int(b) for b in rng.integers(0, 24, rng.integers(0, 5))}))
    prints = sorted(prints)
    want = components(dict.fromkeys(prints) | {p: p for p in prints}, 2)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for tile in (16, 4096):
        from logloom.llm._components import connected_components

        edges = simhash.near_edges(df, tile=tile)
        found = {r.node: r.component for r in connected_components(edges).collect()}
        assert {p: found.get(p, p) for p in prints} == want


def test_long_text_in_blocks():
    text = "one two three four five " * 60000
    assert simhash.fingerprint(text) == brute_print(text)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "a b c d", 3), (4, "a b c d", 4), (4, "a b c d", 4), (5, " \n\t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (4, 4), (4, 4), (5, 1)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert sorted(r.fp for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3, 4, 4]


def test_width_and_radius(spark):
    """Texts of 5-word Jaccard 0.87: their fingerprints of 3 words are 8 bits apart, those of 5 words 4 bits."""
    words = [f"w{i}" for i in range(300)]
    other = [f"x{i // 40}" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"v{i}" for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda **given: sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, **given).collect())
    assert kept() == kept(width=5, radius=3, parts=1) == kept(radius=7, parts=1) == [1, 2, 3]
    assert kept(width=5, radius=4, parts=2) == kept(radius=8, parts=1) == [1, 3]
    got = {r.doc_id: r.fp % 2**64 for r in simhash.simhash_components(docs, width=5).collect()}
    assert got == {i: simhash.fingerprint(t, 5) for i, t in rows}
