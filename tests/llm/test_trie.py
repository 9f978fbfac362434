"""The prefix trie of conversations against brute force, in slices and bands of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

from logloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def grafted(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    cut = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: cut[c]] + own[c][cut[c] :] for c in own}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[(*turns[:d],)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=300, long=9):
    """Conversations of few turns that share beginnings, copies of one, and one long one."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "été", "", None]))
    rows = []
    for c in range(n):
        if rng.random() < 0.05:
            continue
        turns = [("user", "same"), ("assistant", "copy"), ("user", "x")] if c % 3 == 0 else [turn() for _ in range(rng.randrange(1, long))]
        rows += [(c, i if i else None, *t) for i, t in enumerate(turns)]
    rows += [(100_057, i, *turn()) for i in range(60)] + [(700_001, 0, "user", "only"), (None, 0, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def got(spark, rows, **options):
    turns, members = trie.grafted(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, trie.prefix_trie(turns, members, **options).collect()), key=str)


def test_brute_force(spark):
    rows = rows_of(1)
    want = brute(grafted(rows))
    assert got(spark, rows) == want
    assert got(spark, rows, slice_bytes=64, chunk=3) == want


def test_bands(spark):
    """Bands of two turns: keys are cut, nodes where bands meet are counted once."""
    rows = rows_of(2, 120, 7)
    assert got(spark, rows, band=2, slice_bytes=100, chunk=2) == brute(grafted(rows))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_trie(spark, sf_dir).collect()), key=str) == brute(grafted(rows))


def test_odd_tables(spark):
    assert got(spark, []) == []
    alone = [(5, 0, "user", "a")] if zlib.crc32(b"5") % 6 else [(5, i, "user", "a") for i in range(1)]
    assert got(spark, alone) == brute(grafted(alone))
    ties = spark.createDataFrame([(1, 0, "user", "a", 3), (1, 0, "user", "a", 4), (1, None, None, None, 5)], SCHEMA + ", depth long")
    turns, members = trie.ungrafted(ties)
    assert sorted((r.depth, r.n_convs, r.n_leaves) for r in trie.prefix_trie(turns, members).collect()) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_radix_tree():
    """Every layout, and path compression: all keys are found in order."""
    rng = random.Random(3)
    keys = {bytes(rng.choice(range(n)) for _ in range(rng.choice([0, 2, 4, 6]))) for n in (3, 10, 40, 256) for _ in range(2000)}
    tree, order = trie.Node(b""), sorted(keys)
    for i in rng.sample(range(len(order)), len(order)):
        trie.insert(tree, order[i], i)
    found, layouts, stack = [], set(), [(tree, b"")]

    def walk(node, path):
        path += node.shared
        layouts.add(node.layout)
        if node.value is not None:
            found.append((path, node.value))
        assert node.value is not None or len(node.children()) != 1
        for byte in range(256):
            if node.child(byte):
                walk(node.child(byte), path + bytes([byte]))

    walk(*stack[0])
    assert found == [(k, i) for i, k in enumerate(order)] and layouts == {4, 16, 48, 256}
