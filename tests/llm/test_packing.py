"""The order of packing against a deficit round-robin that runs round by round, and what windows hold."""

import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from logloom.llm import packing, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")


def served_by_rounds(tokens, weights, size, burst):
    """What each queue was served before each round, by carrying deficits from round to round."""
    n = len(tokens)
    start = [Fraction(i * packing._GOLDEN % packing._PHASE, packing._PHASE) for i in range(n)]
    left, deficit, served = [Fraction(t) for t in tokens], [Fraction(0)] * n, [0] * n
    rounds = [[*served]]
    while any(left):
        credit = Fraction(size)
        while credit and any(left):  # a queue that ends leaves its share of the round to the others
            live = [i for i in range(n) if left[i]]
            step = min(credit / sum(weights[i] for i in live), *(left[i] / weights[i] for i in live))
            for i in live:
                left[i] -= step * weights[i]
                deficit[i] += step * weights[i]
                credit -= step * weights[i]
        for i in range(n):
            while served[i] < tokens[i]:
                due = min(burst, tokens[i] - served[i])
                if any(left) and deficit[i] + start[i] * due < due:
                    break
                served[i] += due
                deficit[i] -= due
        rounds.append([*served])
    return rounds


def test_closed_form_is_the_round_robin():
    rng = random.Random(5)
    for _ in range(150):
        tokens = [rng.choice([0, 1, 5, 16, rng.randint(1, 2000)]) for _ in range(rng.randint(1, 8))]
        weights = [rng.choice([max(1, t), 1, rng.randint(1, 50)]) for t in tokens]
        window, stretch, burst = rng.choice([32, 64]), rng.choice([1, 3]), rng.choice([1, 7, 16])
        if not any(tokens):
            continue
        rounds = served_by_rounds(tokens, weights, window * stretch, burst)
        plan = packing.Plan(tokens, weights, window, burst, stretch)
        assert [[*plan.served(k)] for k in range(len(rounds))] == rounds
        packing.VECTOR = 0
        assert [[*plan.served(k)] for k in range(len(rounds))] == rounds
        packing.VECTOR = 64
        order = [(i, x) for a, b in zip(rounds, rounds[1:]) for i in range(len(tokens)) for x in range(a[i], b[i])]
        place = {}
        for i, t in enumerate(tokens):
            at = 0
            while at < t:
                length = min(t - at, rng.randint(1, 200))
                for offset, n, where in plan.pieces(i, at, length):
                    place |= {where + x: (i, at + offset + x) for x in range(n)}
                at += length
        assert [place[x] for x in range(sum(tokens))] == order


def shares(tokens, weights, **given):
    plan = packing.Plan(tokens, weights, packing.WINDOW, packing.BURST, **given)
    held = defaultdict(Counter)
    for i, t in enumerate(tokens):
        for _, n, place in plan.pieces(i, 0, t):
            held[place // packing.WINDOW][i] += n
    return plan, held


def test_each_window_holds_each_source():
    """One source of nine tenths and a hundred of a thousandth each: every full window has them within two bursts."""
    for big in (0, 50, 100):
        tokens = [900_000 if i == big else 1000 for i in range(101)]
        plan, held = shares(tokens, tokens)
        for k in range(plan.total // packing.WINDOW):
            assert sum(held[k].values()) == packing.WINDOW and 0.88 <= held[k][big] / packing.WINDOW <= 0.92
            assert all(abs(held[k][i] - packing.WINDOW * t / plan.total) <= 2 * packing.BURST for i, t in enumerate(tokens) if i != big)


def test_given_weights_fill_windows():
    """Weights 5, 3 and 2 until the first queue ends, then those that are left."""
    plan, held = shares([100_000, 200_000, 300_000], [5, 3, 2])
    for k in range(200_000 // packing.WINDOW - 1):
        assert all(abs(held[k][i] - packing.WINDOW * w / 10) <= 2 * packing.BURST for i, w in enumerate((5, 3, 2)))
    for k in range(200_000 // packing.WINDOW + 1, 420_000 // packing.WINDOW):
        assert all(abs(held[k][i] - packing.WINDOW * w / 5) <= 2 * packing.BURST for i, w in ((1, 3), (2, 2))) and not held[k][0]


def test_weights_hold_beyond_the_queues(spark):
    """Few queues of their own, many sources: the weighted ones keep theirs, and every full window has their proportions."""
    rows = [(i, "word " * (40 if i % 3 == 0 else 8), "a" if i % 3 == 0 else "b" if i % 3 == 1 else f"s{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = {i: s for i, _, s in rows}
    pieces = packing.pack(docs, WORDS, weights={"a": 1, "b": 3, "nowhere": 7}, queues=1).collect()
    held = defaultdict(Counter)
    for p in pieces:
        held[p.sequence_id][sources[p.doc_id]] += p.length
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in {p.doc_id: p for p in pieces}.values())
    full = max(held)
    # The other sources weigh as their tokens do, far more than 1 or 3, so they end first; then a and b are left, one to three.
    ends = max(k for k in held if any(s.startswith("s") for s in held[k])) + 1
    both = [k for k in range(ends, full) if held[k]["a"] and held[k]["b"]]
    assert all(abs(held[k]["b"] - packing.WINDOW * 3 / 4) <= 2 * packing.BURST for k in both[:-1]) and len(both) > 1


def test_whole_order_by_brute_force(spark, sf_dir):
    """The pieces of the whole table, put in order, are what the round-robin deals from the queues."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, WORDS).collect()
    reader = Tokenizer.from_file(WORDS)
    source = dict(docs.select("doc_id", "source").collect())
    length = {r.doc_id: len(reader.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    names = sorted(set(source.values()))
    totals = [sum(n for i, n in length.items() if source[i] == s) for s in names]
    rounds = served_by_rounds(totals, totals, packing.WINDOW, packing.BURST)
    want = [s for a, b in zip(rounds, rounds[1:]) for i, s in enumerate(names) for _ in range(a[i], b[i])]
    got, progress = [], Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == progress[p.doc_id]  # a document's tokens come in order
        progress[p.doc_id] += p.length
        got += [source[p.doc_id]] * p.length
    assert got == want and progress == length


def test_query_pads(spark, sf_dir):
    rows = queries.op9_packing(spark, sf_dir).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert all(r.padded_length == packing.padded_length(used[r.sequence_id]) for r in rows)
    built = {r.sequence_id: len(r.ids) for r in packing.sequences(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORDS)).collect()}
    assert built == {k: packing.padded_length(n) for k, n in used.items()}


def test_very_long_text_and_clashing_columns(spark):
    rows = [(1, "ab cd " * 900_000, "a", 1, "x"), (2, None, None, 2, "y"), (2, None, None, 2, "y"), (None, "z", "", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, queue int, base string")
    pieces = packing.pack(docs, WORDS).collect()
    ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted((p for p in pieces if p.doc_id == 1), key=lambda p: p.start)])
    assert ids.tolist() == [*Tokenizer.from_file(WORDS).encode(rows[0][1], add_special_tokens=False).ids, packing.END]
    assert Counter(p.doc_id for p in pieces if p.doc_id != 1) == {2: 2, None: sum(p.doc_id is None for p in pieces)}


def test_many_queues(spark, monkeypatch):
    """Cuts sorted by round give the pieces that whole documents do, and a core places over half a million tokens a second from 5,000 queues."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * rng.randrange(1, 400), f"s{rng.randrange(40)}") for i in range(400)], "doc_id long, text string, source string")
    key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset, bytes(r.ids), r.doc_tokens, r.padded_length)
    whole = sorted(map(key, packing.pack(docs, WORDS).collect()))
    monkeypatch.setattr(packing, "MANY", 1)
    assert sorted(map(key, packing.pack(docs, WORDS).collect())) == whole
    tokens = [rng.randrange(1000, 3000) for _ in range(5000)]
    plan = packing.Plan(tokens, tokens, packing.WINDOW, packing.BURST)
    cuts = sorted((about, i, at, n) for i, t in enumerate(tokens) for about, at, n in plan.cuts(i, 0, t))
    assert sum(n for *_, n in cuts) == sum(tokens)
    began, places = time.process_time(), 0
    for about, i, at, n in cuts[: len(cuts) // 4]:
        places += sum(length for _, length, _ in plan.pieces(i, at, n, about))
    assert places / (time.process_time() - began) > 500_000
