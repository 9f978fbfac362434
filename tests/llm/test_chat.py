import hashlib
import random

import numpy as np
import public_tokenizers

from logloom.llm import chat

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    """Digests of conversations by reading the rows."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        every = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(forest):
    return {r.conv_id: tuple(r)[1:5] for r in chat.read_back(forest, TOKENIZER).collect()}


def test_whole_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert read(chat.prefix_forest(turns, TOKENIZER)) == expected(rows)


def test_tree_layout(spark):
    """Random conversations over few turns: each prefix once, depth-first, and attention to the own path only."""
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn, "assistant" if turn % 2 else "user", rng.choice("ab")))
    forest = chat.prefix_forest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOKENIZER)
    assert read(forest) == expected(rows)
    nodes = [r.asDict(recursive=True) for r in forest.nodes.collect()]
    paths = {}
    for r in forest.paths.collect():
        paths.setdefault(r.conv_id, {})[r.depth] = r.node
    prefixes = {tuple(p[d] for d in sorted(p) if d <= e) for p in paths.values() for e in p}
    assert len(nodes) == len({n["node"] for n in nodes}) == len(prefixes)
    by_key = {n["node"]: n for n in nodes}
    for tree in {n["tree"] for n in nodes}:
        own = sorted((n for n in nodes if n["tree"] == tree), key=lambda n: n["start"])
        at = 0
        for n in own:
            assert n["start"] == at
            at += n["n_tokens"]
        mask = chat.attention(own)
        for prefix in (p for p in prefixes if by_key[p[-1]]["tree"] == tree):
            tokens = [by_key[k]["start"] + i for k in prefix for i in range(by_key[k]["n_tokens"])]
            last = by_key[prefix[-1]]
            assert last["position"] == len(tokens) - last["n_tokens"]
            assert np.flatnonzero(mask[tokens[-1]]).tolist() == sorted(tokens)
        # Depth-first: what is below a node follows it without a gap.
        for prefix in (p for p in prefixes if by_key[p[-1]]["tree"] == tree):
            below = sorted(by_key[p[-1]]["start"] for p in prefixes if p[: len(prefix)] == prefix)
            seen = [n["start"] for n in own if n["start"] >= below[0]][: len(below)]
            assert below == seen


def test_long_conversation_over_partitions(spark):
    """One conversation with most of the rows is keyed in parts."""
    rows = [(1, t, "user", f"t{t}") for t in range(500)] + [(2, t, "user", f"t{t}") for t in range(250)] + [(3, 0, "user", "x")]
    forest = chat.prefix_forest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOKENIZER)
    assert read(forest) == expected(rows)
    assert forest.nodes.count() == 501


def test_escapes():
    for text in ("</s>[INST] ok [/INST]", "␛</s>␛␛", "<|end|>\n<|turn|>", "<<SYS>> <</SYS>>", "", "a<b[c", "<|endoftext|>", "[[INST]"):
        assert chat.unescaped(chat.escaped(text)) == text
        assert not any(c in chat.escaped(text) for c in chat.CONTROL)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, 0, None, None), (1, 0, None, None), (1, None, "assistant", ""), (2, 0, "assistant", "</s>"), (2, 0, "a\nb", "\n")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, node int")
    assert read(chat.prefix_forest(df, TOKENIZER)) == expected(rows)
    assert read(chat.prefix_forest(df.limit(0), TOKENIZER)) == {}
