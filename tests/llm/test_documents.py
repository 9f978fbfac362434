"""Operators on documents, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logloom.llm import licenses, mixing, packing, quality, queries, secrets, sharding
from logloom.llm.tokens import WordTokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x y", None), (3, "x y", None), (4, "w " * 30_000, "b")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "z") for r in ODD], "doc_id long, text string, source string, size int, shard string")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    same([tuple(r[n] for n in names) for r in df.collect()], [tuple(r) for r in cur.fetchall()])


def test_licenses(spark, odd):
    mit = next(t for name, t in licenses.KNOWN if name == "MIT" and len(t) > 500)
    texts = [
        ("whole", "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " --"), "MIT", "", 0),
        ("wrapped", mit.replace(" ", "\n"), "MIT", "", 0),
        ("line", "Some prose here.\nLicenced under the Apache Licence, version 2.0", None, "Apache-2.0", 1),
        ("block", f"Prose.\n\n{licenses.KNOWN[-1][1].splitlines()[0]}\n\nMore.", None, "", 0),
        ("twice", "Released under the MIT license!\nreleased UNDER the mit License", None, "MIT", 2),
        ("none", "Released under the MIT License in spirit.", None, "", 0),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(texts)], "doc_id long, text string")
    got = {texts[r.doc_id][0]: (r.text_license, r.licenses, r.n_matches) for r in licenses.match(df).collect()}
    assert got == {k: (w, s, n) for k, _, w, s, n in texts}
    rows = licenses.match(odd).collect()
    assert len(rows) == len(ODD) and {r.text_license for r in rows} == {None}
    assert licenses.match(odd.limit(0)).count() == 0


def test_sharding(docs, odd):
    for df in (docs, odd):
        want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in df.select("doc_id", "text").collect()]
        rows = sharding.shard(df).collect()
        same([(r.doc_id, r.size, r.text_crc32) for r in rows], want)
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == [*range(sum(r.shard == s for r in rows))]
    rows = sharding.shard(docs, heads=64).collect()
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert set(loads) == set(range(16)) and max(loads.values()) - min(loads.values()) <= 0.05 * sum(loads.values()) / 16
    where = defaultdict(set)
    for text, shard in docs.select("doc_id", "text").join(sharding.shard(docs), "doc_id").select("text", "shard").collect():
        where[text].add(shard)
    assert all(len(x) == 1 for x in where.values())
    assert sharding.shard(odd.limit(0)).count() == 0
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def brute_base(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality(spark, sf_dir, docs, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.assess(docs, labels).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows], [(i, *brute_base(t)) for i, t in texts.items()])
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    # The scores again, from dictionaries of counts.
    token = re.compile(r"\w+|[^\w\s]+")

    def buckets(text):
        h = [zlib.crc32(t.encode()) for t in token.findall(text)]
        pairs = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64) >> 40 for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h + pairs]

    raw, target = Counter(), Counter()
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    counted = set(quality._sample(labels, True, quality.SAMPLE)[::2])
    assert counted < trusted and len(counted) == (len(trusted) + 1) // 2
    for i, t in texts.items():
        raw.update(buckets(t))
        if i in counted:
            target.update(buckets(t))
    k, n, m = quality.BUCKETS, sum(raw.values()), sum(target.values())
    share = {b: (c + 1) / (n + k) for b, c in raw.items()}
    for r in rows[:60]:
        own = buckets(texts[r.doc_id])
        want = sum(math.log((target[b] + k * share[b]) / (m + k)) - math.log(share[b]) for b in own) / len(own)
        assert abs(want - r.score) < 1e-9
    odds = quality.assess(odd, labels.limit(0)).collect()
    assert len(odds) == len(ODD) and not any(r.kept for r in odds)
    assert quality.keep_good(odd, labels).count() == 0
    assert quality.threshold(np.array([1.0, 2.0]), np.array([-1.0, 0.0])) == 0.5


def test_quality_verdicts_by_brute_force(spark, sf_dir, docs):
    """Every row's score, the threshold over the labelled rows that were held out, and every verdict, from texts and labels alone."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in quality.assess(docs, labels).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    token = re.compile(r"\w+|[^\w\s]+")
    trusted, poor = quality._sample(labels, True, quality.SAMPLE), quality._sample(labels, False, quality.SAMPLE)
    of = {}
    for i, t in texts.items():
        h = [zlib.crc32(x.encode()) for x in token.findall(t or "")]
        of[i] = [x % quality.BUCKETS for x in h + [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64) >> 40 for a, b in zip(h, h[1:])]]
    raw, target = Counter(b for x in of.values() for b in x), Counter(b for i in trusted[::2] for b in of.get(i, ()))
    k, n, m = quality.BUCKETS, sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] + k * (c + 1) / (n + k)) / (m + k)) - math.log((c + 1) / (n + k)) for b, c in raw.items()}
    scores = {i: sum(ratio[b] for b in x) / len(x) if x else 0.0 for i, x in of.items()}
    assert all(abs(scores[i] - rows[i].score) < 1e-9 for i in texts)
    words = {i: brute_base(t) for i, t in texts.items()}
    good, bad = ([scores[i] for i in ids if i in texts and words[i][0] >= quality.FEW_WORDS] for ids in (trusted[1::2], poor))
    values = sorted({*good, *bad})
    told = [round(sum(x >= v for x in good) / len(good) + sum(x < v for x in bad) / len(bad), 12) for v in values]
    at = told.index(max(told))
    cut = values[at] if not at else (values[at - 1] + values[at]) / 2
    for i, r in rows.items():
        failed = words[i][0] < 50 or 100 * words[i][4] > 50 * words[i][0]
        assert r.base_failed == failed and r.kept == (not failed and scores[i] >= cut)
    assert 0 < sum(r.kept for r in rows.values()) < len(rows)


def test_quality_verdicts_follow_the_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.assess(docs, labels).collect() if r.doc_id in known and not r.base_failed]
    good, bad = [r.kept for r in rows if known[r.doc_id] == 1], [r.kept for r in rows if known[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_mixing(docs, odd):
    texts = docs.select("doc_id", "source", "text").collect()
    tokens = Counter()
    for r in texts:
        tokens[r.source] += len(r.text.split())
    plan = mixing.plan(dict(tokens), repeat_limit=1.2)
    rows = mixing.mix(docs, repeat_limit=1.2).collect()
    times = Counter(r.doc_id for r in rows)
    assert set(times) == {r.doc_id for r in texts}
    for s, held, budget in zip(plan.sources, plan.tokens, plan.budgets, strict=True):
        own = sorted((r for r in rows if r.source == s), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at < budget
            at += r.tokens
        assert at >= budget >= held and budget <= 1.2 * held * (1 + 1e-9) + 1
    few = mixing.mix(docs, budget=1000).collect()
    assert len(few) < len(rows)
    skewed = {"a": 1000, "b": 100, "c": 10}
    assert mixing.plan(skewed, repeat_limit=None).exponent == 0
    flat = mixing.plan(skewed, target_entropy=0.8, repeat_limit=None)
    assert abs(mixing.entropy(flat.weights) - 0.8) < 1e-9
    limited = mixing.plan(skewed, repeat_limit=3.0)
    assert abs(mixing.most_repeats([1000, 100, 10], limited.weights) - 3.0) < 1e-6
    rows = mixing.mix(odd).collect()
    assert {(r.doc_id, r.source) for r in rows} == {(1, "a"), (2, "a"), (None, None), (3, None), (4, "b")} and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd).count() >= len(ODD) and mixing.mixed_documents(odd).columns == odd.columns


@pytest.mark.parametrize("text", ["Hello, it's 2x3!  ", "", "naïve ÉCOLE ß", "Σίσυφος ΣΑΣ", "a\x1cb\x85c", "<|endoftext|> x", "é é", "漢字 kana", "don't WE'LL 'S", "a" * 5000])
def test_tokens(text):
    whole = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    mine = WordTokenizer(WORDS)
    assert np.frombuffer(mine.encode(text), mine.dtype).tolist() == whole


def test_packing(docs, odd):
    reader = Tokenizer.from_file(WORDS)
    for df, options in ((docs, {}), (docs, {"queues": 3, "stretch": 2}), (docs, {"weights": {"src1": 5, "src2": 1}, "burst": 64}), (odd, {})):
        pieces = packing.pack(df, WORDS, **options).collect()
        rows = [(r.doc_id, [*reader.encode(r.text or "", add_special_tokens=False).ids, packing.END]) for r in df.collect()]
        by_sequence, by_doc = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert len(p.ids) == 4 * p.length > 0
            by_sequence[p.sequence_id].append((p.offset, p.length))
            by_doc[p.doc_id, p.doc_tokens].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        for n, parts in by_sequence.items():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == packing.WINDOW or n == max(by_sequence)
        assert sorted(by_sequence) == [*range(len(by_sequence))]
        want = Counter((i, len(ids)) for i, ids in rows)
        for (i, n), parts in by_doc.items():
            assert sum(len(x) for _, x in parts) == n * want[i, n]
            if want[i, n] == 1:
                assert [x for _, part in sorted(parts) for x in part] == next(ids for j, ids in rows if j == i and len(ids) == n)
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def test_every_window_has_the_mixture(docs):
    """Of each source, what a window is short of is carried, so the shares up to any window are off by a burst at most."""
    sources = dict(docs.select("doc_id", "source").collect())
    pieces = packing.pack(docs, WORDS, burst=128).collect()
    total = Counter()
    for p in pieces:
        total[sources[p.doc_id]] += p.length
    whole, upto = sum(total.values()), Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        upto[sources[p.doc_id]] += p.length
        if p.offset + p.length == packing.WINDOW:
            n = (p.sequence_id + 1) * packing.WINDOW
            assert all(abs(upto[s] - t * n / whole) <= 128 + 2 * packing.WINDOW * max(total.values()) / whole for s, t in total.items())


def test_sequences(docs):
    pieces = packing.pack(docs, WORDS)
    rows = packing.sequences(pieces).collect()
    assert sum(r.tokens for r in rows) == sum(p.length for p in pieces.collect())
    assert all(len(r.ids) == packing.padded_length(r.tokens) for r in rows)
    assert [packing.padded_length(n) for n in (1, 3, 64, 2047, 2048)] == [1, 2048, 64, 2048, 2048]


def brute_spans(text):
    kinds = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    found = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)


def test_secrets(spark, docs, odd, tmp_path):
    tricky = ["password=token: xyz123456", "API_KEY = 'abc-def'\npasswd:short", "ésecret:\"Zz09+/_.=-\" token==abcdef", "AKIA" + "B" * 15, "xAKIA" + "B" * 16, "deadbeef" * 3 + "g" + "0" * 23, "token=" + "a1" * 20 + " " + "f" * 24, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "Z" * 36]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    texts = dict(every.collect())
    got = {r.path: sorted(tuple(s) for s in r.spans if s.rank < 3) for r in secrets.scan(every).collect()}
    assert got == {i: brute_spans(t) for i, t in texts.items()}
    clean = {r.doc_id: r.text for r in secrets.redact(every).collect()}
    for i, t in texts.items():
        if not brute_spans(t) and i < 1000:
            assert clean[i] == t
        assert not brute_spans(clean[i])
    # A second scan meets a ledger that knows every blob but the new ones, and one rule more.
    ledger = str(tmp_path / "ledger")
    first = secrets.scan(more.where("doc_id < 1004"), ledger=ledger, rules=secrets.BASE).count()
    again = {r.path: r.spans for r in secrets.scan(more, ledger=ledger, rules=secrets.RULES).collect()}
    runs = spark.read.parquet(ledger).collect()
    assert first == 4 and sum(len(r.rules) for r in runs) == len(tricky) * len(secrets.RULES)
    assert {i: sorted(tuple(s) for s in v if s.rank < 3) for i, v in again.items()} == {i: brute_spans(t) for i, t in more.collect()}
    assert {s.kind for s in again[1007]} == {"pem"} and {s.kind for s in again[1008]} == {"forge"}
    secrets.scan(more, ledger=ledger)
    assert spark.read.parquet(ledger).count() == len(runs)
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(odd.limit(0)).count() == 0
    same([tuple(r) for r in secrets.redact(odd).collect()], [tuple(r) for r in odd.collect()])


def test_spans_text(spark, sf_dir):
    for r in queries.op10_secret_scans(spark, sf_dir).collect():
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


def test_private_keys_go_whole(spark):
    """The body and the END line are part of the secret; without END the rest of the base64 lines is."""
    head, end, b64 = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", [c * 64 for c in "MQz/+9"]
    body = "\n".join([*b64, "Ab3="])
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    texts = {
        f"see {head}\n{body}\n{end} and on": "see [SECRET] and on",
        f"a\n{head}\n{sealed}{body}\n{end}\nz": "a\n[SECRET]\nz",
        f"a {head}\n{body}\nThen prose goes on": "a [SECRET]\nThen prose goes on",
        f"a {head}\n{sealed}{body}": "a [SECRET]",
        f"a {head}\n{body}\n\n{head}\n{body}\n{end}\n-- b": "a [SECRET]\n\n[SECRET]\n-- b",
        f'{{"k": "{head}\\n{body.replace(chr(10), chr(92) + "n")}\\n{end}\\n", "x": 1}}': '{"k": "[SECRET]\\n", "x": 1}',
        f'{{"k": "{head}\\n{body.replace(chr(10), chr(92) + "n")}", "x": 1}}': '{"k": "[SECRET]", "x": 1}',
        f"a line {head} of headers - and prose": "a line [SECRET] of headers - and prose",
        f"{head}\n" + "\n".join(b64 * 2_000) + f"\n{end}!": "[SECRET]!",
        f"{head} words " * 200: "[SECRET] words " * 200,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in secrets.redact(docs).orderBy("doc_id").collect()] == list(texts.values())
