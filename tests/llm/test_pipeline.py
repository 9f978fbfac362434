"""The pipeline's stages, each held against what its operator says of the stage before."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from logloom.llm import mixing, quality, secrets, simhash  # noqa: E402
from logloom.llm._spark import table, written  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        out[name] = docs
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scans", "source_mixing", "window_packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, sf_dir, stages):
    verdicts = quality.assess(stages["documents"], table(spark, sf_dir, "labels")).where("kept").collect()
    assert ids(stages["quality_rules"]) == Counter(r.doc_id for r in verdicts) and len(verdicts) > 100


def test_near_duplicates(stages):
    texts = dict(stages["quality_rules"].select("doc_id", "text").collect())
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(prints):
        for j in prints:
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert ids(stages["near_duplicates"]) == Counter(i for i in prints if find(i) == i)


def test_secrets(stages):
    before = dict(stages["near_duplicates"].select("doc_id", "text").collect())
    after = {r.doc_id: r for r in stages["secret_scans"].collect()}
    spans = {r.path: r.spans for r in secrets.scan(stages["near_duplicates"]).collect()}
    assert set(after) == set(before)
    for i, r in after.items():
        want, at = "", 0
        for s in spans[i]:
            if s.start >= at:
                want += before[i][at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.text == want + before[i][at:] and r.n_chars == len(r.text)


def test_mixing(stages):
    found = mixing.mix(stages["secret_scans"], repeat_limit=1.5)
    assert ids(stages["source_mixing"]) == ids(found)
    assert set(ids(stages["secret_scans"])) == set(ids(found))


def test_packing_and_run(spark, sf_dir, stages):
    pieces = stages["window_packing"].collect()
    times = ids(stages["source_mixing"])
    held = Counter()
    for p in pieces:
        held[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert set(held) == set(times) and all(held[i] == tokens[i] * times[i] for i in held)
    again = Counter()
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        again[p.doc_id] += p.length
    assert again == held


def test_rows_without_or_with_shared_ids(spark, sf_dir):
    """Every row is judged by its own text, and of exact and near copies one row stays, null and repeated ids included."""
    docs = table(spark, sf_dir, "documents")
    # A third of the rows lose their id, another third share one.
    odd = docs.selectExpr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then -1 else doc_id end as doc_id", "text", "lang", "source", "doc_id as n_chars")
    odd = written(odd, "odd")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = sorted(r.doc_id for r in quality.assess(docs, labels).where("kept").collect())
    assert sorted(r.n_chars for r in quality.keep_good(odd, labels).collect()) == want and 0 < len(want) < docs.count()
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (7, "e f g h", 3), (7, "e f g h", 3), (7, "i j k l", 4), (None, "e f g h", 5), (8, None, 6), (None, "", 7)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), sf_dir).collect()
    assert sorted((r.doc_id or -1, r.n) for r in got if r.n > 2) == [(7, 3), (7, 4), (8, 6)] and [r.text for r in got if r.n <= 2] == ["a b c d"]
