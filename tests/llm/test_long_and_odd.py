"""Very long texts through the operators, and odd rows and clashing columns through archives and the pipeline."""

import hashlib
import sys
import time
from collections import Counter
from pathlib import Path

import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from logloom.llm import chat, quality, queries, secrets, warc  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def formatted(rows):
    found = Counter()
    for conv, _turn, role, text in rows:
        found[conv] += len(f"{chat.TURN}{chat.escaped(role or '')}{chat.BODY}{chat.escaped(text or '')}{chat.END}")
    return dict(found)


def test_chat_query(spark, sf_dir):
    """All conversations and the odd one, with their formatted length."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    got = {r.conv_id: r for r in queries.op2_chat_formatting(spark, sf_dir).collect()}
    assert {i: r.formatted_chars for i, r in got.items()} == formatted(rows)
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and got[-7].loss_chars == len(odd)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()


def test_long_turns(spark):
    rows = [(1, 0, "user", "some words </s> " * 100_000), (1, 1, "assistant", "yes"), (2, 0, "user", "some words </s> " * 100_000)]
    got = {r.conv_id: r for r in chat.read_back(chat.prefix_forest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOKENIZER), TOKENIZER).collect()}
    assert {i: r.formatted_chars for i, r in got.items()} == formatted(rows)
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{rows[0][3]}\nassistant\nyes\n".encode()).hexdigest()


def test_long_texts(spark):
    """A text of many secrets in time that doesn't grow with their square; one of many words."""
    one = "token=abcdef123 and é words "
    docs = spark.createDataFrame([(1, one * 100_000), (2, "word other " * 900_000), (3, "-" * 10_000_000)], "doc_id long, text string")
    got = {r.path: r.spans for r in secrets.scan(docs).collect()}
    assert [(s.start, s.end) for s in got[1]] == [(i * len(one), i * len(one) + 15) for i in range(100_000)] and got[2] == got[3] == []
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[1] == "[SECRET] and é words " * 100_000 and clean[2] == "word other " * 900_000
    n, chars, symbols, dup, repeat = quality.base_counts("word other " * 900_000)
    assert (n, chars, symbols, dup, repeat) == (1_800_000, 8_100_000, 0, 0, 1_800_000)
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_words for r in quality.assess(docs, labels).collect()} == {1: 400_000, 2: 1_800_000, 3: 1}


def test_time_of_many_spans(spark):
    """Twice the secrets of one text take at most two and a half times as long."""
    def took(n):
        docs = spark.createDataFrame([(1, "token=abcdef123 and words " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert len(secrets.scan(docs).first().spans) == n
        return time.perf_counter() - began

    took(1000)
    assert min(took(80_000) for _ in range(2)) <= 2.5 * min(took(40_000) for _ in range(2))


def test_archives_with_long_pages_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "x" * 10_000_000, "a", 1), (2, "u", "x" * 10_000_000, "b", 2), (3, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, first long")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    found = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolved(warc.read_archives(index)).collect())
    assert found == [(1, 10_000_000, "response", None), (2, 10_000_000, "revisit", 1), (3, 0, "response", None)]


def test_private_keys_as_in_sql(spark, tmp_path):
    """Planted keys: whole ones, one in a quoted string, an encrypted one, one without an END line, a header alone, and hyphens within."""
    import duckdb

    begin, end, body = "-----BEGIN RSA PRIVATE " + "KEY-----", "-----END RSA PRIVATE " + "KEY-----", "\n".join(["MIIEpAIBAAKCAQEA" * 4] * 3)
    keys = [
        f"{begin}\n{body}\nabc=\n{end}", f'"{begin}\\n{body}\\n{end}"', f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0\n\n{body}\n{end}", f"{begin}\n{body}\n\nSome words after.",
        f"{begin} is only a header", f"{begin}\nx--y----z\n{end} and {end}", f"{begin}\n{body}\n------\n{end}", f"{begin}\n{body}\n{end}\n{begin}\n{body}\n{end}",
    ]
    rows = [(i, f"token=abcdef123 é before\n{k}\nsecret: 'hunter22' after") for i, k in enumerate(keys)] + [(90, None), (91, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in queries.op10_secret_scans(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT doc_id, spans FROM ({secrets.oracle_sql()})").fetchall())
    assert got == want
    assert [got[i].count("pem:") for i in range(8)] == [1, 1, 1, 1, 1, 1, 1, 2] and all("assign:0:15" in got[i] for i in range(8))


def test_compacted_ledger(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdef123"), (2, "gh" + "p_" + "a1" * 20), (3, "")], "doc_id long, text string")
    ledger, small = str(tmp_path / "ledger"), str(tmp_path / "small")
    secrets.scan(docs, ledger=ledger, rules=secrets.BASE)
    want = sorted(secrets.scan(docs, ledger=ledger).collect())
    assert spark.read.parquet(ledger).count() == 6
    secrets.compact(spark, ledger, small)
    assert sorted(secrets.scan(docs, ledger=small).collect()) == want and spark.read.parquet(small).count() == 3


def test_pipeline_with_odd_rows(spark, sf_dir):
    """Null ids, texts and sources, repeats and a long text go through every stage; every row that is kept is packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = [r.text for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).limit(3).collect()]
    long = "\n".join(r.text for r in docs.where("lang = 'en'").limit(120).collect())
    odd = [(None, good[0], "en", None, 1), (None, good[0], "en", None, 1), (5, good[1], None, "a", None), (5, good[1], None, "a", None), (6, None, None, None, None), (7, "", "en", "b", 0), (8, good[2] + " password=hunter2hunter2", "en", "b", 9), (9, long, "en", "c", 2)]
    rows, names = spark.createDataFrame(odd, docs.schema), docs.columns
    kept = []
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == names
        kept.append(rows.collect())
    first, second, third, _ = ([r.doc_id for r in x] for x in kept)
    assert first.count(None) == 2 and first.count(5) == 2 and 6 not in first and 7 not in first
    assert second.count(None) == 1 and second.count(5) == 1 and sorted(second, key=str) == sorted(third, key=str)
    assert all("hunter2hunter2" not in r.text for r in kept[2])
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in kept[3]}
    empty = spark.createDataFrame([], docs.schema)
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
