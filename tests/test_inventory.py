"""What no registered query shows: requests, frames, exports, settings, proofs by hash, empty batches, rule and parser registries."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.operators import drift, export, infer, lineage, search, sigma
from logloom.operators.parsers.json import root
from logloom.plans.config import Config, config_from_rules
from logloom.plans.normalize import events, normalize
from logloom.sources import lines, tables

AT = "2026-01-05 10:00:00"


def frame(spark, some):
    return spark.createDataFrame([(x, "T", i) for i, x in enumerate(some)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit(AT).cast("timestamp"))


def test_requests_and_files(spark, tmp_path):
    bodies = ['{"log":"a b","source":"S"}', '{"message":"m"}', '{"src":"1.1.1.1","n":5,"x":null}', "plain line", "", None, '{"log":"a b","source":"S"}']
    got = lines.from_requests(spark.createDataFrame([(b,) for b in bodies], "body string"), source="REST_SINGLE", received=F.lit(AT).cast("timestamp"))
    rows = sorted((r.raw_message, r.source) for r in got.collect())
    assert rows == sorted([("a b", "S"), ("m", "REST_SINGLE"), ("{src=1.1.1.1, n=5, x=null}", "REST_SINGLE"), ("plain line", "REST_SINGLE"), ("a b", "S")])
    assert got.select("ingest_seq").distinct().count() == 5
    bulk = spark.createDataFrame([('["a", "", "b"]',), ('{"logs":["c","c"]}',), (None,)], "body string")
    assert sorted(r.raw_message for r in lines.from_bulk(bulk, received=F.lit(AT).cast("timestamp")).collect()) == ["a", "b", "c", "c"]
    (tmp_path / "a.log").write_text("one\n\ntwo\n")
    assert sorted(r.raw_message for r in lines.read_lines(spark, str(tmp_path / "a.log"), received=F.lit(AT).cast("timestamp")).collect()) == ["one", "two"]
    (tmp_path / "a.json").write_text('[\n {"k": 1},\n {"k": 2}\n]')
    assert sorted(json.loads(r.raw_message)["k"] for r in lines.read_json_array(spark, str(tmp_path / "a.json"), received=F.lit(AT).cast("timestamp")).collect()) == [1, 2]
    long = spark.createDataFrame([("x" * 65_536,), ("é" * 32_769,), ("",)], "value string")
    assert sorted(len(r.value) for r in lines.framed(long).collect()) == [0, 65_536]


def test_json_values_keep_their_text(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,null]},"n":null,"t":true,"s":"x","f":1.50}',), ('[{"k":"v"},{"k":"w"}]',), ("[]",), ("[1]",), ("nope",)], "line string")
    got = [r[0] for r in df.select(root(F.col("line"))).collect()]
    assert json.loads(got[0]["a"]) == {"b": [1, None]} and got[0]["n"] is None and got[0]["t"] == "true" and got[0]["s"] == "x"
    assert got[1:] == [{"k": "v"}, {}, {}, None]


def test_exports(spark, tmp_path):
    kept = events(normalize(frame(spark, ["src=1.1.1.1 dst=2.2.2.2 action=deny", "src=3.3.3.3 action=allow", "hello"])))
    ids = sorted(r.event_id for r in kept.collect())
    assert export.exported(kept, "CEF", [ids[0], "none"]).count() == 1 and export.exported(kept, "leef", []).count() == 0
    some = spark.createDataFrame([(i,) for i in [*ids, ids[0], "none"]], "event_id string")
    assert sorted(r.event_id for r in export.exported(kept, "ecs", some).collect()) == ids
    export.write_files(kept, str(tmp_path / "wire"), "cef", "Own", "Box")
    wires = [r.value for r in spark.read.text(str(tmp_path / "wire")).collect()]
    assert len(wires) == 2 and all(w.startswith("CEF:0|") for w in wires)
    assert set(export.taxonomy(kept.schema)) == {"schema_version", "categories", "fields", "ecs_aliases"}


def test_settings_act(spark):
    df = frame(spark, ["src=10.0.0.1 dst=2.2.2.2 dpt=22 action=deny"])
    row = lambda **given: normalize(df, Config(**given)).first()
    assert row().threat.technique_id == "T1110" and row(technique_mapping=False).threat.technique_id is None
    assert row().source.is_internal is True and row(ip_classification=False).source.is_internal is None
    assert row().network.transport == "SSH" and row(port_services=False).network.transport is None
    assert len(row().threat.sigma_matches) == 1 and row(sigma=False).threat.sigma_matches == []
    mean = row().average_confidence
    assert (row().confidence_tier, row(high_confidence=mean + 0.01).confidence_tier, row(high_confidence=2.0, medium_confidence=mean + 0.01).confidence_tier) == ("HIGH", "MEDIUM", "LOW")
    assert row(medium_confidence=mean + 0.01).low_confidence is True
    given = [{"key": "CONFIDENCE_HIGH_THRESHOLD", "value": "0.8"}, {"key": "rules.sigma.enabled", "value": "FALSE"}, {"key": "ENRICHMENT_MITRE_ENABLED", "value": "false", "enabled": False}, {"key": "other", "value": "1"}]
    assert config_from_rules(given) == Config(high_confidence=0.8, sigma=False)


def test_merkle_by_hash_and_empty_batches(spark, tmp_path):
    rows = [(1, i, f"r{i}", f"{i % 3:064x}") for i in range(7)] + [(2, 0, "z", "ab" * 32)]
    leaves = spark.createDataFrame(rows, "batch_number long, leaf_index long, raw_event_id string, hash string")
    roots = lineage.roots(leaves)
    wanted = spark.createDataFrame([(1, f"{1:064X}"), (1, f"{1:064x}"), (2, "AB" * 32), (1, "ff"), (3, "ff"), (1, None)], "batch_number long, hash string")
    got = {(r.batch_number, r.hash): r for r in lineage.proofs_by_hash(leaves, wanted).collect()}
    assert got[1, f"{1:064x}"].leaf_index == 1 and len(got[1, f"{1:064x}"].proof) == 3 and got[2, "ab" * 32].proof == []
    assert got[1, "ff"].leaf_index is None and got[1, "ff"].proof == [] == got[3, "ff"].proof
    checked = lineage.verify(lineage.proofs_by_hash(leaves, wanted).where("leaf_index is not null"), roots).collect()
    assert len(checked) == 2 and all(r.verified for r in checked)
    every = spark.createDataFrame([(1,), (2,), (9,)], "batch_number long")
    full = {r.batch_number: r for r in lineage.with_empty(roots, every).collect()}
    assert full[9].event_count == 0 and full[9].merkle_root == lineage.EMPTY_ROOT and full[1].event_count == 7
    assert lineage.totals(roots).first() == (2, 8) and lineage.totals(roots.limit(0)).first() == (0, 0)
    tables.append_ledger(roots, str(tmp_path / "ledger"))
    tables.append_ledger(roots, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 4


def test_tampering_shows(spark):
    """A changed line, a changed leaf and a changed root are each told."""
    rows = normalize(frame(spark, [f"src=1.1.1.{i} x=y" for i in range(20)]))
    rows = tables.materialised(rows, "tampered")
    raw = rows.select("raw_event_id", F.when(F.col("ingest_seq") == 7, "src=9.9.9.9 x=y").otherwise(F.col("raw_message")).alias("raw_message"), "raw_hash")
    told = lineage.integrity(events(rows), raw.where("raw_message <> 'src=1.1.1.3 x=y'")).join(rows.select("event_id", "ingest_seq"), "event_id")
    assert {r.ingest_seq: r.status_message.split(":")[0].split(" (")[0] for r in told.where("not verified").collect()} == {3: "Raw event not found", 7: "Integrity FAILED"}
    leaves = tables.materialised(lineage.seal(rows.select("received_at", "ingest_seq", "raw_event_id", "raw_hash")), "leaves")
    roots = tables.materialised(lineage.roots(leaves), "roots")
    bent = leaves.withColumn("hash", F.when(F.col("leaf_index") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")))
    wrong = lineage.verify(lineage.proofs(bent, bent.select("batch_number", "leaf_index")), roots)
    assert wrong.where("verified").count() == 0 and {r.status_message for r in wrong.collect()} == {"Inclusion proof FAILED"}
    right = lineage.proofs(leaves, leaves.select("batch_number", "leaf_index"))
    assert lineage.verify(right.withColumn("hash", F.when(F.col("leaf_index") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash"))), roots).where("not verified").select("leaf_index").collect() == [(4,)]
    assert '"verified_root_matches_tree":false' in lineage.audit_bundle(roots, bent).first().bundle
    records = lineage.leaf_records(leaves, rows.where("ingest_seq <> 2")).collect()
    assert len(records) == 20 and [r.leaf_index for r in records if r.event_id is None] == [2]


def test_registries(spark, tmp_path):
    store = sigma.RuleStore()
    n = len(store.rules())
    store.upsert(sigma.parse_rule({"id": "MINE", "title": "t", "detection": {"selection": {"event.action|endswith": "ED", "source.ip|startswith": ["10.", "192."]}}}))
    store.toggle("SIGMA-T1046-SCAN-001", False)
    store.delete("SIGMA-T1552-FTP-002")
    store.delete("none")
    assert len(store.rules()) == n
    rows = normalize(frame(spark, ["src=10.1.1.1 dpt=21 action=deny msg=portscan", "src=8.8.8.8 action=deny"]), rules=store.rules()).orderBy("ingest_seq").collect()
    assert [[m.rule_id for m in r.threat.sigma_matches] for r in rows] == [["MINE"], []]
    mined = infer.infer(infer.mine(frame(spark, ["job 12 done ok", "job 13 done ok", "user in from host bob", "user in from host ann"])))
    registry = infer.Registry()
    assert infer.approve_all(mined, registry) == 2
    with pytest.raises(ValueError, match="more than 1 templates"):
        infer.approve_all(mined, infer.Registry(), 1)
    registry.save(spark, str(tmp_path / "parsers"))
    again = infer.Registry.load(spark, str(tmp_path / "parsers"))
    assert [p.name for p in again.parsers()] == [p.name for p in registry.parsers()]
    got = normalize(frame(spark, ["job 99 done ok", "user in from host eve", "other"]), dynamic=again.parsers()).groupBy("format").count().collect()
    assert {r.format: r["count"] for r in got} == {"CUSTOM": 2, None: 1}


def test_searches_and_baselines(spark):
    df = spark.createDataFrame([(1, "OPEN", datetime(2026, 1, 1)), (2, "CLOSED", datetime(2026, 1, 2)), (3, None, datetime(2026, 1, 3))], "id long, status string, at timestamp")
    assert [r.id for r in search.by_id(df, "id", 2).collect()] == [2] and search.by_status(df).count() == 3 and [r.id for r in search.by_status(df, "OPEN").collect()] == [1]
    assert [r.id for r in search.between(df, "at", datetime(2026, 1, 2), datetime(2026, 1, 3)).orderBy("id").collect()] == [2, 3]
    parsers = spark.createDataFrame([("a", "1", "X", True, 0.8), ("b", "1", "X", True, 0.0), ("c", "1", "Y", False, 0.0), ("d", "1", "Y", False, 0.0)], "parser_name string, parser_version string, format string, dynamic boolean, score double")
    versions = spark.createDataFrame([("d", True, 0.7), ("d", False, 0.99), ("c", True, None)], "parser_name string, active boolean, average_confidence double")
    assert {r.parser_name: r.baseline for r in drift.baselines(parsers, versions).collect()} == {"a": 0.8, "b": 0.9, "c": 0.95, "d": 0.7}
    rows = events(normalize(frame(spark, [f"src=1.1.1.{i} dst=2.2.2.2 action=deny" for i in range(30)])))
    known = spark.createDataFrame([("csv_kv_parser", "1.0.0", "CSV/KV", 0.95)], "parser_name string, parser_version string, format string, baseline double")
    assert len(drift.quality(rows, rows.limit(0).selectExpr("received_at as created_at", "format as detected_format"), known, datetime(2026, 1, 6)).first().history) == drift.HISTORY


def brute_mine(rows, masked):
    """Clusters within leaves, line by line, from lists of tokens."""
    leaves, shapes, of_line = {}, {}, {}
    same_key = lambda t, x: "=" in t and infer._PAIR.match(x) and t.split("=")[0] == x.split("=")[0]
    for i, toks in rows:
        fresh = masked[i]
        shape = tuple(fresh)
        if shape not in shapes:
            leaf = leaves.setdefault((len(toks), *fresh[:4]), [])
            scores = [sum(t == "<*>" or t == x or bool(same_key(t, x)) for t, x in zip(c, toks)) for c in leaf]
            if scores and max(scores) >= 0.5 * len(toks):
                c = leaf[scores.index(max(scores))]
                for j, (t, x) in enumerate(zip(list(c), toks)):
                    if t != x and t != "<*>":
                        c[j] = t.split("=")[0] + "=<*>" if same_key(t, x) and infer._PAIR.match(t) else "<*>"
            else:
                c = [*fresh]
                leaf.append(c)
            shapes[shape] = c
        of_line[i] = shapes[shape]
    return {i: " ".join(c) for i, c in of_line.items()}


def test_mining_by_brute_force(spark):
    rng = random.Random(4)
    words = ["start", "stop", "a=1", "a=x", "b=2", "10", "10.0.0.1", "DENY", "k=<*>", "<*>", "=x", "go"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(1500)]
    df = frame(spark, [" ".join(t) for _, t in rows])
    masked = {r.ingest_seq: r.m for r in df.select("ingest_seq", infer.first_template(infer.tokens(F.col("raw_message"))).alias("m")).collect()}
    mined = infer.mine(df).collect()
    assert {r.id: r.template for r in mined} == brute_mine(rows, masked)
    per = {}
    for r in mined:
        per.setdefault(r.cluster, set()).add(r.template)
    assert all(len(x) == 1 for x in per.values())


def test_many_shapes(spark):
    """Twenty thousand shapes with a common head, none like another: one leaf, a table of templates."""
    lines_ = spark.range(20_000).select(F.col("id").alias("ingest_seq"), F.concat_ws(" ", F.lit("app host svc run"), *[F.concat(F.lit("w"), F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256), F.lit("w")) for k in range(6)]).alias("raw_message"))
    assert infer.mine(lines_).select("cluster").distinct().count() == 20_000
