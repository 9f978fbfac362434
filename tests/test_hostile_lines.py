"""No line and no rule ends a job: every line comes out once, stored or quarantined, under ANSI rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.text import to_map
from logloom.operators import sigma
from logloom.operators.parsers.dynamic import DynamicParser, FieldMapping, dynamic
from logloom.plans.normalize import normalize

EVE = '{"event_type":"alert","src_ip":"1.1.1.1","dest_ip":"2.2.2.2","src_port":%s,"dest_port":%s,"alert":{"severity":%s}}'


def frame(spark, lines):
    return spark.createDataFrame([(x, "T", i) for i, x in enumerate(lines)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit("2026-01-05 10:00:00").cast("timestamp"))


def test_eve_numbers(spark):
    """What is no 32-bit number is the default: no port, severity 3."""
    odd = ["99999999999", '"NaN"', "1e400", '"-Infinity"', "-1", "0.5", '""', "null", "{}", "[1]", "true", '"80"', "80.9", "2147483647", "2147483648"]
    got = {r.ingest_seq: r for r in normalize(frame(spark, [EVE % (x, x, x) for x in odd])).collect()}
    assert len(got) == len(odd) and all(r.outcome.code == "NORMAL" for r in got.values())
    ports = {odd[i]: r.source.port for i, r in got.items()}
    assert ports == dict.fromkeys(odd) | {'"80"': 80, "80.9": 80, "2147483647": 2147483647}
    assert {r.event.severity_id for i, r in got.items() if ports[odd[i]] is None and odd[i] not in ("1", "2")} == {3}


SEEDS = [
    "<134>Jan 05 10:32:21 cisco-asa %ASA-4-106023: deny tcp src inside:192.168.1.5/49152 dst outside:10.0.0.9/22 by access-group \"acl-1\"",
    "<13>Jan 05 10:32:21 fw01 kernel: DROP IN=eth0 OUT=eth1 SRC=192.168.1.5 DST=10.0.0.9 PROTO=TCP SPT=49152 DPT=22",
    "<34>1 2026-01-05T10:32:21Z host app 123 ID47 [x y=\"z\"] src=1.2.3.4 dst=4.3.2.1 spt=80 action=deny",
    "CEF:0|Acme|IDS|6.0|2000001|port scan|7|src=192.168.1.5 dst=10.0.0.9 spt=49152 dpt=22 rt=1767609141000 act=deny",
    "LEEF:1.0|Acme|SIEM|7.4|Login|src=192.168.1.5\tdst=10.0.0.9\tsrcPort=49152\tdstPort=22\tproto=tcp\tusrName=u1",
    EVE % ("80", "22", "1"),
    '{"eventSource":"s3","eventName":"Get","awsRegion":"eu","userIdentity":{"userName":"u"},"eventTime":"2026-01-05T10:32:21Z","errorCode":"x"}',
    '[{"src":"1.1.1.1","dst":"2.2.2.2","spt":"80","time":"2026-01-05T10:32:21Z","action":"deny"}]',
    "1,t,s,TRAFFIC,x,1,t,192.168.1.5,10.0.0.9,0.0.0.0,0.0.0.0,rule-1,u1,,web,v,a,b,c,d,e,t,9,1,49152,22,0,0,0x0,tcp,deny,1",
    'device="FG" src=192.168.1.5 dst=10.0.0.9 spt=49152 dpt=22 proto=tcp action=deny user=u1',
    "GARBAGE-3 session started token",
]
BITS = ["99999999999999999999", "NaN", "-", "\x00", "\x01\x02", " ", "\n", "\\", "\\u00", '"', "'", "{", "}", "[", "]", "|", "=", ",", ",,,,,,,,,,", "\t", " " * 300, "é́", "\U0001f600", "src=", "src=1 src=2 src=", "CEF:", "LEEF:2.0|", "%ASA-1-1:", "SRC=1.1.1.1 ", "1" * 400, "null", "a" * 3000]


def test_mutated_lines_are_conserved(spark):
    rng = random.Random(11)
    lines = [*SEEDS, "", " ", "\x00", None, '{"src_ip":1,"dest_ip":2,"src_ip":3}', "{" * 2000 + "}" * 2000, json.dumps({"a": {"b": [1, None, {"c": "x"}]}})]
    for _ in range(1500):
        line = rng.choice(SEEDS)
        for _ in range(rng.randint(1, 4)):
            at, cut = rng.randrange(len(line) + 1), rng.choice([0, 0, 1, 3, 12])
            line = line[:at] + rng.choice(BITS) + line[at + cut :]
        lines.append(line)
    spec = DynamicParser("custom", r"^GARBAGE-(?<token0>\d+)\s+(?<token1>\S+).*$", (FieldMapping("token0", "source.port"), FieldMapping("token1", "source.ip")))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    rows = normalize(frame(spark, lines), dynamic=[dynamic(spec)]).collect()
    assert sorted(r.ingest_seq for r in rows) == [*range(len(lines))]
    assert all(r.raw_message == lines[r.ingest_seq] for r in rows)
    assert len({r.event_id for r in rows}) == len(lines)


def test_very_long_lines(spark):
    """Values, pairs and runs of spaces of a megabyte take neither the stack nor quadratic time."""
    n = 1 << 20
    lines = [
        "CEF:0|a|b|c|d|e|5|src=1.1.1.1 msg=" + "x\\=" * (n // 3), "CEF:0|a|b|c|d|e|5|" + " ".join(f"k{i % 50_000}={i}" for i in range(n // 10)), "device=x src=1.1.1.1 " + " ".join(f"k{i}=v" for i in range(n // 10)),
        "<13>1 " + " " * n + "x", " " * n + "src=1.1.1.1 x=y" + " " * n, "kernel: " + "SRC=1.1.1.1 " * (n // 12), "kernel: " + "SRC=1.1.1.1 DST=2.2.2.2 " * 400, "LEEF:1.0|a|b|c|d|" + "\t".join(f"k{i}=v" for i in range(n // 10)),
        "," * n, "[" * n, '{"a":"' + "y" * n + '"}', "z" * n,
    ]
    rows = normalize(frame(spark, lines)).select("ingest_seq", "raw_message", F.size("extensions").alias("n"), "outcome.code").collect()
    got = {r.ingest_seq: r for r in rows}
    assert len(got) == len(lines) and got[1].n == 50_002 and got[2].n == n // 10 + 2 and got[7].n == n // 10 + 2


def test_last_of_equal_keys(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "b"], ["1", "2", "3", "4", "5"]), (["a", "b"], ["1", "2"]), ([], [])], "k array<string>, v array<string>")
    assert [r[0] for r in df.select(to_map(F.col("k"), F.col("v"))).collect()] == [{"a": "3", "b": "5", "c": "4"}, {"a": "1", "b": "2"}, {}]


def test_bad_patterns_match_nothing(spark):
    rule = sigma.parse_rule({"id": "R", "title": "t", "detection": {"selection": {"raw.message|re": ["(", "port [0-9"]}, "other": {"raw.message|re": ["(", "SESS.*"]}, "condition": "1 of them"}})
    only = sigma.parse_rule({"id": "S", "title": "t", "detection": {"selection": {"raw.message|re": "*"}}})
    assert sigma.bad_patterns([rule, only]) == [("R", "("), ("R", "port [0-9"), ("R", "("), ("S", "*")]
    with pytest.warns(UserWarning, match="no pattern"):
        rows = normalize(frame(spark, ["src=1.1.1.1 session x=y", "src=1.1.1.1 x=y"]), rules=[rule, only]).orderBy("ingest_seq").collect()
    assert [[m.rule_id for m in r.threat.sigma_matches] for r in rows] == [["R"], []]
