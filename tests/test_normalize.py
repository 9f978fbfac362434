"""One literal line of each family through the whole plan."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import sigma
from logloom.operators.export import to_cef, to_leef
from logloom.operators.parsers.dynamic import DynamicParser, FieldMapping, dynamic, group_numbers
from logloom.plans.config import Config, config_from_rules
from logloom.plans.normalize import events, normalize, quarantine

LINES = {
    "asa": '<134>Aug 30 10:32:21 cisco-asa %ASA-4-106023: Deny tcp src inside:192.168.1.5/52100 dst outside:10.10.10.20/443 by access-group "dmz"',
    "asa_plain": "%ASA-6-302013: Built inbound TCP connection",
    "iptables": "<13>Aug 30 10:32:21 fw01 kernel: DROP IN=eth0 OUT=eth1 SRC=192.168.1.50 DST=10.0.0.10 PROTO=TCP SPT=55432 DPT=22",
    "rfc5424": '<34>1 2026-08-30T10:32:21Z mx1 su 77 ID47 [x@1 a="b"] action=deny src_ip=8.8.4.4 spt=70000 user=eve',
    "rfc_filter": "<34>1 2026-08-30T10:32:21Z mx1 su 77 ID47 - src=1.2.3.4 dst=5.6.7.8 proto=udp",
    "cef": "CEF:0|Acme|IDS|6.0|2001|ET SCAN probe|high|src=192.168.1.150 dst=10.10.10.20 spt=49152 dpt=22 proto=tcp act=blocked msg=a\\=b rt=1693391541000",
    "cef_syslog": "<134>CEF:0|a|b|c|d|e|5|src=1.2.3.4",
    "cef_short": "CEF:0|Acme|IDS",
    "leef": "LEEF:1.0|IBM|QRadar|7.4|LoginFailure|src=10.1.1.1\tdst=10.2.2.2\tsrcPort=99\tusrName=bob",
    "leef_caret": "LEEF:2.0|IBM|QRadar|7.4|Login|src=10.1.1.1^dst=10.2.2.2^dstPort=23",
    "pan": "1,t,s,TRAFFIC,x,1,t,192.168.1.105,10.10.10.35,0.0.0.0,0.0.0.0,rule,jdoe,,web,v,a,b,c,d,e,t,9,1,54321,80,0,0,0x0,tcp,deny,1",
    "kv": 'device="FortiGate" src=10.0.0.1 dst=10.0.0.2 spt=1 dpt=2 proto=udp Action=permit user=amy',
    "cloudtrail": '{"eventTime":"2026-08-30T10:00:00Z","eventSource":"iam.amazonaws.com","eventName":"CreateUser","awsRegion":"us-east-1","sourceIPAddress":"203.0.113.88","userIdentity":{"userName":"root"},"errorCode":"Denied"}',
    "eve": '{"event_type":"alert","src_ip":"1.1.1.1","src_port":0,"dest_ip":"2.2.2.2","dest_port":53,"proto":"udp","alert":{"action":"drop","severity":2,"signature":"dns"}}',
    "json": '{"client_ip":"9.9.9.9","dst_port":"70000","decision":"Deny","user":null,"time":"2026-01-01T00:00:00Z"}',
    "json_array": '[{"src":"4.4.4.4"},{"src":"5.5.5.5"}]',
    "json_bad": "{broken}",
    "bad_ip": "src=not-an-ip dst=10.0.0.1",
    "free": "hello world",
    "blank": "  \t ",
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(v, "T", i) for i, v in enumerate(LINES.values())] + [(None, "T", 99)]
    raw = spark.createDataFrame(data, "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit("2026-09-01 00:00:00").cast("timestamp"))
    names = [*LINES, "null"]
    found = normalize(raw).withColumn("cef", to_cef()).withColumn("leef", to_leef()).collect()
    return {names[r.ingest_seq] if r.ingest_seq != 99 else "null": r for r in found}


def test_classes(rows):
    want = {"asa": ("SYSLOG_RFC3164", 0.95), "rfc5424": ("SYSLOG_RFC5424", 0.98), "cef": ("CEF", 0.99), "cef_syslog": ("CEF", 0.99), "leef": ("LEEF", 0.99), "leef_caret": ("LEEF", 0.99), "pan": ("CSV", 0.85), "kv": ("UNKNOWN", 0.30), "json_bad": ("JSON", 0.98), "free": ("UNKNOWN", 0.30), "blank": ("UNKNOWN", 0.0), "null": ("UNKNOWN", 0.0)}
    assert {k: (rows[k]["class"].format, rows[k]["class"].confidence) for k in want} == want


def test_outcomes(rows):
    want = dict.fromkeys(LINES, "NORMAL") | {"cef_short": "PARSER_FAILURE", "json_bad": "PARSER_FAILURE", "bad_ip": "VALIDATION_FAILED", "free": "UNPARSEABLE_FORMAT", "blank": "UNPARSEABLE_FORMAT", "null": "UNPARSEABLE_FORMAT"}
    # A header that is cut off isn't CEF to the classifier, but its parser takes it.
    assert {k: r.outcome.code for k, r in rows.items()} == want
    assert rows["bad_ip"].outcome.reason == "Invalid source IP format: not-an-ip"
    assert rows["json_bad"].outcome.detected_format == "JSON" and rows["free"].outcome.detected_format == "UNKNOWN"


def test_fields(rows):
    def seen(k):
        r = rows[k]
        return r.event.action, r.event.severity_id, r.source.ip, r.source.port, r.destination.ip, r.destination.port, r.network.protocol, r.average_confidence

    assert seen("asa") == ("blocked", 4, "192.168.1.5", 52100, "10.10.10.20", 443, "TCP", 0.983)
    assert seen("asa_plain") == ("informational", 1, None, None, None, None, "IP", 0.85)
    assert seen("iptables") == ("blocked", 3, "192.168.1.50", 55432, "10.0.0.10", 22, "TCP", 0.973)
    assert seen("rfc5424") == ("blocked", 1, "8.8.4.4", None, None, None, "TCP", 0.933)
    assert seen("rfc_filter")[:3] == ("blocked", 3, "1.2.3.4") and rows["rfc_filter"].observer.hostname == "1"
    assert seen("cef") == ("blocked", 4, "192.168.1.150", 49152, "10.10.10.20", 22, "TCP", 0.986)
    assert rows["cef"].extensions["msg"] == "a=b" and rows["cef"].timestamp_text == "2023-08-30T10:32:21Z"
    assert rows["cef_syslog"].parser_name == "syslog_rfc_parser"
    assert seen("leef") == ("allowed", 3, "10.1.1.1", 99, "10.2.2.2", None, "TCP", 0.99)
    assert seen("leef_caret")[4:6] == ("10.2.2.2", 23)
    assert seen("pan") == ("blocked", 4, "192.168.1.105", 54321, "10.10.10.35", 80, "TCP", 0.977)
    assert seen("kv") == ("allowed", 1, "10.0.0.1", 1, "10.0.0.2", 2, "UDP", 0.94) and rows["kv"].observer.vendor == "FortiGate"
    assert seen("cloudtrail") == ("blocked", 3, "203.0.113.88", None, None, None, None, 0.968) and rows["cloudtrail"].source.user == "root"
    assert seen("eve") == ("blocked", 4, "1.1.1.1", None, "2.2.2.2", 53, "UDP", 0.984)
    assert seen("json") == ("blocked", 3, "9.9.9.9", None, None, 70000, "TCP", 0.883) and rows["json"].extensions["user"] == "null"
    assert seen("json_array")[2] == "4.4.4.4"
    assert rows["asa"].source.zone == "inside" and rows["asa"].extensions["ciscoRuleId"] == "dmz" and rows["asa"].timestamp_text == "2026-08-30T10:32:21Z"
    assert rows["asa"].source.is_internal and not rows["cloudtrail"].source.is_internal and rows["iptables"].network.transport == "SSH"


def test_detections(rows):
    found = {k: [m.rule_id for m in r.threat.sigma_matches or ()] for k, r in rows.items()}
    assert found["cef"] == ["SIGMA-T1046-SCAN-001", "SIGMA-T1110-SSH-001"] and found["asa"] == ["SIGMA-T1046-CISCO-002"]
    assert found["leef_caret"] == ["SIGMA-T1552-TELNET-001"] and found["kv"] == []
    assert rows["iptables"].threat.technique_id == "T1110" and rows["kv"].threat.technique_id == "T1046"


def test_wire(rows):
    assert rows["pan"].cef.startswith("CEF:0|Palo Alto Networks|PAN-OS|1.0|firewall|Palo Alto PAN-OS TRAFFIC Event: blocked TCP|4|src=192.168.1.105 spt=54321 suser=jdoe dst=")
    assert rows["pan"].leef.split("|")[5].split("\t")[:3] == ["src=192.168.1.105", "srcPort=54321", "usrName=jdoe"]


def test_rows_are_conserved_and_ids_stable(spark):
    data = [(v, "T", i) for i, v in enumerate([*LINES.values()] * 2)]
    raw = spark.createDataFrame(data, "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit("2026-09-01 00:00:00").cast("timestamp"))
    one = normalize(raw)
    assert events(one).count() + quarantine(one).count() == len(data)
    ids = {r.event_id for r in one.select("event_id").collect()}
    assert len(ids) == len(data) and ids == {r.event_id for r in normalize(raw).select("event_id").collect()}


def test_sigma_conditions(spark):
    def fires(condition, a, b, c):
        spec = {"id": "X", "title": "x", "tags": ["attack.t1046", "attack.command_and_control"], "detection": {"condition": condition, "a": {"x": "1"}, "b": {"y|startswith": ["1"]}, "c": {"z|re": "^1$"}, "list": ["1"]}}
        rule = sigma.parse_rule(spec)
        assert (rule.technique, rule.tactic) == ("T1046", "Command And Control")
        df = spark.range(1).select(
            F.create_map(F.lit("x"), F.lit(a), F.lit("y"), F.lit(b), F.lit("z"), F.lit(c)).alias("extensions"),
            *[F.lit(None).cast("string").alias(n) for n in ()],
        )
        df = df.withColumns(sigma.fields([rule])).withColumns(sigma.lowered([rule]))
        return df.select(sigma.condition(rule)).first()[0]

    assert fires("a", "1", "0", "0") and not fires("a", "0", "1", "1")
    assert fires("a and b", "1", "1", "0") and not fires("a and b", "1", "0", "1")
    assert fires("a or c", "0", "0", "1") and fires("not a", "0", "0", "0")
    assert fires("a and not b", "1", "0", "0") and not fires("a and not b", "1", "1", "0")
    assert fires("1 of them", "0", "1", "0") and not fires("all of them", "1", "1", "1")  # a list block never matches
    assert not fires("a and b or c", "1", "1", "1") and not fires("a and b and not c", "1", "1", "0")  # the grammar is flat


def test_dynamic_parser(spark):
    pattern = r"^\QSEC(1)\E\s+(?<token1>\S+)\s+(?:x|y)\s+([a(]*)(?<token2>\S+)\s+src=(?<token3>\S+)\s+dst=(?<token4>\S+)$"
    assert group_numbers(pattern) == ({"token1": 1, "token2": 3, "token3": 4, "token4": 5}, 5)
    spec = DynamicParser("p", pattern, (FieldMapping("token1", "timestampUtc"), FieldMapping("token2", "event.action", confidence=0.96), FieldMapping("token3", "source.ip"), FieldMapping("token4", "destination.ip"), FieldMapping("token9", "source.user")))
    raw = spark.createDataFrame([("SEC(1) 2026-08-30T10:32:21Z x [DENY] src=10.0.0.9:61000 dst=10.20.30.40/80", "T", 1)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.current_timestamp())
    r = normalize(raw, dynamic=[dynamic(spec)]).first()
    assert (r.parser_name, r.event.action, r.source.ip, r.source.port, r.destination.ip, r.destination.port, r.event.severity_id) == ("p", "blocked", "10.0.0.9", 61000, "10.20.30.40", 80, 4)
    assert r.timestamp_text == "2026-08-30T10:32:21Z" and r.average_confidence == 0.915


def test_config(spark):
    assert config_from_rules([{"key": "CONFIDENCE_MEDIUM_THRESHOLD", "value": "0.99"}, {"key": "ENRICHMENT_MITRE_ENABLED", "value": "false"}, {"key": "CONFIDENCE_HIGH_THRESHOLD", "value": "0.1", "enabled": False}]) == Config(medium_confidence=0.99, technique_mapping=False)
    raw = spark.createDataFrame([(LINES["kv"], "T", 1)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.current_timestamp())
    r = normalize(raw, Config(technique_mapping=False, sigma=False, ip_classification=False, medium_confidence=0.99)).first()
    assert r.threat.technique_id is None and r.threat.sigma_matches == [] and r.source.is_internal is None and r.low_confidence
