"""The index of rules gives the matches of the rules compiled one by one, in a plan of one size."""

import random

from pyspark.sql import functions as F

from logloom.operators import rule_index, sigma
from logloom.plans.config import Config
from logloom.plans.normalize import normalize

WORDS = ["scan", "sweep", "deny", "drop", "10.0", "admin", "tunnel", "a", "é", "𝒳yz", "txt-query", "Portscan", "root login", ""]
FIELDS = ["raw.message", "event.action", "dst_port", "source.ip", "extensions.msg", "message", "payload", "dst", "none.such"]


def frame(spark, text):
    return spark.createDataFrame([(t, "T", i) for i, t in enumerate(text)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit("2026-01-05 00:00:00").cast("timestamp"))


def some_rules(rng, n):
    mods = ["", "|contains", "|contains", "|startswith", "|endswith", "|re"]
    values = [*WORDS, 22, "blocked", "allowed", 443, "10.0.0.5", "(", r"10\.\d+", "^src", "QUERY"]

    def block():
        return {rng.choice(FIELDS) + rng.choice(mods): rng.choice([[], [rng.choice(values)], rng.sample(values, 3)]) or rng.choice(values) for _ in range(rng.randint(0, 2))}

    conditions = ["selection", "1 of them", "all of them", "a and not b", "a and b", "a or b", "not a", "a", "(a) or (c)", "all of selection*", "a and not zz", "zz", "not zz", "any of selection", "", "A and b"]
    made = []
    for i in range(n):
        detection = {name: block() for name in rng.sample(["selection", "a", "b", "c"], rng.randint(0, 4))}
        made.append(sigma.parse_rule({"id": f"R{i:04}", "title": f"t{i}", "level": rng.choice(["low", "high"]), "tags": ["attack.t1046", "attack.discovery"][: rng.randint(0, 2)], "detection": detection | {"condition": rng.choice(conditions)}}))
    return made


def lines_for(rng, n):
    made = ["", None, "no parser takes this"]
    for _ in range(n):
        words = " ".join(rng.sample(WORDS, 3))
        made.append(f'src=10.0.0.{rng.randint(1, 9)} dst=10.0.{rng.randint(0, 3)}.5 dpt={rng.choice([22, 443, 53])} action={rng.choice(["deny", "allow"])} msg="{words}"')
    return made


def by_event(rows):
    return {r.ingest_seq: (r.threat.sigma_matches and [tuple(m) for m in r.threat.sigma_matches]) for r in rows.select("ingest_seq", "threat").collect()}


def both(spark, rules, lines):
    """(matches of the index, matches of rules compiled in groups of 40)"""
    plain = normalize(frame(spark, lines), Config(sigma=False))
    got = by_event(rule_index.with_matches(plain, rule_index.build(spark, rules)))
    want = {}
    for at in range(0, max(len(rules), 1), 40):
        part = rules[at : at + 40]
        rows = plain.withColumns(sigma.fields(part)).withColumns(sigma.lowered(part)) if part else plain
        for r in rows.select("ingest_seq", "outcome.code", sigma.evaluate(part).alias("m")).collect():
            parsed = r.code not in ("UNPARSEABLE_FORMAT", "PARSER_FAILURE")
            want[r.ingest_seq] = [*(want.get(r.ingest_seq) or []), *map(tuple, r.m)] if parsed else None
    return got, want


def test_same_matches_as_rules_compiled(spark):
    rng = random.Random(5)
    got, want = both(spark, some_rules(rng, 160), lines_for(rng, 150))
    assert got == want and sum(len(x or []) for x in got.values()) > 1000


def test_bundled_and_no_rules(spark):
    lines = lines_for(random.Random(6), 50)
    got, want = both(spark, list(sigma.RULES), lines)
    assert got == want and any(got.values())
    got, want = both(spark, [], lines)
    assert got == want and not any(got.values())


def test_three_thousand_rules(spark):
    """A rule for each line, by a word that it alone holds, and a part of a longer one: the plan is that of three rules."""
    lines = [f'src=10.0.0.1 dpt=22 action=deny msg="attack w{i * 7919 % 100_003}w here"' for i in range(3000)]
    rules = [sigma.parse_rule({"id": f"R{i:04}", "title": "t", "detection": {"selection": {"raw.message|contains": f"w{i * 7919 % 100_003}w", "dst_port": 22}}}) for i in range(3000)]
    plans, plain = [], normalize(frame(spark, lines), Config(sigma=False))
    for n in (3, 3000):
        found = rule_index.build(spark, rules[:n]).matches(plain)
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    rows = found.join(plain.select("event_id", "ingest_seq"), "event_id").select(F.format_string("R%04d", "ingest_seq").alias("want"), F.col("sigma_matches.rule_id").alias("got")).collect()
    assert len(rows) == 3000 and all(r.got == [r.want] for r in rows)
    assert plans[0] == plans[1]


def test_a_line_of_a_megabyte(spark):
    plain = normalize(frame(spark, ["src=10.0.0.1 dpt=22 action=deny msg=" + "x" * 1_000_000 + "needle"]), Config(sigma=False))
    rule = sigma.parse_rule({"id": "R", "title": "t", "detection": {"selection": {"raw.message|contains": "xneedle"}}})
    assert rule_index.build(spark, [rule]).matches(plain).count() == 1
