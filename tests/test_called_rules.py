"""Rules that share a needle are called up by the needle that they do not share."""

from pyspark.sql import functions as F
from test_proof_size import shuffled

from logloom.operators import rule_index, sigma
from logloom.plans.normalize import normalize
from logloom.sources.tables import materialised


def test_a_shared_needle_calls_up_no_rule(spark):
    raw = spark.range(400).select(F.concat(F.lit('device="FG" action=deny src=10.0.0.'), F.col("id") % 200).alias("raw_message"), F.lit("T").alias("source"), F.current_timestamp().alias("received_at"), F.col("id").alias("ingest_seq"))
    rows = materialised(normalize(raw), "called")
    rule = lambda i: {"id": f"R{i:03d}", "title": "t", "detection": {"where": {"source.ip": f"10.0.0.{i}"}, "what": {"event.action": "blocked"}, "condition": "where and what"}}
    index = rule_index.build(spark, [sigma.parse_rule(rule(i)) for i in range(100)])
    before = shuffled(spark)
    got = {r.ingest_seq: [m.rule_id for m in r.sigma_matches] for r in index.matches(rows).join(rows.select("event_id", "ingest_seq"), "event_id").collect()}
    assert got == {i: [f"R{i % 200:03d}"] for i in range(400) if i % 200 < 100}
    assert shuffled(spark) - before < 10 * 400
