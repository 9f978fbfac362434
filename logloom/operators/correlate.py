"""Detections put together by entity: incidents over several tactics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import blank
from logloom.operators.lineage import numbered
from logloom.sources.tables import materialised

#: Tactics in kill-chain order.
TACTICS = (
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion",
    "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
)
#: Fixed value: the end of every narrative.
DISCLAIMER = " — pattern consistent with a multi-stage attack; probable initiating event is the first entry above (heuristic hypothesis, not a proven causal claim)."


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def canonical_tactic(tactic: Column) -> Column:
    """A tactic's usual spelling; unknown ones stay, null is "Unknown Tactic"."""
    names = F.create_map(*[F.lit(x) for t in TACTICS for x in (t.lower().replace(" ", ""), t)])
    return F.coalesce(F.try_element_at(names, _plain(tactic)), tactic, F.lit("Unknown Tactic"))


def tactic_rank(tactic: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, t in enumerate(TACTICS) for x in (t.lower().replace(" ", ""), i + 1)])
    return F.coalesce(F.try_element_at(ranks, _plain(tactic)), F.lit(999))


def tactic_chain(tactics: Column) -> Column:
    """Tactics by rank, then name."""
    ranked = F.array_sort(F.transform(tactics, lambda t: F.struct(tactic_rank(t).alias("rank"), t.alias("tactic"))))
    return F.transform(ranked, lambda x: x["tactic"])


def severity_score(severity: Column) -> Column:
    up = F.upper(F.trim(severity))
    return F.when(up == "CRITICAL", 4).when(up == "HIGH", 3).when(up == "MEDIUM", 2).when(up == "LOW", 1).otherwise(0)


def incident_severity(highest: Column, tactics: Column) -> Column:
    """The highest member's severity, at least LOW; one more from four tactics, at least MEDIUM from three."""
    base = F.greatest(F.coalesce(highest, F.lit(0)), F.lit(1))
    score = F.when(tactics >= 4, F.least(base + 1, F.lit(4))).when((tactics >= 3) & (base <= 1), 2).otherwise(base)
    return F.when(score == 4, "CRITICAL").when(score == 3, "HIGH").when(score == 2, "MEDIUM").otherwise("LOW")


def detections(events: DataFrame, matches: DataFrame, since: datetime | Column) -> DataFrame:
    """Rule matches, and events with a technique that no match has, in the window, with the entity of each.

    A match counts by when it was made, an event by its own time; what is stored must be newer than ``since``. A match's
    address is that of its event where the event is at hand."""
    since = since if isinstance(since, Column) else F.lit(since)
    stored = events.where(F.col("received_at") > since)
    user = F.coalesce(F.when(~blank(F.col("source.user")), F.col("source.user")), F.col("extensions")["user"])
    who = stored.select(F.col("event_id").alias("who_id"), F.when(~blank(F.col("source.ip")), F.col("source.ip")).alias("event_ip"), user.alias("event_user"))
    made = matches.where(F.col("matched_at") > since)
    from_rules = made.select("event_id", F.col("rule_title").alias("title"), "technique_id", "tactic", F.col("matched_at").alias("at"), "severity", F.when(~blank(F.col("source_ip")), F.col("source_ip")).alias("match_ip"))
    tagged = stored.where("threat.technique_id is not null").join(made.select("event_id"), "event_id", "left_anti")
    title = F.coalesce("threat.technique_name", F.concat(F.lit("MITRE Technique "), F.col("threat.technique_id")))
    from_events = tagged.select("event_id", title.alias("title"), F.col("threat.technique_id").alias("technique_id"), F.col("threat.tactic").alias("tactic"), F.col("timestamp_utc").alias("at"), F.col("event.severity").alias("severity"), F.lit(None).cast("string").alias("match_ip"))
    both = from_rules.unionByName(from_events).join(who, F.col("event_id") == F.col("who_id"), "left")
    keyed = both.select("event_id", "title", "technique_id", "tactic", "at", "severity", F.explode(F.array(
        F.struct(F.lit("IP").alias("key_type"), F.coalesce("event_ip", "match_ip").alias("key")), F.struct(F.lit("USER").alias("key_type"), F.col("event_user").alias("key")),
    )).alias("entity"))
    key = F.col("entity.key")
    return keyed.where(~blank(key) & (F.lower(key) != "unknown") & F.col("at").isNotNull() & (F.col("at") >= since)).select("entity.key_type", "entity.key", "event_id", "title", "technique_id", "tactic", "at", "severity")


def incidents(found: DataFrame) -> DataFrame:
    """One row for each entity with at least two tactics. All sums are made before the shuffle: no entity's detections are gathered.

    The root is the earliest detection (the smallest event id of equal times). Entities are told apart by key type too."""
    per_event = found.groupBy("key_type", "key", "event_id").agg(
        F.collect_set(F.when(F.col("tactic").isNotNull(), canonical_tactic(F.col("tactic")))).alias("tactics"), F.min("at").alias("first"), F.max("at").alias("last"), F.max(severity_score(F.col("severity"))).alias("score"), F.count("*").alias("n")
    )
    per_entity = per_event.groupBy("key_type", "key").agg(
        F.array_distinct(F.flatten(F.collect_set("tactics"))).alias("tactics"), F.min("first").alias("first_seen_at"), F.max("last").alias("last_seen_at"),
        F.min(F.struct("first", "event_id")).alias("root"), F.max("score").alias("score"), F.count("*").alias("event_count"), F.sum("n").alias("detection_count"),
    )
    return told(per_entity.where(F.size("tactics") >= 2))


def told(per_entity: DataFrame, *more: str) -> DataFrame:
    """An entity's sums as an incident."""
    n = F.size("tactics")
    key = F.upper(F.substring(F.sha2(F.concat_ws("|", "key_type", "key"), 256), 1, 8))
    return per_entity.select(
        F.concat(F.lit("INC-"), key).alias("incident_key"), "key_type", F.col("key").alias("correlation_key"), F.col("root.event_id").alias("root_event_id"), tactic_chain(F.col("tactics")).alias("tactic_chain"),
        n.alias("distinct_tactic_count"), "event_count", "detection_count", incident_severity(F.col("score"), n).alias("severity"), F.lit("OPEN").alias("status"), "first_seen_at", "last_seen_at", *more,
    )


def members(found: DataFrame, of: DataFrame) -> DataFrame:
    """The detections of incidents, a row each: as many as there are, in no one place. The incidents are written first, so that
    Spark can split an entity with many detections over tasks."""
    keys = materialised(of.select("incident_key", "key_type", F.col("correlation_key").alias("key")), "incidents")
    return found.join(keys, ["key_type", "key"])


STEPS = 10_000  # detections told in one part of a narrative


def narratives(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(incident_key, part, parts, member_event_ids, narrative) from members. A narrative tells all of an incident's members, in order;
    it comes in parts of ``steps`` of them, so that no entity's history is gathered in one place. The parts of an incident, put
    together in order, are its narrative; most have one part. An event's id is listed once, in the part that tells of it first, so the
    parts' ids together are the incident's distinct events."""
    order = ["at", "event_id", "title", "technique_id", "tactic"]
    placed = numbered(rows.select("incident_key", "key", *order), ["incident_key"], order, "place").withColumn("part", F.floor(F.col("place") / steps))
    placed = materialised(placed, "placed")
    first = materialised(placed.groupBy(F.col("incident_key").alias("i"), F.col("event_id").alias("e")).agg(F.min("place").alias("first")), "first-places")
    marked = placed.join(first, (F.col("incident_key") == F.col("i")) & F.col("event_id").eqNullSafe(F.col("e"))).withColumn("new", F.col("place") == F.col("first"))
    told = marked.groupBy("incident_key", "key", "part").agg(F.array_sort(F.collect_list(F.struct("place", *order, "new"))).alias("steps"))
    last = F.max("part").over(Window.partitionBy("incident_key"))  # over parts, not members
    told = told.withColumn("parts", last + 1)
    filled = lambda x, default: F.when(blank(x), F.lit(default)).otherwise(x)
    step = lambda s: F.concat(
        F.lit("'"), filled(s["title"], "Security Telemetry Event"), F.lit("' ("), filled(s["technique_id"], "Unknown Technique"), F.lit(", "), canonical_tactic(s["tactic"]), F.lit(") at "),
        F.coalesce(F.date_format(s["at"], "yyyy-MM-dd HH:mm:ss'Z'"), F.lit("unknown time")),
    )
    begin = F.when(F.col("part") == 0, F.concat(F.col("key"), F.lit(" triggered "))).otherwise(", followed by ")
    end = F.when(F.col("part") == F.col("parts") - 1, F.lit(DISCLAIMER)).otherwise("")
    text = F.concat(begin, F.array_join(F.transform("steps", step), ", followed by "), end)
    return told.select("incident_key", "part", "parts", F.transform(F.filter("steps", lambda s: s["new"]), lambda s: s["event_id"]).alias("member_event_ids"), text.alias("narrative"))


def merge(known: DataFrame, new: DataFrame) -> DataFrame:
    """New incidents into those on record: an incident that isn't closed takes the new findings and keeps its key and the wider span."""
    open_ones = known.where("status <> 'CLOSED'").select("key_type", "correlation_key", F.col("incident_key").alias("old_key"), F.col("status").alias("old_status"), F.col("first_seen_at").alias("old_first"), F.col("last_seen_at").alias("old_last"))
    joined = new.join(open_ones, ["key_type", "correlation_key"], "left")
    updated = joined.select(*[
        F.coalesce("old_key", "incident_key").alias(c) if c == "incident_key" else F.coalesce("old_status", "status").alias(c) if c == "status"
        else F.least("old_first", "first_seen_at").alias(c) if c == "first_seen_at" else F.greatest("old_last", "last_seen_at").alias(c) if c == "last_seen_at" else F.col(c)
        for c in new.columns
    ])
    # A closed incident's key is free again; its successor gets one of its own.
    closed = known.where("status = 'CLOSED'").groupBy(F.col("incident_key").alias("taken")).agg(F.count("*").alias("times"))
    fresh = updated.join(closed, F.col("incident_key") == F.col("taken"), "left")
    fresh = fresh.withColumn("incident_key", F.when(F.col("times").isNotNull(), F.concat("incident_key", F.lit("-"), F.col("times").cast("string"))).otherwise(F.col("incident_key"))).drop("taken", "times")
    untouched = known.join(new.select("key_type", "correlation_key"), ["key_type", "correlation_key"], "left_anti").unionByName(known.where("status = 'CLOSED'").join(new.select("key_type", "correlation_key"), ["key_type", "correlation_key"], "left_semi"))
    return fresh.select(*known.columns).unionByName(untouched.select(*known.columns))


def stages(rows: DataFrame) -> DataFrame:
    """An incident's detections rolled up by tactic, in the order in which the tactics appear."""
    rolled = rows.groupBy("incident_key", canonical_tactic(F.col("tactic")).alias("stage")).agg(
        F.min("at").alias("first_at"), F.count("*").alias("detections"), F.count_distinct("title").alias("rules"), F.count_distinct("technique_id").alias("techniques")
    )
    return rolled


def with_status(items: DataFrame, log: DataFrame, key: str | list[str]) -> DataFrame:
    """The latest entry of a status log (key, status, at) over the items' own status. The key has to be one item's: incidents' and raw lines' short
    ids can be shared."""
    latest = log.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max_by("status", "at").alias("logged"))
    return items.join(latest, key, "left").withColumn("status", F.coalesce("logged", "status")).drop("logged")
