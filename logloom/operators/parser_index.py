"""Approved parsers in a table, looked up by hash joins: any number of them, in plans of one size.

A parser that was made from a template takes a line whose tokens are as many, equal at its literals and led by its keys. So parsers are
filed by length, by the mask of their first tokens (what is a literal, a key, a variable) with what stands there, and by the whole mask with
what stands there; a line asks only for masks that its length and its first tokens have.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import action, iso, nonempty, strip, to_map
from logloom.operators.infer import VARIABLE, pattern, tokens
from logloom.operators.parsers.base import Work, parsed
from logloom.operators.parsers.dynamic import _after_key, ip_only, port_only
from logloom.sources.tables import materialised, put

HEAD = 4
#: A table of parsers, as registries save it.
PARSERS = "name string, pattern string, confidence double, version string, format_type string, template string, active boolean, mappings array<struct<slot:string,path:string,inferred_type:string,confidence:double,sample:string>>"
_CANONICAL = ("source.ip", "destination.ip", "source.port", "destination.port", "network.protocol", "event.action", "source.user", "timestampUtc")
_SPEC = "struct<name:string,version:string,format_type:string,slots:array<struct<slot:string,path:string,position:int,skip:int,sure:int>>>"


def _fold(t: Column) -> Column:
    return F.translate(t, string.ascii_uppercase, string.ascii_lowercase)


def _key(t: Column) -> Column:
    return F.substring_index(t, "=", 1)


def _kind(t: Column) -> Column:
    return F.when(t.contains("=") & t.endswith(VARIABLE), "K").when(t == VARIABLE, "V").otherwise("L")


def _filed(template: Column) -> Column:
    """What stands at a template's literals and keys."""
    return F.array_join(F.transform(template, lambda t: F.when(_kind(t) == "K", F.concat(_fold(_key(t)), F.lit("="))).when(t == VARIABLE, "").otherwise(_fold(t))), " ")


def _asked(toks: Column, mask: Column) -> Column:
    """What stands in a line where a mask has literals and keys; a line end, which no token holds, where there is no key with a value."""
    valued = lambda t: t.contains("=") & (F.char_length(t) > F.char_length(_key(t)) + 1)
    at = lambda t, k: F.when(k == "L", _fold(t)).when(k == "V", "").otherwise(F.when(valued(t), F.concat(_fold(_key(t)), F.lit("="))).otherwise("\n"))
    return F.array_join(F.zip_with(toks, F.split(mask, ""), at), " ")


def approved(inferred: DataFrame, version: str = "1.0") -> DataFrame:
    """A table of parsers, one for each template of ``infer``'s rows, from the row with the smallest id. A name that another template has already
    gets a number. Rows without a name or a pattern give none."""
    first = inferred.where("suggested_name <> '' AND pattern <> ''").groupBy("template").agg(F.min_by(F.struct("suggested_name", "pattern", "confidence", "mappings"), "id").alias("row"))
    numbered = first.selectExpr("template", "row.*", "row_number() OVER (PARTITION BY row.suggested_name ORDER BY template) AS k")
    name = F.when(F.col("k") == 1, F.col("suggested_name")).otherwise(F.concat("suggested_name", F.lit("_"), F.col("k").cast("string")))
    kept = F.transform("mappings", lambda m: F.struct(m["slot"].alias("slot"), m["path"].alias("path"), m["type"].alias("inferred_type"), m["confidence"].alias("confidence"), m["sample"].alias("sample")))
    return numbered.select(name.alias("name"), "pattern", "confidence", F.lit(version).alias("version"), F.lit("CUSTOM").alias("format_type"), "template", F.lit(True).alias("active"), kept.alias("mappings"))


def latest(parsers: DataFrame) -> DataFrame:
    """The latest version of each name, where that is active. A null ``active`` counts as active; rows without a name are left out."""
    rest = [c for c in parsers.columns if c != "name"]
    newest = parsers.where("name IS NOT NULL").groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("version", "pattern")).alias("row"))
    return newest.select("name", *[F.col(f"row.{c}").alias(c) for c in rest]).where("coalesce(active, true)")


def _of_template() -> Column:
    return F.coalesce(pattern(F.split("template", " ")) == F.col("pattern"), F.lit(False))


def unfiled(parsers: DataFrame) -> DataFrame:
    """Active parsers whose pattern is written by hand. They can't be filed by tokens; ``normalize`` takes them as ``dynamic``."""
    return latest(parsers).where(~_of_template())


@dataclass(frozen=True)
class ParserIndex:
    """heads (length, heads), masks (length, head, head_filed, mask), entries (mask, filed, name), specs (name, spec): written tables."""

    heads: DataFrame
    masks: DataFrame
    entries: DataFrame
    specs: DataFrame

    def lookup(self, lines: DataFrame) -> DataFrame:
        """(raw_hash, name): for each different line that a parser takes, the first such parser by name. ``lines`` has raw_hash and raw_message;
        null and blank lines meet none. What is shuffled are hits, first summed in their tasks, not lines, as long as Spark broadcasts the index."""
        rows = lines.where(strip(F.col("raw_message")) != "").select("raw_hash", tokens(F.col("raw_message")).alias("tokens")).withColumn("length", F.size("tokens"))
        near = rows.join(self.heads, "length").select("raw_hash", "tokens", "length", F.explode("heads").alias("head"))
        near = near.withColumn("head_filed", _asked(F.slice("tokens", 1, HEAD), F.col("head"))).join(self.masks, ["length", "head", "head_filed"])
        hits = near.select("raw_hash", "mask", _asked(F.col("tokens"), F.col("mask")).alias("filed")).join(self.entries, ["mask", "filed"])
        return hits.groupBy("raw_hash").agg(F.min("name").alias("name"))

    def attach(self, raw: DataFrame, raw_hash: Column, path: str | None = None) -> DataFrame:
        """``raw`` with a column ``approved``, the parser that takes the line, or null. Hits are written first, to ``path`` where one is given (it is
        replaced), so that the join is with a table: Spark broadcasts it if it is small, and else splits a hot line."""
        hashed = raw.withColumn("raw_hash", raw_hash)
        found = self.lookup(hashed)
        if path:
            put(found, path)
            found = raw.sparkSession.read.schema(found.schema).parquet(path)
        else:
            found = materialised(found, "approved")
        named = hashed.join(found.withColumnRenamed("name", "approved_name"), "raw_hash", "left")
        return named.join(self.specs.select(F.col("name").alias("approved_name"), F.col("spec").alias("approved")), "approved_name", "left").drop("approved_name")


def build(parsers: DataFrame) -> ParserIndex:
    """The index of a table of parsers (``PARSERS``): the active ones that are made from a template. Parsers of one template are all filed; a
    table without rows gives an index that takes no line."""
    kinds = F.col("kinds")
    rows = latest(parsers).where(_of_template()).withColumn("template", F.split("template", " ")).withColumn("kinds", F.transform("template", _kind))
    # The place of a mapping's group: its slot is named token and a number, underscores aside, and a variable or a key stands there.
    place = lambda m: F.regexp_extract(F.replace(m["slot"], F.lit("_"), F.lit("")), r"\Atoken(0|[1-9][0-9]*)\z", 1).try_cast("int")
    skip = lambda t: F.when(_kind(t) == "K", F.char_length(_key(t)) + 1).otherwise(0)
    sure = lambda m: F.rint(F.coalesce(m["confidence"], F.col("confidence")) * 100).cast("int")
    grouped = F.filter("mappings", lambda m: F.coalesce(F.get(kinds, place(m)) != "L", F.lit(False)))
    slots = F.transform(grouped, lambda m: F.struct(m["slot"].alias("slot"), m["path"].alias("path"), place(m).alias("position"), skip(F.get(F.col("template"), place(m))).cast("int").alias("skip"), sure(m).alias("sure")))
    head = F.slice("template", 1, HEAD)
    filed = materialised(
        rows.select(
            "name", F.size("template").alias("length"), F.array_join(F.transform(head, _kind), "").alias("head"), _filed(head).alias("head_filed"), F.array_join("kinds", "").alias("mask"), _filed(F.col("template")).alias("filed"),
            F.struct("name", "version", "format_type", F.coalesce(slots, F.array()).alias("slots")).cast(_SPEC).alias("spec"),
        ),
        "parsers",
    )
    heads = filed.groupBy("length").agg(F.collect_set("head").alias("heads"))  # 81 masks of four tokens at most
    masks = filed.select("length", "head", "head_filed", "mask").distinct()
    return ParserIndex(materialised(heads, "heads"), materialised(masks, "masks"), materialised(filed.groupBy("mask", "filed").agg(F.min("name").alias("name")), "entries"), filed.select("name", "spec"))


def parse(w: Work, raw: Column, line: Column, received: Column) -> Column:
    """The fields of a line by the parser in ``approved``, taken by the place of their token. Of values for one path the last wins."""
    toks = w.keep(1, "tokens", tokens(raw))
    value = lambda s: strip(F.regexp_replace(nonempty(F.substr(F.get(toks, s["position"]), s["skip"] + 1)), r"""[\[\](),"';]""", ""))
    found = F.transform("approved.slots", lambda s: F.struct(s["slot"].alias("slot"), s["path"].alias("path"), s["sure"].alias("sure"), value(s).alias("v")))
    got = w.keep(2, "values", F.filter(found, lambda s: s["v"].isNotNull()))

    def last(make, *paths: str) -> Column:
        made = F.transform(F.filter(got, lambda s: s["path"].isin(*paths)), make)
        return F.try_element_at(F.filter(made, lambda x: x.isNotNull()), F.lit(-1))

    def port(side: str) -> Column:
        return last(lambda s: F.when((s["path"] == f"{side}.port") | s["v"].contains(":") | s["v"].contains("/"), port_only(s["v"])), f"{side}.port", f"{side}.ip")

    act = w.keep(3, "act", F.coalesce(last(lambda s: action(_after_key(s["v"])), "event.action"), F.lit("allowed")))
    proto = w.keep(3, "proto", F.coalesce(last(lambda s: F.upper(_after_key(s["v"])), "network.protocol"), F.lit("TCP")))
    blocked = act == "blocked"
    more = w.keep(3, "more", F.filter(got, lambda s: ~s["path"].isin(*_CANONICAL)))
    return parsed(
        timestamp_text=F.coalesce(last(lambda s: s["v"], "timestampUtc"), iso(received)), category="network_traffic", type="firewall", action=act,
        severity=F.when(blocked, "high").otherwise("informational"), severity_id=F.when(blocked, 4).otherwise(1), message=F.concat(F.lit("Dynamic Log: "), act, F.lit(" "), proto),
        src_ip=last(lambda s: ip_only(s["v"]), "source.ip"), src_port=port("source"), src_user=last(lambda s: _after_key(s["v"]), "source.user"),
        dst_ip=last(lambda s: ip_only(s["v"]), "destination.ip"), dst_port=port("destination"), protocol=proto, direction="egress", vendor="DynamicVendor", product=F.col("approved.name"),
        raw_format=F.col("approved.format_type"), extensions=to_map(more["slot"], more["v"]), confidence=to_map(got["path"], got["sure"]),
    )
