"""Inference of parsers for unknown lines: template mining, typing of tokens, patterns.

A miner's tree of templates has the number of tokens as its first level and the first four tokens below it, so lines are dealt by
these leaves and mined in order within each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import action as normal_action
from logloom.functions.text import strip
from logloom.operators.parsers.dynamic import DynamicParser, FieldMapping, dynamic
from logloom.sources.tables import materialised

VARIABLE = "<*>"
DEPTH, SIMILAR = 4, 0.5
#: Words that are variables of a template.
ACTION_WORDS = ("ALLOW", "ALLOWED", "PERMIT", "DENY", "DENIED", "BLOCK", "BLOCKED", "DROP", "DROPPED", "REJECT", "ACCEPT", "PASS")
#: Words by which a token is typed.
PROTOCOLS = ("TCP", "UDP", "ICMP", "GRE", "ESP", "AH", "IGMP", "OSPF", "SCTP", "TLS", "HTTP", "HTTPS", "DNS", "SSH")
ACTIONS = ("ALLOW", "ALLOWED", "PERMIT", "PERMITTED", "ACCEPT", "ACCEPTED", "PASS", "DENY", "DENIED", "DROP", "DROPPED", "BLOCK", "BLOCKED", "REJECT", "REJECTED", "RESET")
SEVERITIES = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFORMATIONAL", "INFO", "DEBUG", "HIGH", "MEDIUM", "LOW")
#: Keys of key=value tokens, with type, field and confidence.
KEYS = {
    ("src", "srcip", "source_ip", "src_ip"): ("IPV4", "source.ip", 0.99), ("dst", "dstip", "dest_ip", "dst_ip"): ("IPV4", "destination.ip", 0.99),
    ("spt", "srcport", "src_port", "source_port"): ("PORT", "source.port", 0.98), ("dpt", "dstport", "dest_port", "dst_port"): ("PORT", "destination.port", 0.98),
    ("proto", "protocol"): ("PROTOCOL", "network.protocol", 0.98), ("act", "action", "status"): ("ACTION", "event.action", 0.96), ("user", "username", "usr"): ("USER", "source.user", 0.95),
}


def is_pair(token: Column) -> Column:
    return token.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_.-]*=.")


def is_variable(token: Column) -> Column:
    """Holds an address, a time or a date, or is a number, a hash, or a word for an action."""
    word = F.regexp_replace(F.upper(token), r"""[\[\](),"';]""", "")
    return (
        token.rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}")
        | token.rlike(r"\A\d+\z")
        | (token.rlike(r"\A[0-9a-fA-F-]{8,}\z") & token.rlike(r"\d"))
        | word.isin(*ACTION_WORDS)
    )


def tokens(raw: Column) -> Column:
    return F.split(strip(raw), r"\s+")


def first_template(toks: Column) -> Column:
    """The template of a line that meets no other: pairs keep their key, variables become one sign."""
    return F.transform(toks, lambda t: F.when(is_pair(t), F.concat(F.substring_index(t, "=", 1), F.lit("=" + VARIABLE))).when(is_variable(t), F.lit(VARIABLE)).otherwise(t))


_PAIR = re.compile(r"[a-zA-Z_][a-zA-Z0-9_.-]*=.", re.DOTALL)


class _Leaf:
    """Templates of lines with as many tokens and the same first four, masked. Tokens are numbers, and templates the rows of a
    table, so that a line is held against all of them at once."""

    def __init__(self, width: int) -> None:
        self.names, self.ids = [VARIABLE], {VARIABLE: 0}
        self.n, self.tokens, self.keys = 0, np.zeros((16, width), np.int32), np.zeros((16, width), np.int32)

    def _id(self, token: str) -> int:
        n = self.ids.setdefault(token, len(self.names))
        if n == len(self.names):
            self.names.append(token)
        return n

    def _key(self, token: str, line: bool) -> int:
        """The number of a pair's key. What has none differs from all, in lines and in templates."""
        if line and not _PAIR.match(token):
            return -2
        key, sign, _ = token.partition("=")
        return self._id(key) if sign else -1

    def template(self, i: int) -> list[str]:
        return [self.names[t] for t in self.tokens[i]]

    def add(self, line: list[str], fresh: list[str]) -> int:
        """The number of the line's cluster: the most similar, the first of equals, or a new one. Its template takes the line in."""
        own, keys = np.array([self._id(t) for t in line]), np.array([self._key(t, True) for t in line])
        if self.n:
            same_key = self.keys[: self.n] == keys
            near = ((self.tokens[: self.n] == own) | (self.tokens[: self.n] == 0) | same_key).sum(axis=1)
            i = int(near.argmax())
            if near[i] >= SIMILAR * len(line):
                for j in np.flatnonzero((self.tokens[i] != own) & (self.tokens[i] != 0)):
                    old = self.names[self.tokens[i, j]]
                    kept = same_key[i, j] and _PAIR.match(old)
                    new = old.partition("=")[0] + "=" + VARIABLE if kept else VARIABLE
                    self.tokens[i, j], self.keys[i, j] = self._id(new), self._key(new, False)
                return i
        if self.n == len(self.tokens):
            self.tokens, self.keys = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.keys))
        self.tokens[self.n] = [self._id(t) for t in fresh]
        self.keys[self.n] = [self._key(t, False) for t in fresh]
        self.n += 1
        return self.n - 1


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, leaf, id, tokens, fresh template), sorted by the first three, to (length, leaf, id, cluster, template at that turn)."""
    at, tree = None, None
    for batch in batches:
        numbers, found = [], []
        for *where, line, fresh in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            if where != at:
                at, tree = where, _Leaf(len(line))
            numbers.append(tree.add(line, fresh))
            found.append(tree.template(numbers[-1]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers, pa.int32()), pa.array(found, pa.list_(pa.string()))], ["length", "leaf", "id", "cluster", "template"])


def mine(lines: DataFrame, raw: str = "raw_message", order: str = "ingest_seq") -> DataFrame:
    """(id, raw_message, cluster, template): each line's cluster, with the cluster's template after all lines.

    A leaf is what has as many tokens and the same first ``DEPTH`` of them, variables taken out; lines are clustered within their
    leaf, in order, so leaves are mined in parallel. What reaches a leaf's task is the variety of its lines, not their number: a shape
    (the line with its variables taken out) goes there once, with the first line that has it, and only templates are kept in
    memory. Later lines of the shape join that line's cluster. Null and blank lines are left out; an empty table gives no rows.
    """
    keyed = _keyed(lines, raw, order)
    joined = keyed.join(_clusters(keyed).select("length", "fresh", "leaf", "cluster", "template"), ["length", "fresh"])
    return _mined_rows(joined)


def mine_first(lines: DataFrame, raw: str = "raw_message", order: str = "ingest_seq") -> DataFrame:
    """The rows of ``mine`` that are the first of their shape, the first line of each template among them: enough to approve parsers, without a
    join and a typing of all lines."""
    return _mined_rows(_clusters(_keyed(lines, raw, order)))


def _keyed(lines: DataFrame, raw: str, order: str) -> DataFrame:
    toks = tokens(F.col(raw))
    rows = lines.where(F.coalesce(F.col(raw).rlike(r"\S"), F.lit(False))).select(F.col(order).cast("long").alias("id"), F.col(raw).alias("raw_message"), toks.alias("tokens"))
    return rows.withColumn("fresh", first_template(F.col("tokens"))).withColumn("length", F.size("tokens"))


def _clusters(keyed: DataFrame) -> DataFrame:
    """(length, fresh, leaf, id, raw_message, cluster, template): each shape with its first line and its cluster."""
    shapes = keyed.groupBy("length", "fresh").agg(F.min(F.struct("id", "tokens", "raw_message")).alias("first"))
    leaf = F.array_join(F.slice("fresh", 1, DEPTH), " ")
    sent = materialised(shapes.select("length", leaf.alias("leaf"), F.col("first.id").alias("id"), F.col("first.tokens").alias("tokens"), "fresh", F.col("first.raw_message").alias("raw_message")), "shapes")
    dealt = sent.select("length", "leaf", "id", "tokens", "fresh").repartition("length", "leaf").sortWithinPartitions("length", "leaf", "id")
    mined = materialised(dealt.mapInArrow(_mined, "length int, leaf string, id bigint, cluster int, template array<string>"), "mined")
    last = mined.groupBy("length", "leaf", "cluster").agg(F.max(F.struct("id", "template")).alias("last")).select("length", "leaf", "cluster", F.col("last.template").alias("template"))
    of_line = mined.select("length", "leaf", "id", "cluster").join(last, ["length", "leaf", "cluster"])
    return materialised(sent.select("length", "leaf", "id", "fresh", "raw_message").join(of_line, ["length", "leaf", "id"]), "clusters")


def _mined_rows(rows: DataFrame) -> DataFrame:
    name = F.concat_ws("-", F.col("length").cast("string"), F.substring(F.sha2("leaf", 256), 1, 16), F.col("cluster").cast("string"))
    return rows.select("id", "raw_message", name.alias("cluster"), F.array_join("template", " ").alias("template"))


def templates(mined: DataFrame) -> DataFrame:
    """(cluster, template, lines)"""
    return mined.groupBy("cluster", "template").agg(F.count("*").alias("lines"))


def _bound(x: Column, f) -> Column:
    """``f`` of a name for ``x``, which is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def _clean(t: Column) -> Column:
    return F.when(t.rlike(r"""[\[\](),"'; ]"""), F.trim(F.regexp_replace(t, r"""[\[\](),"';]""", ""))).otherwise(t)


def _pair_key(clean: Column) -> Column:
    return F.when(clean.contains("="), F.lower(F.substring_index(clean, "=", 1)))


def _kind(i: Column, before: Column, clean: Column, up: Column, low: Column) -> Column:
    """Type, field, confidence and value of a token at place ``i``: cleaned, in capitals, with its key as a pair, after the token ``before``. Patterns
    are tried only where a plain character that they need is there."""
    far = (i > 5) | F.lower(before).contains("dst")
    far_pair = (i > 5) | (F.lower(before) == "dst")
    side = lambda test, what: F.when(test, f"destination.{what}").otherwise(f"source.{what}")
    made = lambda type_, path, sure, value: F.struct(F.lit(type_).alias("type"), (path if isinstance(path, Column) else F.lit(path)).alias("path"), F.lit(sure).alias("confidence"), value.alias("value"))
    value = F.regexp_replace(clean, r"\A[^=]*=", "")
    pair = made("KEY_VALUE", F.concat(F.lit("extensions."), low), 0.85, value)
    for keys, (type_, path, sure) in KEYS.items():
        v = F.upper(value) if type_ == "PROTOCOL" else normal_action(value) if type_ == "ACTION" else value
        pair = F.when(low.isin(*keys), made(type_, path, sure, v)).otherwise(pair)
    here = F.concat(F.lit("extensions.token_"), i.cast("string"))
    ip_port = r"\A(?:[a-zA-Z0-9_-]+:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})[/:](\d{1,5})\z"
    dotted, digit = clean.contains("."), (clean >= "0") & (clean < ":")
    return (
        F.when(low.isNotNull() & clean.rlike(r"\A[^=]*=."), pair)
        .when(dotted & clean.rlike(ip_port), made("IP_PORT_PAIR", side(far_pair, "ip"), 0.98, F.regexp_extract(clean, ip_port, 1)))
        .when(dotted & digit & clean.rlike(r"\A(?:\d{1,3}\.){3}\d{1,3}\z"), made("IPV4", side(far, "ip"), 0.99, clean))
        .when(up.isin(*PROTOCOLS), made("PROTOCOL", "network.protocol", 0.98, up))
        .when(up.isin(*ACTIONS), made("ACTION", "event.action", 0.96, normal_action(up)))
        .when(up.isin(*SEVERITIES), made("SEVERITY", "event.severity", 0.92, F.lower(up)))
        .when(digit & clean.rlike(r"\A\d+\z") & clean.try_cast("int").between(1, 65535), made("PORT", side(far, "port"), 0.92, clean))
        .when(digit & clean.contains(":") & clean.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\z"), made("TIMESTAMP", "timestampUtc", 0.95, clean))
        .when(clean.contains("-") & clean.rlike(r"\A%?[A-Z0-9]+-\d+-\d+\z"), made("VENDOR_CODE", "extensions.vendorCode", 0.95, clean))
        .otherwise(made("STRING", here, 0.60, clean))
    )


def _placed(toks: Column, f) -> Column:
    """``f`` of each token, its place and the token before it."""
    return _bound(toks, lambda ts: F.transform(ts, lambda t, i: f(t, i, F.coalesce(F.get(ts, i - 1), F.lit("")))))


def typed(toks: Column) -> Column:
    """Each token's position, slot, type, field, confidence and value; what looks like nothing is a STRING of 0.60. Numbers over 32
    bits are no ports but strings."""

    def told(t: Column, i: Column, found: Column) -> Column:
        return F.struct(i.alias("position"), F.concat(F.lit("token"), i.cast("string")).alias("slot"), *[found[c].alias(c) for c in ("type", "path", "confidence", "value")], t.alias("sample"))

    def kind(t: Column, i: Column, before: Column) -> Column:
        forms = lambda c: F.struct(c.alias("clean"), F.upper(c).alias("up"), _pair_key(c).alias("low"))
        found = _bound(_bound(_clean(t), forms), lambda x: _kind(i, before, x["clean"], x["up"], x["low"]))
        return _bound(found, lambda x: told(t, i, x))

    return _placed(toks, kind)


def token_types(lines: DataFrame, raw: str = "raw_message") -> DataFrame:
    """(position, type, path, confidence, value): ``typed`` of all tokens, one a row, in compiled code."""
    placed = _placed(tokens(F.col(raw)), lambda t, i, before: F.struct(i.alias("position"), t.alias("token"), before.alias("before")))
    rows = lines.select(F.inline(placed)).withColumn("clean", _clean(F.col("token")))
    rows = rows.withColumns({"up": F.upper("clean"), "low": _pair_key(F.col("clean"))})
    return rows.select("position", _kind(*map(F.col, ("position", "before", "clean", "up", "low"))).alias("found")).select("position", "found.*")


def pattern(template: Column) -> Column:
    """A pattern with a named group for each variable of a template (an array); other tokens are quoted."""
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    group = lambda i: F.concat(F.lit("(?<token"), i.cast("string"), F.lit(">\\S+)"))

    def part(t: Column, i: Column) -> Column:
        keyed = t.contains("=") & t.endswith(VARIABLE)
        return F.when(keyed, F.concat(quoted(F.concat(F.substring_index(t, "=", 1), F.lit("="))), group(i))).when(t == VARIABLE, group(i)).otherwise(quoted(t))

    return F.concat(F.lit("^"), F.array_join(F.transform(template, part), "\\s+"), F.lit("$"))


def infer(mined: DataFrame) -> DataFrame:
    """(id, template, pattern, mappings, confidence, tier, recommended): each mined line's tokens typed, and the mean confidence over
    its fields, of which the last token of a field counts."""
    toks = mined.withColumn("tokens", tokens(F.col("raw_message"))).withColumn("mappings", typed(F.col("tokens")))
    latest = F.filter("mappings", lambda m, i: ~F.exists(F.slice(F.col("mappings"), i + 2, F.size("mappings")), lambda n: n["path"] == m["path"]))
    total = F.aggregate(latest, F.lit(0).cast("long"), lambda a, m: a + F.round(m["confidence"] * 100).cast("long"))
    n = F.size(latest)
    mean = F.floor((total * 20 + n) / (n * 2)).cast("double") / 1000
    named = F.concat(F.lit("custom_"), F.pmod(F.crc32("raw_message"), F.lit(10_000)).cast("string"), F.lit("_parser"))
    scored = toks.withColumn("confidence", mean)
    tier = F.when(F.col("confidence") >= 0.90, "HIGH").when(F.col("confidence") >= 0.70, "MEDIUM").otherwise("LOW")
    return scored.select("id", "raw_message", "template", pattern(F.split("template", " ")).alias("pattern"), "mappings", "confidence", tier.alias("tier"), (F.col("confidence") >= 0.85).alias("recommended"), named.alias("suggested_name"))


def synthesize(row, name: str | None = None, version: str = "1.0") -> DynamicParser:
    """A parser from a row of ``infer``, as an operator approves it."""
    mappings = tuple(FieldMapping(m["slot"], m["path"], m["type"], m["confidence"], m["sample"]) for m in row["mappings"])
    if not (name or row["suggested_name"]) or not row["pattern"]:
        raise ValueError("a parser needs a name and a pattern")
    return DynamicParser(name or row["suggested_name"], row["pattern"], mappings, row["confidence"], version, template=row["template"])


def approve_all(inferred: DataFrame, registry: Registry, most: int = 100) -> int:
    """Approves a parser for each template of ``infer``'s rows, from the row with the smallest id; returns how many. Parsers are part
    of the plans that use them, so more than ``most`` templates are an error: merge them, or raise the bound. A name that another
    template has already gets a number."""
    first = inferred.groupBy("template").agg(F.min_by(F.struct(*[c for c in inferred.columns if c != "template"]), "id").alias("row"))
    rows = first.select("template", "row.*").orderBy("template").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    taken: set[str] = set()
    for row in rows:
        name, n = row.suggested_name, 1
        while name in taken:
            n += 1
            name = f"{row.suggested_name}_{n}"
        taken.add(name)
        registry.approve(synthesize(row, name))
    return len(rows)


class Registry:
    """Approved parsers by name, in versions. The latest active version of each is asked; plans built afterwards see changes."""

    def __init__(self) -> None:
        self._versions: dict[str, list[DynamicParser]] = {}
        self._inactive: set[str] = set()

    def approve(self, parser: DynamicParser) -> None:
        self._versions.setdefault(parser.name, []).append(parser)
        self._inactive.discard(parser.name)

    def toggle(self, name: str, active: bool) -> None:
        (self._inactive.discard if active else self._inactive.add)(name)

    def versions(self, name: str) -> list[DynamicParser]:
        return [*self._versions.get(name, [])]

    def parsers(self) -> list:
        return [dynamic(v[-1]) for n, v in sorted(self._versions.items()) if n not in self._inactive]

    def save(self, spark, path: str) -> None:
        rows = [(p.name, p.pattern, p.confidence, p.version, p.format_type, p.template, p.name not in self._inactive, [(m.slot, m.path, m.inferred_type, m.confidence, m.sample) for m in p.mappings]) for v in self._versions.values() for p in v]
        schema = "name string, pattern string, confidence double, version string, format_type string, template string, active boolean, mappings array<struct<slot:string,path:string,inferred_type:string,confidence:double,sample:string>>"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Registry:
        found = cls()
        for r in spark.read.parquet(path).orderBy("name", "version").collect():
            found.approve(DynamicParser(r.name, r.pattern, tuple(FieldMapping(m.slot, m.path, m.inferred_type, m.confidence, m.sample) for m in r.mappings), r.confidence, r.version, r.format_type, template=r.template))
            found.toggle(r.name, r.active)
        return found
