"""Thousands of Sigma rules: an inverted index from what a rule's values hold to the rules, and exact conditions on candidates alone.

Each value of a criterion (a needle) is filed under its field and one key: the whole value where it has to be equal, its first or last three
characters, or, of a value to be contained, the three characters that fewest needles hold. Values that are shorter, and patterns, are held
against every value of their field. An event asks by its own keys, in a hash join; a needle that is found is then tested in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.sigma import MATCH, SigmaRule, compiles, value_of
from logloom.sources.tables import materialised

GRAM = 3
_NEEDLES = "field string, key string, modifier string, needle string, needle_no int"
_USES = "needle_no int, rule_no int"
_RULES = f"rule_no int, found {MATCH}, needles array<array<array<int>>>, every boolean, parts array<int>, without array<int>"


def _verdict(rule: SigmaRule) -> tuple[bool, list[int], list[int]] | None:
    """(every, parts, without): the rule holds where all (every) or any of the blocks ``parts`` do and none of ``without``. None: it never does."""
    numbers = {name: i for i, name in enumerate(rule.blocks)}
    text = (rule.condition or "").strip().lower()

    def some(names: list[str]) -> list[int | None]:
        found = [numbers.get(n.replace("(", "").replace(")", "").strip()) for n in names]
        return [i if i is not None and [*rule.blocks.values()][i] else None for i in found]

    known = lambda xs: [x for x in xs if x is not None]
    excluded = text.split(" and not ")
    if not text or text.startswith(("1 of selection", "1 of them")) or "any of selection" in text:
        every, parts, without = False, [i for i, b in enumerate(rule.blocks.values()) if b], []
    elif text.startswith(("all of selection", "all of them")):
        every, parts, without = True, [i if b else None for i, b in enumerate(rule.blocks.values())] or [None], []
    elif len(excluded) == 2:
        every, parts, without = True, some(excluded[:1]), known(some(excluded[1:]))
    elif " and " in text:
        every, parts, without = True, some(text.split(" and ")), []
    elif " or " in text:
        every, parts, without = False, known(some(text.split(" or "))), []
    elif text.startswith("not "):
        every, parts, without = True, [], known(some([text[4:]]))
    else:
        every, parts, without = True, some([text]), []
    return None if None in parts or not (every or parts) else (every, parts, without)


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _filed(modifier: str, value: str, shared: Counter) -> str:
    if modifier == "exact":
        return "=" + value
    if modifier == "re" or len(value) < GRAM:
        return "*"
    return {"startswith": "^" + value[:GRAM], "endswith": "$" + value[-GRAM:]}.get(modifier) or "~" + min(_grams(value), key=lambda g: (shared[g], g))


@dataclass(frozen=True)
class RuleIndex:
    """needles, the rules that each of them calls up, rules: written tables. A rule is called up by the criterion of a block whose needles the fewest
    rules share, as no block holds without all of its criteria. ``fields``: those that rules name, and whether one of their needles is to be contained;
    ``always``: rules that hold where nothing is found."""

    needles: DataFrame
    uses: DataFrame
    rules: DataFrame
    fields: tuple[tuple[str, bool], ...]
    always: tuple[int, ...]

    def matches(self, events: DataFrame) -> DataFrame:
        """(event_id, sigma_matches): the matches of each event that has one, by rule id, as ``sigma.evaluate`` gives them.

        ``events`` needs the columns of ``normalize``; rows of one event_id are one event. The plan grows with the fields that rules name, not with
        the rules. Hits are shuffled, and not events. Events without an id have no matches; no rules, or no events, give no rows.
        """
        events = events.where("event_id IS NOT NULL")
        none = events.select("event_id", F.lit(None).cast("int").alias("needle_no"))
        hits = none if self.always else none.limit(0)
        if self.fields:
            asked = F.array(*[F.struct(F.lit(n).alias("field"), value_of(n).alias("value"), F.lit(c).alias("grams")) for n, c in self.fields])
            values = events.select("event_id", F.inline(asked)).where("value IS NOT NULL").withColumn("low", F.lower("value"))
            low = F.col("low")
            three = lambda cs: F.transform(cs, lambda c, i: F.concat(F.lit("~"), c, F.get(cs, i + 1), F.get(cs, i + 2)))
            # The characters stand in an array of one, so that a name is bound to them and they aren't split for each.
            grams = F.when(F.col("grams"), F.filter(F.array_distinct(F.flatten(F.transform(F.array(F.split(low, "")), three))), lambda g: g.isNotNull())).otherwise(F.array().cast("array<string>"))
            keys = F.concat(F.array(F.lit("*"), F.concat(F.lit("="), low), F.concat(F.lit("^"), F.left(low, F.lit(GRAM))), F.concat(F.lit("$"), F.right(low, F.lit(GRAM)))), grams)
            near = values.select("event_id", "field", "value", "low", F.explode(keys).alias("key")).join(self.needles, ["field", "key"])
            needle = F.col("needle")
            held = (
                F.when(F.col("modifier") == "exact", low == needle).when(F.col("modifier") == "contains", low.contains(needle)).when(F.col("modifier") == "startswith", low.startswith(needle))
                .when(F.col("modifier") == "endswith", low.endswith(needle)).otherwise(F.regexp_like("value", needle))
            )
            hits = hits.unionByName(near.where(held).select("event_id", "needle_no"))
        # An event's needles meet once, and not once for each rule that shares them; the rules that they call up are tested on them in full.
        found = hits.groupBy("event_id").agg(F.collect_set("needle_no").alias("held"))
        called = found.select("event_id", "held", F.explode("held").alias("needle_no")).join(self.uses, "needle_no").select("event_id", "held", "rule_no")
        if self.always:
            called = called.unionByName(found.select("event_id", "held", F.explode(F.array(*map(F.lit, self.always))).alias("rule_no")))
        called = called.join(self.rules, "rule_no")
        true = lambda b: F.forall(F.get(F.col("needles"), b), lambda c: F.arrays_overlap(c, F.col("held")))
        verdict = F.when(F.col("every"), F.forall("parts", true)).otherwise(F.exists("parts", true)) & ~F.exists("without", true)
        matches = called.where(verdict).groupBy("event_id").agg(F.collect_set(F.struct("found", "rule_no")).alias("all"))
        return matches.select("event_id", F.transform(F.array_sort("all"), lambda x: x["found"]).alias("sigma_matches"))


def build(spark: SparkSession, rules: Sequence[SigmaRule]) -> RuleIndex:
    """The index of all enabled rules; patterns that are none match nothing, as ever."""
    enabled, numbered, kept, always = sorted((r for r in rules if r.enabled), key=lambda r: r.id), {}, [], []
    for n, r in enumerate(enabled):
        verdict = _verdict(r)
        if verdict is None:
            continue
        if not verdict[1]:
            always.append(n)
        blocks: list[list[list[int]]] = []
        for block in r.blocks.values():
            blocks.append([])
            for c in block:
                needles = [(c.field.lower(), c.modifier, f"(?i){v}" if c.modifier == "re" else v.lower()) for v in c.values if c.modifier != "re" or compiles(v)]
                blocks[-1].append(sorted({numbered.setdefault(x, len(numbered)) for x in needles}))
        kept.append((n, (r.id, r.title, r.level, r.technique, r.tactic, f"Matched rule {r.title}"), blocks, *verdict))
    often = Counter(i for rule in kept for i in {x for block in rule[2] for c in block for x in c})
    rarest = lambda criteria: min(criteria, key=lambda c: sum(often[i] for i in c))
    uses = set()
    for n, _, blocks, every, parts, _ in kept:
        chosen = [rarest(blocks[b]) for b in parts]  # all parts have to hold, or any of them
        uses |= {(i, n) for c in ([rarest(chosen)] if every and chosen else chosen) for i in c}
    shared = Counter(g for _, modifier, value in numbered if modifier == "contains" for g in _grams(value))
    needles = [(field, _filed(modifier, value, shared), modifier, value, i) for (field, modifier, value), i in numbered.items()]
    fields = {f: any(n[0] == f and n[1].startswith("~") for n in needles) for f in sorted({n[0] for n in needles})}
    written = lambda rows, schema, tag: materialised(spark.createDataFrame(rows, schema), tag)
    return RuleIndex(written(needles, _NEEDLES, "needles"), written(sorted(uses), _USES, "needle-uses"), written(kept, _RULES, "rules"), tuple(fields.items()), tuple(always))


def with_matches(normalized: DataFrame, index: RuleIndex) -> DataFrame:
    """``normalize``'s rows, written, with the index's matches in the place of those that they had. Lines that were not parsed have none (null), as there."""
    found = materialised(index.matches(normalized), "matches")
    parsed = F.coalesce(F.col("outcome.code") != "UNPARSEABLE_FORMAT", F.lit(False)) & F.coalesce(F.col("outcome.code") != "PARSER_FAILURE", F.lit(False))
    rows = normalized.join(found, "event_id", "left")
    return rows.withColumn("threat", F.col("threat").withField("sigma_matches", F.when(parsed, F.coalesce("sigma_matches", F.array().cast(f"array<{MATCH}>"))))).select(*normalized.columns)
