"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text is a blob named by its SHA-256. The ledger holds, for each blob, the rules (by
version) that have scanned it and the spans that they found. A scan reads the text of one path for
each blob that some rule has not seen, applies just the unseen rules, appends to the ledger, and
joins what the ledger has back to all paths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm._spark import shared_path, written


@dataclass(frozen=True)
class Rule:
    """All matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""  # a string that every match contains, tested before the pattern

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(f'{self.pattern}|{self.group}|{self.least}'.encode()).hexdigest()[:12]}"


#: A private key from its header line to its END line; without one, to the end of the base64 lines that follow the header. All
#: repetitions are possessive, so matching takes linear time and no stack.
PEM_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_GAP = r"""(?:[\s>|#"',]|\\[rnt])*+"""  # line ends, escaped ones too, indents, marks of quotes and comments
PEM = (
    PEM_HEADER + r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"""|(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/=]++(?=[ \t]*+(?:[\r\n"']|\\[rn]|\z)))?+)?+)"""
)

BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", PEM, hint="PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


BLOCK = 64  # elements of an array that are worked on together, so that work doesn't grow with the square of a text's matches


def _named(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not wherever ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, start: int, step) -> Column:
    """For each element, what ``step`` makes of all elements before it. Blocks are put together first, so no array is built up element by element."""
    fold = lambda x, first=F.lit(start): F.aggregate(x, first, step)

    def inside(part: Column, first: Column) -> Column:
        return F.transform(part, lambda _, j: fold(F.slice(part, F.lit(1), j), first))

    def whole(blocks: Column) -> Column:
        return _named(F.transform(blocks, lambda x: fold(x)), lambda sums: F.flatten(F.transform(blocks, lambda x, i: _named(fold(F.slice(sums, F.lit(1), i)), lambda first: inside(x, first)))))

    return _named(_blocks(values), whole)


def _blocks(values: Column) -> Column:
    """An array's elements in arrays of ``BLOCK``; none for an empty array."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda at: F.slice(v, at + 1, F.lit(BLOCK)))
    return _named(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.slice(F.array(v), 2, 1)))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in code points: what the pattern splits off and what it matches alternate,
    so their lengths add up to the positions."""
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    long = lambda x: F.char_length(F.regexp_extract(x, rule.pattern, rule.group) if rule.group else x) >= rule.least
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, x: F.struct(F.char_length(gap).alias("gap"), F.char_length(x).alias("hit"), long(x).alias("long")))

    def placed(steps: Column) -> Column:
        before = _running(F.transform(steps, lambda x: x["gap"] + x["hit"]), 0, lambda a, x: a + x)
        spans = F.zip_with(before, steps, lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["hit"]).alias("end"), F.when(x["long"], F.lit(rule.kind)).alias("kind")))
        return F.filter(spans, lambda x: x["kind"].isNotNull())

    may = text.rlike(rule.pattern)
    if rule.hint:
        may = F.when(text.contains(rule.hint), may).otherwise(False)
    return F.when(may, _named(sizes, placed)).otherwise(F.array().cast(SPANS)).cast(SPANS)


def _once(spans: Column) -> Column:
    """The spans sorted, each once. Equal ones stand side by side once sorted; ``array_distinct`` would compare structs pair by pair."""
    return _named(F.array_sort(spans), lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))


def _ledger(spark: SparkSession, path: str, rules: tuple[Rule, ...], blobs: DataFrame) -> DataFrame:
    """One row for each of ``blobs`` that the ledger knows: the current rules that have seen it, and their spans, sorted."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
    rows = spark.read.parquet(path).join(blobs.select("blob"), "blob", "left_semi")
    gathered = rows.groupBy("blob").agg(
        F.array_intersect(versions, F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    current = F.filter("spans", lambda s: F.array_contains(F.col("rules"), s["rule"]))
    spans = F.transform(current, lambda s: F.struct(s["start"].alias("start"), ranks[s["rule"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return gathered.select("blob", "rules", _once(spans).cast(SPANS).alias("spans"))


def compact(spark: SparkSession, ledger: str, target: str) -> None:
    """Writes the ledger to a new folder with one row for each blob, spans of all rule versions kept; scans may go on from there."""
    rows = spark.read.parquet(ledger)
    once = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), _once(F.flatten(F.collect_list("spans"))).alias("spans"))
    once.write.parquet(target)


def ledger_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _with_rule(spans: Column, version: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(version).alias("rule")))


def scan(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``docs``: path, blob, and spans (start, rank, end, kind; in code points, end
    exclusive), sorted by start, then by the order of ``rules``.

    ``ledger`` is a folder; without one the scan starts from an empty ledger in the shared folder. A scan that
    fails leaves the ledger as it was. Null texts are the empty blob. Null paths are paths; repeated
    rows give repeated results; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_path(spark, "ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = written(held.select("path", "blob"), "paths")
    blobs = written(paths.groupBy("blob").agg(F.min("path").alias("first")), "blobs")
    every = blobs
    none = F.array().cast("array<string>")
    if ledger_exists(spark, ledger):
        seen = _ledger(spark, ledger, rules, every).select("blob", "rules")
        blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.coalesce("rules", none)).where(F.size("rules") < len(rules))
    else:
        blobs = blobs.withColumn("rules", none)
    chosen = blobs.select(F.col("blob").alias("id"), "first", "rules").hint("shuffle_hash")
    unseen = held.join(chosen, (F.col("blob") == F.col("id")) & F.col("path").eqNullSafe(F.col("first")))
    fresh = [F.when(~F.array_contains("rules", r.version), rule_spans(F.col("text"), r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules)]
    named = [_with_rule(s, r.version) for s, r in zip(fresh, rules, strict=True)]
    applied = F.array_except(F.array(*[F.lit(r.version) for r in rules]), F.col("rules"))
    found = unseen.select("blob", applied.alias("rules"), F.concat(*named).alias("spans")).dropDuplicates(["blob"])
    found.write.mode("append").parquet(ledger)
    known = written(_ledger(spark, ledger, rules, every).select(F.col("blob").alias("id"), "spans"), "known")
    return paths.join(known, F.col("blob") == F.col("id"), "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans (sorted by start) replaced by one mark."""
    bounds = F.zip_with(_running(F.transform(spans, lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x)), spans, lambda a, s: F.struct(a.alias("from"), s["start"].alias("to"), s["end"].alias("end")))
    # What stands before each run. Parts of the text that hold the gaps of a block are cut out first, as every cut counts from the beginning of what it cuts.
    cut = lambda x, a, b: F.substring(x, a + 1, b - a)

    def pieces(block: Column) -> Column:
        base, end = block[0]["from"], F.element_at(block, -1)["to"]
        return _named(cut(text, base, end), lambda part: F.transform(block, lambda g: cut(part, g["from"] - base, g["to"] - base)))

    def joined(found: Column) -> Column:
        gaps = F.flatten(F.transform(_blocks(F.filter(found, lambda g: g["to"] >= g["from"])), pieces))
        last = F.array_max(F.transform(found, lambda g: g["end"]))
        return F.array_join(F.concat(gaps, F.array(cut(text, last, F.char_length(text)))), mark)

    return F.when(F.size(spans) == 0, text).otherwise(_named(bounds, joined))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in the texts replaced. Rows are matched by id and text, so equal rows stay as many."""
    found = written(written(scan(docs, id_col, text_col).where(F.size("spans") > 0), "found").dropDuplicates(["path", "blob"]), "redactions")
    same = F.col("__path").eqNullSafe(F.col(id_col)) & (F.col("__blob") == F.sha2(F.col(text_col), 256))
    spans = found.select(F.col("path").alias("__path"), F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    joined = docs.join(spans.hint("shuffle_hash"), same, "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col("__spans")))
    return joined.withColumn(text_col, text).select(*docs.columns)


#: ``PEM`` for an engine without possessive repetition and look-ahead: the same spans, but that a key without an END line ends before a last,
#: shorter line of base64.
_SQL_GAP = r"""(?:[\s>|#"',]|\\[rnt])*"""
_SQL_PEM = (
    PEM_HEADER + r"(?:(?:-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_SQL_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:{_SQL_GAP}[A-Za-z0-9+/=]{{16,}})*)"
)


def _sql_spans(kind: str, pattern: str, test: str, rank: int) -> str:
    quoted = pattern.replace("'", "''")
    start = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"""(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST({start} AS BIGINT), 'rank': {rank}, 'stop': CAST({start} + length(m[i]) AS BIGINT), 'kind': '{kind}', 'ok': {test}}}), lambda x: x.ok)
        FROM (SELECT regexp_extract_all(t, '{quoted}') AS m, regexp_split_to_array(t, '{quoted}') AS p))"""


def oracle_sql() -> str:
    """DuckDB SQL for the registered query."""
    assign = BASE[0].pattern.replace("'", "''")
    tests = {"assign": f"length(regexp_extract(m[i], '{assign}', 2)) >= 6", "access": "length(m[i]) >= 20", "hex": "length(m[i]) >= 24"}
    parts = [_sql_spans(r.kind, _SQL_PEM if r.kind == "pem" else r.pattern, tests.get(r.kind, "true"), i) + f" AS s{i}" for i, r in enumerate(RULES)]
    join = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda x: concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    flat = lambda n: f"flatten([{', '.join(f's{i}' for i in range(n))}])"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      found AS (SELECT doc_id, {", ".join(parts)} FROM texts)
    SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
      sha256({join(flat(3))}) AS base_sha256, {join(flat(len(RULES)))} AS spans FROM found"""
