"""The index of approved parsers gives what the chain of the same parsers gives, in a plan of one size."""

import random

from pyspark.sql import functions as F

from logloom.operators import infer, parser_index
from logloom.operators.parsers.dynamic import DynamicParser, FieldMapping, dynamic
from logloom.plans.normalize import normalize
from logloom.sources.tables import put
from logloom.streaming import gateway

PATHS = ["source.ip", "destination.ip", "source.port", "destination.port", "network.protocol", "event.action", "source.user", "timestampUtc", "extensions.a", "extensions.b"]
VALUES = ["10.0.0.1", "in:10.0.0.2/80", "fe80::1", "(eve)", "deny", "Accepted", "tcp", "443", "99999", "user=bob", "'x'", "http://h/p", "2026-01-01T00:00:00Z", "[]", "a:b"]


def frame(spark, text):
    return spark.createDataFrame([(t, "T", i) for i, t in enumerate(text)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit("2026-01-05 00:00:00").cast("timestamp"))


def some_parsers(spark, rng, n):
    """Parsers of random templates, with mappings for all their tokens and some that name none."""
    made = set()
    while len(made) < n:
        made.add(" ".join(rng.choice(["alpha", "Beta", "GAMMA", "x.y", "<*>", "<*>", "key=<*>", "Id=<*>", "=<*>", r"q\E1"]) for _ in range(rng.randint(1, 6))))
    patterns = {r.t: r.p for r in spark.createDataFrame([(t,) for t in made], "t string").select("t", infer.pattern(F.split("t", " ")).alias("p")).collect()}
    found = []
    for k, t in enumerate(sorted(made, key=lambda x: (rng.random(), x))):
        slots = [FieldMapping(rng.choice([f"token{i}", f"token_{i}"]), rng.choice(PATHS), "STRING", rng.choice([None, 0.855, 0.9, 0.97]), "s") for i in range(len(t.split()) + 1)]
        found.append(DynamicParser(f"p{k:03}", patterns[t], tuple(slots), rng.choice([0.0, 0.8]), "1.0", "CUSTOM", template=t))
    return found


def table_of(spark, parsers):
    rows = [(p.name, p.pattern, p.confidence, p.version, p.format_type, p.template, p.active, [(m.slot, m.path, m.inferred_type, m.confidence, m.sample) for m in p.mappings]) for p in parsers]
    return spark.createDataFrame(rows, parser_index.PARSERS)


def lines_for(rng, parsers, n):
    change = [str.upper, str.lower, str, str, str]
    lines = [None, "", "  ", "alpha", "\talpha \x1f"]
    for _ in range(n):
        toks = [rng.choice(change)(t).replace("<*>", rng.choice(VALUES)) for t in rng.choice(parsers).template.split()]
        if rng.random() < 0.2:
            toks[rng.randrange(len(toks))] = rng.choice(["other", "key=", "key", "=", *VALUES])
        lines.append(rng.choice([" ", "  ", "\t"]).join(toks))
    return lines


def test_same_rows_as_the_chain(spark):
    rng = random.Random(7)
    parsers = some_parsers(spark, rng, 40)
    lines = frame(spark, lines_for(rng, parsers, 600))
    by_hand = DynamicParser("p019x", r"alpha (?<token1>\S+).*", (FieldMapping("token1", "source.user"),), template=None)
    want = normalize(lines, dynamic=[dynamic(p) for p in [*parsers, by_hand]])
    index = parser_index.build(table_of(spark, [*parsers, by_hand]))
    assert [r.name for r in parser_index.unfiled(table_of(spark, [*parsers, by_hand])).collect()] == ["p019x"]
    got = normalize(lines, dynamic=[dynamic(by_hand)], index=index)
    assert got.columns == want.columns
    want, got = ({r.ingest_seq: r.asDict(True) for r in x.collect()} for x in (want, got))
    assert got == want
    assert len({r["parser_name"] for r in got.values()}) > 25 and sum(r["parser_name"] == "p019x" for r in got.values()) > 0


def test_versions_and_empty_tables(spark):
    rng = random.Random(8)
    one = some_parsers(spark, rng, 1)[0]
    at = lambda version, active: DynamicParser(one.name, one.pattern, one.mappings, one.confidence, version, template=one.template, active=active)
    lines = frame(spark, [one.template.replace("<*>", "v"), "none of these"])
    names = lambda parsers: [r.parser_version for r in normalize(lines, index=parser_index.build(table_of(spark, parsers))).orderBy("ingest_seq").collect()][0]
    assert names([at("1.0", True), at("1.1", True)]) == "1.1"
    assert names([at("1.0", True), at("1.1", False)]) is None and names([]) is None


def test_ten_thousand_parsers(spark):
    """Templates of one length that differ in any of their tokens; the plan doesn't grow with them."""
    word = lambda k: F.concat(F.lit("w"), F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256), 1, 9), F.lit("z"))
    varied = [F.when(F.col("id") % 6 == k, F.lit(infer.VARIABLE)).when(F.col("id") % 5 == k, F.lit("same")).otherwise(word(k)) for k in range(8)]

    def made(n):
        template = spark.range(n).select("id", F.concat_ws(" ", *varied).alias("template"))
        slot = F.struct(F.concat(F.lit("token"), (F.col("id") % 6).cast("string")).alias("slot"), F.lit("source.user").alias("path"), F.lit("STRING").alias("inferred_type"), F.lit(0.9).alias("confidence"), F.lit("s").alias("sample"))
        rows = template.select(F.format_string("p%07d", "id").alias("name"), infer.pattern(F.split("template", " ")).alias("pattern"), F.lit(0.9).alias("confidence"), F.lit("1").alias("version"), F.lit("CUSTOM").alias("format_type"), "template", F.lit(True).alias("active"), F.array(slot).alias("mappings"))
        return parser_index.build(rows), template

    plans = []
    for n in (10, 10_000):
        index, template = made(n)
        lines = template.select(F.replace("template", F.lit("<*>"), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("raw_message"), F.lit("T").alias("source"), F.lit("2026-01-05").cast("timestamp").alias("received_at"), F.col("id").alias("ingest_seq"))
        rows = normalize(lines, index=index)
        plans.append(len(rows._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        right = rows.where((F.col("parser_name") == F.format_string("p%07d", "ingest_seq")) & (F.col("source.user") == F.concat(F.lit("u"), F.col("ingest_seq").cast("string"))))
        assert right.count() == n
    assert plans[0] == plans[1]


def test_approved_without_a_bound(spark):
    """A parser for each of 300 templates; a name that is taken gets a number."""
    lines = frame(spark, [f"{'abcdefghij'[i % 10] * (i // 10 + 1)} job took 10 ms" for i in range(300)])
    mined = infer.infer(infer.mine(lines))
    parsers = parser_index.approved(mined.withColumn("suggested_name", F.when(F.col("id") < 2, "same").otherwise(F.concat(F.lit("n"), "id"))))
    names = [r.name for r in parsers.collect()]
    assert len(names) == len(set(names)) == mined.select("template").distinct().count() == 300 and {"same", "same_2"} < set(names)
    rows = normalize(lines, index=parser_index.build(parsers))
    assert rows.select("parser_name").distinct().count() == 300 and rows.where("parser_name IS NULL").count() == 0


def test_stream_asks_for_the_index(spark, tmp_path):
    """Parsers that are approved while the stream stands take part from its next batch on."""
    table, folder = str(tmp_path / "parsers"), str(tmp_path / "in")
    parsers = some_parsers(spark, random.Random(9), 2)
    frame(spark, [p.template.replace("<*>", "v") for p in parsers]).write.parquet(folder)
    seen = []
    for known in (parsers[:1], parsers):
        put(table_of(spark, known), table)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        gateway.run(stream, str(tmp_path / "out"), str(tmp_path / "at"), available_now=True, index=lambda: parser_index.build(spark.read.parquet(table))).awaitTermination()
        seen.append(sorted(r.parser_name for r in spark.read.parquet(str(tmp_path / "out/normalized")).where("parser_name LIKE 'p0%'").collect()))
        frame(spark, [p.template.replace("<*>", "w") for p in parsers]).write.mode("append").parquet(folder)
    assert seen == [["p000"], ["p000", "p000", "p001"]]
