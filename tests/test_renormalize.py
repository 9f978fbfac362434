"""Lines under parsers that were approved later: the same rows as when all lines are parsed again, but only those lines are parsed that the parsers take."""

from pyspark.sql import functions as F

from logloom.operators import infer
from logloom.operators.parsers.dynamic import DynamicParser, FieldMapping, dynamic
from logloom.plans.normalize import normalize, quarantine, renormalize
from logloom.plans.queries import QUERIES, normalized
from logloom.plans.raw_logs import raw_logs
from logloom.sources.tables import materialised


def as_json(rows):
    return sorted(rows.select(F.to_json(F.struct(*sorted(rows.columns)))).toPandas().iloc[:, 0])


def test_same_rows(spark, sf_dir):
    odd = spark.createDataFrame([(None,), ("",), ("  job 7 done ",), ("JOB 8 DONE",), ("CEF:0|a|b|c|d|e|5|src=1.1.1.1 act=deny",)], "raw_message string")
    odd = odd.selectExpr("raw_message", "'X' AS source", "TIMESTAMP '2024-01-01 00:00:00' AS received_at", "-1 - monotonically_increasing_id() AS ingest_seq")
    lines = raw_logs(spark, sf_dir).unionByName(odd)
    job = dynamic(DynamicParser("job", r"^job\s+(?<token1>\S+)\s+done$", (FieldMapping("token1", "extensions.n", "STRING", 0.9),)))
    cef = dynamic(DynamicParser("a_cef", r"^CEF:0\|(?<token0>\S+)$", (FieldMapping("token0", "extensions.all", "STRING", 0.9),)))  # takes lines that a native parser took
    garbage = dynamic(DynamicParser("garbage", r"^(?<token0>GARBAGE-[0-9]*[02468])\s+session.*$", (FieldMapping("token0", "extensions.id", "STRING", 0.9),)))
    first = materialised(normalize(lines), "first")
    both = renormalize(first, [job, cef, garbage])
    assert as_json(both) == as_json(normalize(lines, dynamic=[job, cef, garbage]))
    assert as_json(renormalize(materialised(both, "both"), [])) == as_json(first)  # lines of parsers that are gone


def test_first_lines_give_the_same_parsers(spark, sf_dir):
    lines = raw_logs(spark, sf_dir).where("ingest_seq % 8 IN (0, 6, 7)")
    every, first = infer.Registry(), infer.Registry()
    infer.approve_all(infer.infer(infer.mine(lines)), every, 2_000)
    infer.approve_all(infer.infer(infer.mine_first(lines)), first, 2_000)
    assert [every.versions(n) for n in sorted(every._versions)] == [first.versions(n) for n in sorted(first._versions)] and len(first._versions) > 13


def test_the_query_parses_what_is_taken(spark, sf_dir, monkeypatch):
    """The query parses the unknown lines again, an eighth of all. It parsed all lines again before."""
    from logloom.plans import queries as q
    from logloom.plans import normalize as n

    parsed, plain = [], n.normalize

    def counted(raw, *args, **kwargs):
        parsed.append(raw.count())
        return plain(raw, *args, **kwargs)

    unknown = quarantine(normalized(spark, sf_dir)).where("failure_code = 'UNPARSEABLE_FORMAT'").count()
    monkeypatch.setattr(n, "normalize", counted)
    monkeypatch.setattr(q, "normalize", counted)
    QUERIES["prs13_dynamic_parser"](spark, sf_dir)
    assert parsed == [unknown] and 0 < unknown < normalized(spark, sf_dir).count() / 7
