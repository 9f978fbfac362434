"""The types of tokens, against the rules written again, on odd tokens; and how often a token goes through them."""

import re

from pyspark.sql import functions as F

from logloom.operators import infer
from logloom.plans import more_queries  # noqa: F401  register more
from logloom.plans.queries import QUERIES
from logloom.plans.raw_logs import raw_logs

ODD = [
    "a", "", "   ", "=x", "src=", "src=1.2.3.4 DST=5.6.7.8 dst 9.9.9.9", "Spt=22, (dpt=23) [proto=tcp]; act=DENY user=u=v k==v a=\u2028b", "1.2.3.4/80 inside:1.2.3.4:8080 dst x:1.2.3.4/5 1.2.3.4/123456",
    "dstport 443 65535 65536 0 00080 99999999999 -5 +5", "xdst 1.1.1.1 TCP udp, 'HTTP' Deny permitted RESET error (Info) HIGH", "2024-01-05T10:32:21Z 2024-01-05T10:32:21.5+0100 2024-01-05 10:32:21 2024-01-05T10:32:21x",
    "%ASA-4-106023: %ASA-4-106023 ABC-1-2 abc-1-2 \u0661\u0662 \u00e9t\u00e9 [] () ;", "a b c d e f 1.1.1.1 7 1.1.1.1:7 src=1.1.1.1", "dst 1.1.1.1:7 Dst=1 2.2.2.2", "a\tb\x0bc\x0cd\re\u00a0f\x1c g",
]


def by_rules(line):
    toks = re.split(r"[ \t\n\x0b\f\r]+", line.strip("".join(map(chr, range(0x21)))))
    for i, t in enumerate(toks):
        clean, before = re.sub(r"""[\[\](),"';]""", "", t).strip(" "), toks[i - 1].lower() if i else ""
        side = lambda far, what: ("destination." if far else "source.") + what  # noqa: B023, E731
        near, up, key = i > 5 or "dst" in before, clean.upper(), clean.partition("=")[0].lower()
        whole = lambda p: re.search(rf"\A(?:{p})\Z", clean, re.ASCII)  # noqa: B023, E731
        if re.search("\\A[^=]*=[^\n\r\x85\u2028\u2029]", clean):
            yield i, *next((v for k, v in infer.KEYS.items() if key in k), ("KEY_VALUE", f"extensions.{key}", 0.85))
        elif whole(r"(?:[a-zA-Z0-9_-]+:)?\d{1,3}(?:\.\d{1,3}){3}[/:]\d{1,5}"):
            yield i, "IP_PORT_PAIR", side(i > 5 or before == "dst", "ip"), 0.98
        elif whole(r"\d{1,3}(?:\.\d{1,3}){3}"):
            yield i, "IPV4", side(near, "ip"), 0.99
        elif up in infer.PROTOCOLS:
            yield i, "PROTOCOL", "network.protocol", 0.98
        elif up in infer.ACTIONS:
            yield i, "ACTION", "event.action", 0.96
        elif up in infer.SEVERITIES:
            yield i, "SEVERITY", "event.severity", 0.92
        elif whole(r"\d+") and 1 <= int(clean) <= 65535:
            yield i, "PORT", side(near, "port"), 0.92
        elif whole(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"):
            yield i, "TIMESTAMP", "timestampUtc", 0.95
        elif whole(r"%?[A-Z0-9]+-\d+-\d+"):
            yield i, "VENDOR_CODE", "extensions.vendorCode", 0.95
        else:
            yield i, "STRING", f"extensions.token_{i}", 0.60


def test_rules(spark, sf_dir):
    lines = spark.createDataFrame([(x,) for x in [*ODD, None]], "raw_message string")
    want = sorted(x for line in ODD for x in by_rules(line))
    rows = infer.token_types(lines)
    assert sorted((r.position, r.type, r.path, r.confidence) for r in rows.collect()) == want
    nested = lines.select(F.inline(infer.typed(infer.tokens(F.col("raw_message"))))).select(*rows.columns)
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, rows.collect()))
    counted = {}
    for r in raw_logs(spark, sf_dir).select("raw_message").collect():
        for x in by_rules(r.raw_message):
            counted[x] = counted.get(x, 0) + 1
    assert {(r.position, r.type, r.path, r.confidence): r.n for r in QUERIES["inf6_all_token_types"](spark, sf_dir).collect()} == counted


def test_rules_run_once_a_token(spark, sf_dir):
    """The query has each pattern once in its plan, in compiled code. As a lambda it stood there once for each field of the result, with the cleaning of the token
    again in every test."""
    plan = QUERIES["inf6_all_token_types"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("%?[A-Z0-9]+") == 1 and plan.count(r"(?:\d{1,3}\.){3}") == 1
    assert plan.count("regexp_replace") <= 20  # 200 before
