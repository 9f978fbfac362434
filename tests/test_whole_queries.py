"""Queries that go over all lines and keys, against brute force on the smallest tables."""

import re
from collections import Counter, defaultdict

from logloom.operators import infer
from logloom.plans import inventory_queries, more_queries  # noqa: F401  register more
from logloom.plans.queries import QUERIES, normalized
from logloom.plans.raw_logs import raw_logs


def variable(t):
    word = re.sub(r"""[\[\](),"';]""", "", t.upper())
    return bool(
        re.search(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}", t)
        or re.fullmatch(r"\d+", t)
        or (re.fullmatch(r"[0-9a-fA-F-]{8,}", t) and re.search(r"\d", t))
        or word in infer.ACTION_WORDS
    )


def test_all_lines_and_keys(spark, sf_dir):
    lines = [r.raw_message.split() for r in raw_logs(spark, sf_dir).select("raw_message").collect()]
    pair = re.compile(r"[a-zA-Z_][a-zA-Z0-9_.-]*=.")
    want = Counter(" ".join(t.split("=")[0] + "=<*>" if pair.match(t) else "<*>" if variable(t) else t for t in x) for x in lines)
    assert {r.template: r.n for r in QUERIES["inf1_all_first_templates"](spark, sf_dir).collect()} == want
    places = Counter()
    for r in QUERIES["inf6_all_token_types"](spark, sf_dir).collect():
        places[r.position] += r.n
    assert places == Counter(i for x in lines for i in range(len(x)))
    rows, values = Counter(), defaultdict(set)
    for r in normalized(spark, sf_dir).select("parser_name", "extensions").collect():
        for k, v in (r.extensions or {}).items():
            rows[r.parser_name, k] += 1
            values[r.parser_name, k] |= {v} - {None}
    got = {(r.parser_name, r.key): (r.n, r.n_values) for r in QUERIES["fn_all_extensions"](spark, sf_dir).collect()}
    assert got == {k: (n, len(values[k])) for k, n in rows.items()} and len({k for _, k in got}) > 12
