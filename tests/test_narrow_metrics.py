"""What the running metrics send through their stream, and what a task makes of it."""

import heapq
import random

import pyarrow as pa

from logloom.plans import inventory_queries, live_queries  # noqa: F401  register more
from logloom.streaming import live


def test_metrics_rows_are_narrow(spark, sf_dir, monkeypatch):
    """No details of matches and no reasons go through the join and the stream; they did before."""
    sent = []
    monkeypatch.setattr(live_queries, "_streamed", lambda rows, make, tag: sent.append(rows) or spark.createDataFrame([], f"{live.METRICS}, batch int"))
    live_queries.str2_running_metrics(spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in sent[0].schema}
    assert types["threat"] == "struct<sigma_matches:array<string>>" and types["outcome"] == "struct<code:string>"


def test_task_counts():
    rng = random.Random(3)
    rows = [(rng.randrange(300), i, rng.choice([None, rng.random()]), rng.choice([None, -1, 0, 1, 3])) for i in range(5_000)]
    names = pa.array(["x"] * 500)
    batches = [
        pa.RecordBatch.from_arrays([names, names, names, *(pa.array(c, t) for c, t in zip(zip(*rows[k : k + 500]), (pa.int64(), pa.int64(), pa.float64(), pa.int32())))], ["format", "tier", "outcome", "at", "seq", "latency", "alerts"])
        for k in range(0, 5_000, 500)
    ]
    out = {(r["kind"], r["name"]): r for b in live._task_counts(iter(batches)) for r in b.to_pylist()}
    want = heapq.nlargest(live.RING, [(a, s, v) for a, s, v, _ in rows if v is not None])
    assert [(x["at"], x["seq"], x["value"]) for x in out["latency", "latest"]["latest"]] == want
    assert out["outcome", "alerts"]["n"] == sum(x for *_, x in rows if x and x > 0) and out["format", "x"]["n"] == 5_000
