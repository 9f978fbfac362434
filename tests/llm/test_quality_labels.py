"""The quality rules use every label: more than fit a bounded sample, and thresholds over tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import quality


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_all_labels_are_counted(spark, monkeypatch, broadcast):
    """41,000 trusted documents: half of them all are counted, by a shuffle as by a broadcast."""
    monkeypatch.setattr(quality, "BROADCAST", broadcast, raising=False)
    n = 41_000
    docs = spark.range(n + 50).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 1000).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "w1 w2"), (7, "w7")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    counted = set(order[::2])
    rows = quality.assess(docs, labels).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]

    def buckets(text):
        h = [zlib.crc32(w.encode()) for w in text.split()]
        return [x % quality.BUCKETS for x in h + [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64) >> 40 for a, b in zip(h, h[1:])]]

    raw = Counter(b for _, t in texts for b in buckets(t))
    target = Counter(b for i, t in texts if i in counted for b in buckets(t))
    assert sum(target.values()) in (len(counted), len(counted) + 1)
    k, all_, own = quality.BUCKETS, sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] + k * (c + 1) / (all_ + k)) / (own + k)) - math.log((c + 1) / (all_ + k)) for b, c in raw.items()}
    want = {f"w{i}": ratio[buckets(f"w{i}")[0]] for i in range(1000)}
    assert len(rows) == n + 52
    assert all(abs(r.score - want[f"w{r.doc_id % 1000}"]) < 1e-9 for r in rows if r.doc_id is not None)


def test_cut_of_a_table_is_the_threshold_of_its_arrays(spark):
    rng = np.random.default_rng(3)
    for n, m, values in ((400, 300, 40), (5, 900, 1000), (300, 7, 3), (1, 1, 2), (200, 200, 1)):
        good, bad = rng.integers(0, values, n) / 8 + 0.5, rng.integers(0, values, m) / 8
        rows = [(True, float(x)) for x in good] + [(False, float(x)) for x in bad]
        assert quality.cut(spark.createDataFrame(rows, "good boolean, score double").repartition(5)) == quality.threshold(good, bad)
    for one in (True, False):
        assert quality.cut(spark.createDataFrame([(one, 1.0)], "good boolean, score double")) == -np.inf
