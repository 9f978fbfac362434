"""Normalization spends its time on the lines: sets of values that hold are compiled, and ends are looked at before they are trimmed."""

import re

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from logloom.functions.text import has_text, strip
from logloom.operators import sigma
from logloom.operators.parsers.base import confidences
from logloom.plans.normalize import validation_errors

ODD = ["", " ", "a", " a", "a ", "\ta\x00", "\x00", "a\x01b", "é ", " é", " a ", "!", "\x1f!\x20", "中", "中\n", "a" * 500 + " ", None, "\x0b", "\x7f "]


def test_ends_of_odd_texts(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x string").select("x", strip(F.col("x")).alias("s"), has_text(F.col("x")).alias("t")).collect()
    cut = "".join(map(chr, range(0x21)))
    assert [(r.s, r.t) for r in rows] == [(None, None) if r.x is None else (r.x.strip(cut), bool(re.search(r"[^ \t\n\x0b\f\r]", r.x))) for r in rows]


@pytest.mark.parametrize("what", ["rules", "errors", "confidence"])
def test_no_interpreted_filters(spark, what):
    """A filter of an array runs what the array is made of uncompiled."""
    made = {"rules": lambda: sigma.evaluate(), "errors": validation_errors, "confidence": lambda: confidences(("a", 1, None), ("b", 2, F.col("x").isNotNull()))}[what]()
    assert "filter(" not in str(made).lower()


def test_confidence_of_fields_that_hold(spark):
    rows = spark.createDataFrame([("1",), (None,)], "x string").select(confidences(("a", 1, None), ("b", 2, F.col("x") == "1"), ("c", 3, F.col("x").isNull())).alias("m")).collect()
    assert [r.m for r in rows] == [{"a": 1, "b": 2}, {"a": 1, "c": 3}]


def test_queries_have_generated_methods_compiled(spark, sf_dir):
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(name)
    try:
        __spark_entry__.queries()["cls1_classify"](spark, sf_dir)
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, "65535")
        __spark_entry__.queries()["cls1_classify"](spark, sf_dir)
        assert spark.conf.get(name) == "65535"
    finally:
        spark.conf.unset(name)
