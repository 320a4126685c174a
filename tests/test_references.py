from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import skew
from weftgraph.operators.references import orphans


def day(m, d=1):
    return datetime(2020, m, d)


TARGETS = [(1, 1, day(1), None), (2, 1, day(2), day(4)), (2, 1, day(6), None), (3, 1, day(5), day(5)), (4, None, day(1), None), (5, 5, None, None), (2, 1, day(2), day(4))]
REFS = [("a", 1, 1, day(3)), ("b", 2, 1, day(1)), ("c", 2, 1, day(2)), ("d", 2, 1, day(4)), ("e", 2, 1, day(7)), ("f", 9, 1, day(3)), ("g", None, 1, day(3)), ("h", None, None, day(3)), ("i", 3, 1, day(5)), ("j", 1, 1, None), ("k", 4, None, day(2)), ("l", None, 9, day(3)), ("f", 9, 1, day(3)), ("m", 3, 1, day(4)), ("n", 2, 1, day(3, 15))]
SIMPLE = {("b", "early"), ("d", "deleted"), ("f", "missing"), ("i", "deleted"), ("j", "deleted"), ("m", "early")}


@pytest.mark.parametrize("match,extra", [("simple", set()), ("partial", {("l", "missing")}), ("full", {("g", "missing"), ("k", "missing"), ("l", "missing")})])
@pytest.mark.parametrize("hot", [1000, 0])
def test_orphans(spark, match, extra, hot):
    t = spark.createDataFrame(TARGETS, "x long, y long, s timestamp_ntz, e timestamp_ntz")
    r = spark.createDataFrame(REFS, "id string, a long, b long, t timestamp_ntz")
    got = [(x.row_key, x.cause) for x in orphans(r, t, [("a", "x"), ("b", "y")], F.col("id"), "t", "s", "e", match, hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == SIMPLE | extra
    assert {x.cause for x in orphans(r, t.limit(0), [("a", "x"), ("b", "y")], F.col("id"), "t", "s", "e").collect()} == {"missing"}
    assert orphans(r.limit(0), t, [("a", "x"), ("b", "y")], F.col("id"), "t", "s", "e").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in (1, 3, 6, None)], "k long, w string")
    want = sorted(map(str, left.join(right, "k", how).select("k", "v", *["w"] * (how in ("inner", "left"))).collect()))
    got = skew.salted_join(left, right, ["k"], how, hot_rows=10, salts=4)
    assert sorted(map(str, got.select("k", "v", *["w"] * (how in ("inner", "left"))).collect())) == want
