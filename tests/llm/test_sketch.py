"""Percentile sketches: bounds, merging, odd values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framewright.llm import quantile_sketch as qs

SCHEMA = "g string, p string, x double, bucket int, n int"


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_bound(spark, error):
    r = random.Random(1)
    odd = [0.0, -0.0, 1e-308, -1e-308, 5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, -1.0]
    rows = [("g%d" % r.randrange(3), "p%d" % r.randrange(4), r.choice([r.lognormvariate(0, 8), -r.random(), r.choice(odd), 7.0]), 0, 0) for _ in range(900)]
    df = spark.createDataFrame(rows + [("g0", "p0", None, 0, 0), ("g0", "p0", float("nan"), 0, 0), (None, "p1", 3.0, 0, 0), ("only", None, float("nan"), 0, 0)], SCHEMA)
    marks = [0, 0.01, 0.25, 0.5, 0.77, 0.99, 1]
    got = qs.by_scope(df, ["g"], "p", ["x"], marks, error).collect()
    for row in got:
        xs = sorted(x for g, p, x, *_ in [*rows, (None, "p1", 3.0)] if g == row["g"] and row["scope"] in (p, "all"))
        want = xs[math.floor(row["quantile"] * (len(xs) - 1))]
        assert row["n"] == len(xs)
        if math.isinf(want) or want == 0:
            assert row["estimate"] == want
        elif abs(want) > 1e-300:
            assert abs(row["estimate"] - want) <= abs(want) * (error + 1e-9)
    assert len(got) == len(marks) * sum(1 + len({p for g, p, *_ in rows if g == k}) for k in ("g0", "g1", "g2")) + 2 * len(marks)


def test_merge_is_exact(spark):
    df = spark.createDataFrame([("g", str(i % 5), float(i), 0, 0) for i in range(1, 400)], SCHEMA)
    whole = qs.sketch(df, ["g"], ["x"])
    parts = qs.merge(qs.sketch(df, ["g", "p"], ["x"]), ["g"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_buckets_ascend(spark):
    values = sorted([-1e300, -5.0, -5e-324, 0.0, 5e-324, 1e-300, 0.5, 0.9, 1.0, 1.03, 2.0, 1e300, float("inf"), float("-inf")])
    df = spark.createDataFrame([(v,) for v in values], "x double")
    numbers = [r[0] for r in df.select(qs.bucket(F.col("x"))).collect()]
    assert numbers == sorted(numbers) and len(set(numbers)) == len(numbers)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert qs.by_scope(df, ["g"], "p", ["x"], [0.5]).count() == 0
