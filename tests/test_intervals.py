"""Sweep against brute force over millisecond sets."""

import random

from pyspark.sql import functions as F

from qaloom.operators.intervals import request_windows, sweep

SCHEMA = "k string, a long, b long, kind string, chunk int"  # two extra columns that clash with inner names


def brute(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((a, b) for key, a, b in rows if key == k and a is not None and b is not None and b >= a)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged} | {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, chunk):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {tuple(r) for r in sweep(df, "k", "a", "b", chunk).collect()}


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in "abcd":
        for _ in range(60):
            a = rng.randrange(0, 500)
            rows.append((k, a, a + rng.randrange(0, 12)))
    rows += rows[:20] + [("a", 100, 100), ("e", 7, 7), ("f", -40, -10), ("f", -10, 3)]
    for chunk in (1, 7, 100, 10_000):
        assert run(spark, rows, chunk) == brute(rows)


def test_nulls_reversed_and_empty(spark):
    assert run(spark, [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 5, 2)], 10) == set()
    assert spark.createDataFrame([], SCHEMA).transform(lambda d: sweep(d, "k", "a", "b")).count() == 0


def test_touching_and_nested(spark):
    assert run(spark, [("a", 0, 10), ("a", 10, 20), ("a", 2, 5), ("a", 30, 31)], 4) == {("a", "period", 0, 20), ("a", "gap", 20, 30), ("a", "period", 30, 31)}


def test_windows_that_count(spark):
    rows = [("  A  b\t", 1.0, 2.0, 1), ("a b", 1.0, 2.0, 2), (None, 1.0, 2.0, 3), ("c", float("nan"), 2.0, 4), ("c", 2.0, 2.0, 5), ("c", 3.0, 2.0, 6), ("c", 1.0, float("inf"), 7), ("  ", 1.0, 2.0, 8)]
    df = spark.createDataFrame(rows, "videoid string, start_time double, end_time double, vkey int")
    assert [tuple(r) for r in request_windows(df).collect()] == [("a b", 1000, 2000)] * 2


def test_one_hot_entity(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 1).alias("b"))
    kinds = {r["kind"]: r["count"] for r in sweep(df, "k", "a", "b", 5_000).groupBy("kind").count().collect()}
    assert kinds == {"period": 20_000, "gap": 19_999}
