"""Queries on time intervals (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.intervals import request_windows, sweep


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    windows = request_windows(spark.read.parquet(f"{sf}/request.parquet"))
    # a period or gap comes from its own last or first boundary, so rows are distinct as they are
    return sweep(windows, "vkey", "start_ms", "end_ms").select(F.col("key").alias("vkey"), "kind", "start_ms", "end_ms")


def p6_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per video: number of periods and gaps, covered and uncovered milliseconds."""
    rows = p6_found(spark, sf).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("ms"))
    return rows.groupBy("vkey").agg(F.count(of("period")).alias("n_periods"), F.count(of("gap")).alias("n_gaps"), F.coalesce(F.sum(of("period")), F.lit(0)).alias("covered_ms"), F.coalesce(F.sum(of("gap")), F.lit(0)).alias("gap_ms"))


QUERIES = {"p6_found": p6_found, "p6_coverage": p6_coverage}

_FOUND = r"""
with w as (
  select distinct nullif(regexp_replace(lower(regexp_replace(videoid, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '') as vkey,
    cast(round(start_time * 1000) as bigint) as s, cast(round(end_time * 1000) as bigint) as e
  from request where isfinite(start_time) and isfinite(end_time) and end_time > start_time
), m as (
  select *, max(e) over (partition by vkey order by s, e rows between unbounded preceding and 1 preceding) as reach from w where vkey is not null
), g as (
  select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by vkey order by s, e rows unbounded preceding) as n from m
), p as (select vkey, n, min(s) as s, max(e) as e from g group by vkey, n),
 q as (select *, lag(e) over (partition by vkey order by n) as was from p),
 found as (
  select vkey, 'period' as kind, s as start_ms, e as end_ms from q
  union all select vkey, 'gap', was, s from q where was is not null)
"""
ORACLES = {
    "p6_found": _FOUND + "select * from found",
    "p6_coverage": _FOUND
    + """select vkey, count(*) filter (where kind = 'period') as n_periods, count(*) filter (where kind = 'gap') as n_gaps,
  cast(coalesce(sum(end_ms - start_ms) filter (where kind = 'period'), 0) as bigint) as covered_ms,
  cast(coalesce(sum(end_ms - start_ms) filter (where kind = 'gap'), 0) as bigint) as gap_ms from found group by vkey""",
}
