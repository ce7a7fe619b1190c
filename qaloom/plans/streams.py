"""Structured Streaming queries, run over what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.lineage import scratch
from qaloom.streaming import responses as st


def _utc(spark: SparkSession, schema: str) -> str:
    return schema.replace(" timestamp", " timestamp_ntz")


def stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Responses and latency per day of completion."""
    schema, folder = _utc(spark, st.RESPONSES), scratch(spark, "stream-latency")
    rows = st.table_stream(spark, f"{sf}/responses.parquet", schema, ends=f"{folder}/ends").withColumn("completed_at_utc", F.col("completed_at_utc").cast("timestamp"))
    out, _ = st.run_to_end(st.latency_windows(rows), folder, (f"{folder}/ends", schema, "completed_at_utc"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "n_timed", F.round("latency_s", 3).alias("latency_s"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users in the events table."""
    schema, folder = _utc(spark, st.EVENTS), scratch(spark, "stream-sessions")
    rows = st.table_stream(spark, f"{sf}/events.parquet", schema, ends=f"{folder}/ends").withColumn("ts", F.col("ts").cast("timestamp"))
    out, _ = st.run_to_end(st.user_sessions(rows), folder, (f"{folder}/ends", schema, "ts"))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n_events")


QUERIES = {"stream_latency": stream_latency, "stream_sessions": stream_sessions}
ORACLES = {
    "stream_latency": "select strftime(completed_at_utc, '%Y-%m-%d') as day, count(*) as n, count(latency) as n_timed, round(sum(latency), 3) as latency_s from (select distinct response_id, qid, answer, latency, completed_at_utc from responses where completed_at_utc is not null) group by 1",
    "stream_sessions": """with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as was from events where ts is not null and user_id is not null),
 g as (select *, sum(case when was is null or ts >= was + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from e)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as session_end, count(*) as n_events from g group by user_id, n""",
}
