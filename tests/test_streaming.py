import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq

from qaloom.plans import streams
from qaloom.streaming import responses as st


def at(s):
    return dt.datetime(2025, 1, 1, 0, 0) + dt.timedelta(seconds=s)


def feed(spark, tmp_path, batches, schema, ends=False):
    """One file per batch, read in order; with an end, flushing rows follow."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"t{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    if ends:
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "ends"))
        stream = stream.unionByName(spark.readStream.schema(schema).parquet(str(tmp_path / "ends")))
    return stream


def test_latency_windows_ignore_repeats(spark, tmp_path):
    a = (1, "a", "x", 2.0, at(0))
    stream = feed(spark, tmp_path, [[a, a], [a, (2, "b", "y", None, at(90_000))]], st.RESPONSES, ends=True)
    out, dropped = st.run_to_end(st.latency_windows(stream), str(tmp_path / "run"), (str(tmp_path / "ends"), st.RESPONSES, "completed_at_utc"))
    assert sorted((r["window_start"].day, r["n"], r["n_timed"], r["latency_s"]) for r in out.collect()) == [(1, 1, 1, 2.0), (2, 1, 0, None)] and dropped == 0


def test_late_rows_of_unordered_files_go_to_the_side(spark, tmp_path):
    """Windows close and go as the watermark passes; what comes after is counted, and the side output has just those rows."""
    day = 86_400
    row = lambda i, s: (i, f"q{i}", "x", 1.0, at(s))
    batches = [[row(0, 0)], [row(1, 20 * day)], [row(2, 40 * day), row(3, 21 * day)], [row(4, 5 * day), row(5, 39 * day)], [row(6, 1 * day), row(7, 60 * day)]]
    stream = feed(spark, tmp_path, batches, st.RESPONSES, ends=True)
    out, dropped = st.run_to_end(st.latency_windows(stream), str(tmp_path / "run"), (str(tmp_path / "ends"), st.RESPONSES, "completed_at_utc"))
    late = st.late_rows(feed(spark, tmp_path / "side", batches, st.RESPONSES), "completed_at_utc", 7 * day, str(tmp_path / "late"))
    assert sorted(r["response_id"] for r in late.collect()) == [4, 6] and dropped == 2
    assert sum(r["n"] for r in out.collect()) == 6
    before = spark.read.parquet(str(tmp_path / "run" / "out" / "batch=3")).count()
    assert before > 0  # closed windows were written long before the end


def test_first_responses(spark, tmp_path):
    stream = feed(spark, tmp_path, [[(1, "a", "x", 2.0, at(0))], [(2, "a", "y", 1.0, at(5)), (3, "b", "z", 1.0, at(6))]], st.RESPONSES)
    out, _ = st.run_to_end(st.first_responses(stream), str(tmp_path / "run"))
    assert sorted(r["qid"] for r in out.collect()) == ["a", "b"]


def test_sessions(spark, tmp_path):
    rows = [(i, at(s), 7, "click", 1.0, "") for i, s in enumerate([0, 60, 1800 + 59, 10_000])]
    out, _ = st.run_to_end(st.user_sessions(feed(spark, tmp_path, [rows], st.EVENTS, ends=True)), str(tmp_path / "run"), (str(tmp_path / "ends"), st.EVENTS, "ts"))
    assert sorted(r["n_events"] for r in out.collect()) == [1, 3]


def test_outcomes(spark, tmp_path):
    schema = "qid string, kind string, at timestamp"
    batches = [[("a", "request", at(0)), ("b", "request", at(0)), ("d", "request", at(1))], [("a", "response", at(10)), ("d", "response", at(500))], [("z", "request", at(90_000))], [("z", "response", at(90_001))]]
    out, _ = st.run_to_end(st.outcomes(feed(spark, tmp_path, batches, schema)), str(tmp_path / "run"))
    got = {r["qid"]: (r["outcome"], r["waited_s"]) for r in out.collect()}
    assert got["a"] == ("answered", 10.0) and got["b"] == ("timeout", 60.0) and got["d"][0] == "timeout" and got["z"] == ("answered", 1.0)


def in_files(folder, name, rows, schema):
    """A table of one file for each row, last changed in the order of the rows."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "timestamp": pa.timestamp("us")}
    fields = pa.schema([(column, kinds[kind]) for column, kind in (f.split(" ") for f in schema.split(", "))])
    table = folder / f"{name}.parquet"
    table.mkdir()
    for i, row in enumerate(rows):
        pq.write_table(pa.Table.from_pylist([dict(zip(fields.names, row))], fields), table / f"part-{i:02d}.parquet")
        os.utime(table / f"part-{i:02d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def test_late_rows_of_many_files_count(spark, tmp_path):
    """The last files hold rows far older than the watermark of the others (Spark drops by the one before last)."""
    day = 86_400
    rows = [(i, f"q{i}", "x", 1.0, at(40 * day + i)) for i in range(38)] + [(38, "q38", "x", 2.0, at(0)), (39, "q39", "x", 3.0, at(day))]
    in_files(tmp_path, "responses", rows, st.RESPONSES)
    got = sorted((r["day"], r["n"], r["latency_s"]) for r in streams.stream_latency(spark, str(tmp_path)).collect())
    assert got == [("2025-01-01", 1, 2.0), ("2025-01-02", 1, 3.0), ("2025-02-10", 38, 38.0)]


def test_late_sessions_of_many_files_count(spark, tmp_path):
    rows = [(i, at(40_000 + i), 7, "click", 1.0, "") for i in range(38)] + [(38, at(0), 7, "click", 1.0, ""), (39, at(60), 8, "click", 1.0, "")]
    in_files(tmp_path, "events", rows, st.EVENTS)
    got = sorted((r["user_id"], r["n_events"]) for r in streams.stream_sessions(spark, str(tmp_path)).collect())
    assert got == [(7, 1), (7, 38), (8, 1)]
