"""Requests and responses as streams.

State is bounded by watermarks: windows, sessions and remembered responses go
once they are older than the latest time seen less the allowed lateness, and are
written then.  Each batch writes to a folder of its own, which a rerun of the
batch replaces.  A stream that has an end is flushed by rows of the far future,
so that what is still open is written too.  Rows that come later than allowed
are left out of the groups and go to a side output, where they are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

RESPONSES = "response_id bigint, qid string, answer string, latency double, completed_at_utc timestamp"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


FAR = "timestamp '9000-01-01 00:00:00'"


def table_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int | None = None, ends: str | None = None) -> DataFrame:
    """A table's files as a stream; the pattern lets one file or a folder of files be the table.

    Without a number of files, what is there when the stream starts is one
    batch: for a table whose files are in no order of time, in which a watermark
    set by some files would make the older rows of the rest late.  ``ends`` is a
    folder that ``run_to_end`` writes flushing rows to.
    """
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    if ends is None:
        return rows
    spark.createDataFrame([], schema).write.mode("append").parquet(ends)  # the folder must be there
    return rows.unionByName(spark.readStream.schema(schema).parquet(ends))


def first_responses(responses: DataFrame, late: str = "7 days") -> DataFrame:
    """The first response of each question; repeats are recognised as long as the watermark allows."""
    return responses.withWatermark("completed_at_utc", late).dropDuplicatesWithinWatermark(["qid"])


def latency_windows(responses: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, n, n_timed, latency_s): distinct responses per window of completion."""
    rows = responses.where("completed_at_utc is not null").withWatermark("completed_at_utc", late).dropDuplicates(["response_id", "qid", "answer", "latency", "completed_at_utc"])
    grouped = rows.groupBy(F.window("completed_at_utc", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count("latency").alias("n_timed"), F.sum("latency").alias("latency_s"))
    return grouped.select(F.col("w.start").alias("window_start"), "n", "n_timed", "latency_s")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n_events) of sessions parted by silence."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


OUTCOME = "qid string, outcome string, waited_s double"


def outcomes(messages: DataFrame, patience_s: float = 60.0, late: str = "1 hour") -> DataFrame:
    """(qid, outcome, waited_s): ``answered`` at the first response, or ``timeout`` if none came in time.

    messages: qid, kind (request or response), at (timestamp).  State is one row
    for each open question and goes when the question is closed or times out.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"qid": [key[0]], "outcome": ["timeout"], "waited_s": [patience_s]})
            return
        answered = None
        for b in batches:
            at = b["at"].astype("int64") / (1e9 if str(b["at"].dtype).startswith("datetime64[ns") else 1e6)
            first = at[b["kind"] == "request"].min()
            asked = first if asked is None and pd.notna(first) else asked
            first = at[b["kind"] == "response"].min()
            answered = first if answered is None or (pd.notna(first) and first < answered) else answered
        if asked is not None and answered is not None and pd.notna(answered):
            if state.exists:
                state.remove()
            waited = float(answered - asked)
            yield pd.DataFrame({"qid": [key[0]], "outcome": ["answered" if waited <= patience_s else "timeout"], "waited_s": [min(waited, patience_s)]})
        elif asked is not None:
            state.update((float(asked),))
            state.setTimeoutTimestamp(max(int((asked + patience_s) * 1000), state.getCurrentWatermarkMs() + 1))

    return messages.withWatermark("at", late).groupBy("qid").applyInPandasWithState(update, OUTCOME, "asked double", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, folder: str, ends: tuple[str, str, str] | None = None) -> tuple[DataFrame, int]:
    """Runs over all that is there; the outcome, and how many rows came too late for it.

    ends: folder, schema and time column of the flushing rows, for a stream that
    nothing will follow.  Two are needed: the first moves the watermark, at the
    second all that is older goes.
    """
    spark = stream.sparkSession
    dropped = 0

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for turn in range(3 if ends else 1):
        if turn:
            where, schema, time = ends
            fields = [(F.expr(FAR) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
            spark.range(1).select(*fields).coalesce(1).write.mode("append").parquet(where)
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), dropped


def late_rows(stream: DataFrame, time: str, late_s: float, folder: str) -> DataFrame:
    """Side output: the rows that come more than ``late_s`` behind the latest time of earlier batches.

    Run over the same source with the same files a batch, these are the rows
    that a watermark of that lateness leaves out: it is the watermark of the
    batch before, so the latest time of the batches before that one.  Each batch writes its latest
    time next to its late rows, so a batch that runs again decides alike.
    """
    spark = stream.sparkSession
    seen = "seen double, batch long"

    def write(batch: DataFrame, number: int) -> None:
        known = None
        if number > 1:
            known = spark.read.schema(seen).parquet(f"{folder}/seen").where(F.col("batch") < number - 1).agg(F.max("seen")).first()[0]
        at = F.col(time).cast("double")
        late = batch.where(at < known - late_s) if known is not None else batch.where(F.lit(False))
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.agg(F.max(at).alias("seen")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/late")
