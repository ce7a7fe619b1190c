"""Continuous periods and gaps of overlapping time intervals, per entity.

Sweep line: every boundary becomes a plus or minus event, the events of one
entity at one instant are summed before the shuffle, and a prefix sum of the
events gives the number of open intervals.

No task ever holds a whole entity.  Time is cut into chunks of ``chunk_ms``; a
chunk of an entity holds at most ``chunk_ms`` instants after the sums, however
many intervals there are.  One short pass over the chunk totals carries the
number of open intervals, and the start of an open period, into each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _events(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    boundaries = F.array(
        F.struct(F.col(start).cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("opens"), F.lit(0).cast("bigint").alias("closes")),
        F.struct(F.col(end).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("opens"), F.lit(1).cast("bigint").alias("closes")),
    )
    return intervals.select(F.col(key).alias("key"), F.explode(boundaries).alias("e")).groupBy("key", F.col("e.at").alias("at")).agg(F.sum("e.opens").alias("opens"), F.sum("e.closes").alias("closes"))


def sweep(intervals: DataFrame, key: str, start: str, end: str, chunk_ms: int = 600_000) -> DataFrame:
    """(key, kind, start_ms, end_ms): ``period`` and ``gap`` rows.

    ``start`` and ``end`` are whole numbers with ``end >= start``; rows with a
    null key, start or end, or a reversed interval, make no event.  Intervals
    that touch or overlap join; equal and repeated intervals change nothing.  An
    empty table gives no rows.  Extra columns are ignored.
    """
    sound = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    # the joins below imply these filters on one side only; stated for both, the sides stay alike and share their exchange
    events = _events(sound, key, start, end).withColumn("chunk", F.floor(F.col("at") / F.lit(chunk_ms)).cast("bigint")).where("key is not null and chunk is not null")

    # All of a chunk's figures come from windows over (key, chunk), so both branches of each join below start from one exchange.
    ordered, whole_chunk = Window.partitionBy("key", "chunk").orderBy("at"), Window.partitionBy("key", "chunk")
    step = F.col("opens") - F.col("closes")
    local = events.withColumn("after_local", F.sum(step).over(ordered)).withColumn("first_at", F.min("at").over(whole_chunk)).withColumn("net", F.sum(step).over(whole_chunk))

    # one row for each chunk that has events; the carry is a prefix sum over those few rows
    over_chunks = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.where("at = first_at").select("key", "chunk", F.coalesce(F.sum("net").over(over_chunks), F.lit(0)).alias("carried"))
    after = F.col("after_local") + F.col("carried")
    open_at = local.join(carry, ["key", "chunk"]).select("key", "chunk", "at", "opens", (after - step).alias("before"), after.alias("after"))

    begins: Column = (F.col("before") == 0) & (F.col("opens") > 0)
    ends: Column = (F.col("after") == 0) & ((F.col("before") > 0) | (F.col("opens") > 0))
    edges = open_at.where(begins | ends).select("key", "chunk", "at", begins.alias("begins"), ends.alias("ends"))

    # start of the period that an end closes, and end of the period before a start: in this chunk, or the last of the chunks before
    begin_at, end_at = F.when(F.col("begins"), F.col("at")), F.when(F.col("ends"), F.col("at"))
    to_here, before_here = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered.rowsBetween(Window.unboundedPreceding, -1)
    known = edges.withColumn("start_here", F.last(begin_at, ignorenulls=True).over(to_here)).withColumn("end_here", F.last(end_at, ignorenulls=True).over(before_here))
    known = known.withColumn("first_at", F.min("at").over(whole_chunk)).withColumn("last_start", F.max(begin_at).over(whole_chunk)).withColumn("last_end", F.max(end_at).over(whole_chunk))
    tails = known.where("at = first_at").select("key", "chunk", F.last("last_start", ignorenulls=True).over(over_chunks).alias("start_before"), F.last("last_end", ignorenulls=True).over(over_chunks).alias("end_before"))
    whole = known.select("key", "chunk", "at", "begins", "ends", "start_here", "end_here").join(tails, ["key", "chunk"])

    period = F.when(F.col("ends"), F.struct(F.lit("period").alias("kind"), F.coalesce("start_here", "start_before").alias("start_ms"), F.col("at").alias("end_ms")))
    before = F.coalesce("end_here", "end_before")
    gap = F.when(F.col("begins") & before.isNotNull(), F.struct(F.lit("gap").alias("kind"), before.alias("start_ms"), F.col("at").alias("end_ms")))
    rows = whole.select("key", F.explode(F.filter(F.array(period, gap), lambda r: r.isNotNull())).alias("r"))
    return rows.select("key", "r.kind", "r.start_ms", "r.end_ms")


def request_windows(requests: DataFrame) -> DataFrame:
    """(vkey, start_ms, end_ms): windows that count, in whole milliseconds.

    Repeated windows stay: to a sweep they open and close together, so making
    them unique would only cost an exchange.
    """
    from qaloom.functions.text import vkey

    start, end = F.col("start_time"), F.col("end_time")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    sound = requests.where(finite(start) & finite(end) & (end > start))
    rows = sound.select(vkey(F.col("videoid")).alias("vkey"), F.round(start * 1000).cast("bigint").alias("start_ms"), F.round(end * 1000).cast("bigint").alias("end_ms"))
    return rows.where("vkey is not null")
