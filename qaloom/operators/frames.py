"""Which frames of a timeline to look at, under a budget.

Everything is arithmetic on arrays inside one row, so planning is a projection:
no shuffle, no Python.  Two rules keep results exact: even spacing computes its
step first, and halves round to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.prompts import global_sampling_text
from qaloom.functions.timecode import hhmmss, rint_index



def _none() -> Column:
    return F.array().cast("array<bigint>")


def span(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(_none())


def cap(a: Column, k: Column | int) -> Column:
    """At most ``k`` entries, evenly spaced, with both ends."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.size(a)
    step = (n - 1) / F.greatest(k - 1, F.lit(1))
    at = lambda i: F.when(i == k - 1, n - 1).otherwise(F.rint(i * step).cast("int"))
    spaced = F.transform(span(k), lambda i: F.get(a, at(i).cast("int")))
    return F.when(k <= 0, F.slice(a, F.lit(1), F.lit(0))).when(n <= k, a).when(k == 1, F.slice(a, F.lit(1), F.lit(1))).otherwise(spaced)


def cap_positions(n: Column, k: Column | int) -> Column:
    """Positions that ``cap`` keeps of an array of ``n`` entries, without the array."""
    k = F.lit(k) if isinstance(k, int) else k
    step = (n - 1) / F.greatest(k - 1, F.lit(1))
    spaced = F.transform(span(k), lambda i: F.when(i == k - 1, n - 1).otherwise(F.rint(i * step).cast("bigint")))
    return F.when((n <= 0) | (k <= 0), _none()).when(n <= k, span(n)).when(k == 1, F.array(F.lit(0).cast("bigint"))).otherwise(spaced)


def merged(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def candidate_times(duration: Column, fps: float = 1.0) -> Column:
    """Seconds 0, step, 2 step ... before the end of a window; at least one."""
    step = 1.0 / fps
    count = F.greatest(F.lit(1).cast("bigint"), F.ceil(duration / step - 1e-9).cast("bigint"))
    return F.transform(span(count), lambda i: i * F.lit(step))


def frame_file(index: Column, clock: Column) -> Column:
    """Name of a cached frame."""
    return F.concat(F.lit("frame_"), F.lpad(index.cast("string"), 9, "0"), F.lit("_"), F.replace(clock, F.lit(":"), F.lit("-")), F.lit(".jpg"))


def planned_times(df: DataFrame, fps: float = 1.0, most: int = 32) -> DataFrame:
    """Adds ``times``: seconds from the start of the window at which to look.  df: start_time, end_time."""
    df = df.withColumn("times", candidate_times(F.col("end_time") - F.col("start_time"), fps))
    return df.withColumn("times", cap(F.col("times"), most))


def frame_rows(df: DataFrame, keep: list[str], fps: float = 1.0, most: int = 32) -> DataFrame:
    """Long form: ``keep``, frame_no, source_index, relative_s, absolute_s, timestamp, file; one row per frame.

    The times are exploded first, so all the rest is plain columns in generated
    code.  df: start_time, end_time, fps, total_frames.
    """
    rows = planned_times(df, fps, most).select(*keep, "start_time", "fps", "total_frames", F.posexplode("times").alias("frame_no", "relative_s"))
    rows = rows.withColumn("absolute_s", F.col("start_time") + F.col("relative_s"))
    rows = rows.withColumn("source_index", rint_index(F.col("absolute_s"), F.col("fps"), F.col("total_frames"))).withColumn("timestamp", hhmmss(F.col("absolute_s")))
    return rows.select(*keep, F.col("frame_no").cast("bigint").alias("frame_no"), "source_index", "relative_s", "absolute_s", "timestamp", frame_file(F.col("source_index"), F.col("timestamp")).alias("file"))


def frame_plan(df: DataFrame, fps: float = 1.0, most: int = 32) -> DataFrame:
    """Nested form: adds ``frames``, array of struct(source_index, relative_s, absolute_s, timestamp, file)."""

    def frame(t: Column) -> Column:
        absolute = F.col("start_time") + t
        index = rint_index(absolute, F.col("fps"), F.col("total_frames"))
        clock = hhmmss(absolute)
        return F.struct(index.alias("source_index"), t.alias("relative_s"), absolute.alias("absolute_s"), clock.alias("timestamp"), frame_file(index, clock).alias("file"))

    df = planned_times(df, fps, most)
    return df.withColumn("frames", F.transform("times", frame)).drop("times")


# --- clips: the grid of a decoded clip -----------------------------------------


def clip_grid(total_frames: Column, fps: Column, target_fps: float = 1.0) -> Column:
    """Frame indices of the sampling grid of a whole clip."""
    last = (total_frames - 1) / fps
    step = 1.0 / target_fps
    count = F.floor(last / step).cast("bigint") + 1
    return F.array_distinct(F.transform(span(count), lambda i: rint_index(i * F.lit(step), fps, total_frames)))


def nearest(grid: Column, fps: Column, target: Column) -> Column:
    """Entry of the grid nearest to a time, the lowest of equally near ones."""
    best = F.array_min(F.transform(grid, lambda i: F.struct(F.abs(i / fps - target).alias("far"), i.alias("index"))))
    return best["index"]


def between_frames(grid: Column, fps: Column, start: Column, t1: Column, t2: Column) -> Column:
    """Entries of the grid whose absolute time lies within [t1, t2]."""
    return F.filter(grid, lambda i: (start + i / fps >= t1) & (start + i / fps <= t2))


def with_segment_frames(df: DataFrame, target_fps: float = 1.0, most: int = 32) -> DataFrame:
    """Adds ``selected`` (array<bigint>), ``used_mode`` and ``description`` for rows with mode, anchor_s, t1_s, t2_s, start_time, fps, total_frames.

    A special selection that comes out empty falls back to GLOBAL.
    """
    fps, start = F.col("fps"), F.col("start_time")
    df = df.withColumn("_grid", clip_grid(F.col("total_frames"), fps, target_fps))
    df = df.withColumn("_between", F.when(F.col("mode") == "INTERVAL", between_frames(F.col("_grid"), fps, start, F.col("t1_s"), F.col("t2_s"))))
    anchor = F.col("anchor_s") - start
    first, last = F.get("_grid", 0) / fps, F.element_at("_grid", -1) / fps
    df = df.withColumn("_anchor", F.when((F.col("mode") == "FORWARD") & (anchor >= first) & (anchor <= last), anchor))
    targets = F.filter(F.transform(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)), lambda d: F.col("_anchor") + d), lambda t: (t >= first) & (t <= last))
    df = df.withColumn("_targets", targets).withColumn("_local", F.array_sort(F.array_distinct(F.transform("_targets", lambda t: nearest(F.col("_grid"), fps, t)))))
    df = df.withColumn("_pool", F.filter("_grid", lambda i: i / fps > F.col("_anchor") + 2.0))
    df = df.withColumn("_forward", F.when(F.col("_anchor").isNotNull(), cap(merged(F.col("_local"), cap(F.col("_pool"), F.lit(most) - F.size("_local"))), most)))
    special = F.when((F.col("mode") == "INTERVAL") & (F.size("_between") > 0), cap(F.col("_between"), most)).when((F.col("mode") == "FORWARD") & (F.size("_forward") > 0), F.col("_forward"))
    df = df.withColumn("_special", special)
    df = df.withColumn("selected", F.coalesce("_special", cap(F.col("_grid"), most))).withColumn("used_mode", F.when(F.col("_special").isNotNull(), F.col("mode")).otherwise("GLOBAL"))
    length = F.col("end_time") - start if "end_time" in df.columns else F.col("total_frames") / fps
    count = F.concat(F.lit("The input consists of "), F.size("selected").cast("string"), F.lit(" chronologically ordered frames "))
    # fixed values: sentences that describe a selection
    text = (
        F.when(F.col("used_mode") == "INTERVAL", F.concat(count, F.lit("sampled from the explicit interval "), hhmmss(F.col("t1_s")), F.lit(" to "), hhmmss(F.col("t2_s")), F.lit(" specified in the question. When the interval contains more candidate frames than the frame budget, they are uniformly selected within that interval.")))
        .when(F.col("used_mode") == "FORWARD", F.concat(count, F.lit("selected for a forward temporal search from the question's anchor at "), hhmmss(F.col("anchor_s")), F.lit(". The frames include local context around the anchor and broad coverage after it toward the end of the supplied video segment. Sampling is not uniform across the full segment.")))
        .otherwise(global_sampling_text(F.size("selected"), length, target_fps, most))
    )
    df = df.withColumn("description", text)
    return df.drop("_grid", "_between", "_anchor", "_targets", "_local", "_pool", "_forward", "_special")


# --- regions and anchors of long procedures -------------------------------------


def region(start: Column, end: Column, fps: Column, total_frames: Column, target_fps: float) -> Column:
    """Indices over an inclusive stretch of seconds at a rate, always with the stretch's end."""
    last = (total_frames - 1) / fps
    into = lambda t: F.greatest(F.lit(0.0), F.least(t, last))
    low, high = F.least(into(start), into(end)), F.greatest(into(start), into(end))
    step = 1.0 / target_fps
    count = F.floor((high - low) / step).cast("bigint") + 1
    grid = F.transform(span(count), lambda i: low + i * F.lit(step))
    final = F.when(low + (count - 1) * step < high - 1e-9, F.array(high)).otherwise(F.array().cast("array<double>"))
    many = F.array_distinct(F.transform(F.concat(grid, final), lambda t: rint_index(t, fps, total_frames)))
    same = F.abs(low - high) <= 1e-8 + 1e-5 * F.abs(high)
    return F.when(same, F.array(rint_index(low, fps, total_frames))).otherwise(many)


def cap_keeping(a: Column, k: int, kept: Column) -> Column:
    """At most ``k`` entries, one of which must stay."""
    rest = cap(F.filter(a, lambda i: i != kept), k - 1)
    return F.when(F.size(a) <= k, a).when(F.lit(k) == 1, F.array(kept)).otherwise(merged(F.array(kept), rest))


def around(anchor: Column, fps: Column, total_frames: Column, radius: float, local_fps: float, k: int) -> Column:
    """Indices densely around a time, with the frame at the time itself."""
    last = (total_frames - 1) / fps
    at = F.greatest(F.lit(0.0), F.least(anchor, last))
    index = rint_index(at, fps, total_frames)
    near = region(F.greatest(F.lit(0.0), at - radius), F.least(last, at + radius), fps, total_frames, local_fps)
    return cap_keeping(merged(near, F.array(index)), k, index)


class Stretch:
    """The indices of ``region``, addressed by position, so that a long stretch costs only the entries taken.

    Holds where the video's rate is above the sampling rate: then neighbouring
    times lie more than a frame apart and all indices differ.  Columns ``_low``,
    ``_count``, ``_n`` and ``_final`` are added to the rows by ``put``.
    """

    def __init__(self, fps: Column, total_frames: Column, target_fps: float):
        self.fps, self.total, self.step = fps, total_frames, 1.0 / target_fps

    def put(self, df: DataFrame, start: Column, end: Column, when: Column) -> DataFrame:
        last = (self.total - 1) / self.fps
        into = lambda t: F.greatest(F.lit(0.0), F.least(t, last))
        df = df.withColumn("_low", F.when(when, F.least(into(start), into(end)))).withColumn("_high", F.when(when, F.greatest(into(start), into(end))))
        low, high = F.col("_low"), F.col("_high")
        same = F.abs(low - high) <= 1e-8 + 1e-5 * F.abs(high)
        df = df.withColumn("_count", F.when(same, F.lit(1).cast("bigint")).otherwise(F.floor((high - low) / self.step).cast("bigint") + 1))
        df = df.withColumn("_final", F.when(~same, rint_index(high, self.fps, self.total)))
        reached = low + (F.col("_count") - 1) * self.step
        more = (reached < high - 1e-9) & (F.col("_final") != rint_index(reached, self.fps, self.total))
        return df.withColumn("_n", F.col("_count") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0))

    def at(self, position: Column) -> Column:
        return F.when(position < F.col("_count"), rint_index(F.col("_low") + position * F.lit(self.step), self.fps, self.total)).otherwise(F.col("_final"))

    def entries(self, positions: Column) -> Column:
        return F.transform(positions, self.at)

    def positions_of(self, indices: Column) -> Column:
        """Positions of those indices that are in the stretch."""

        def position(i: Column) -> Column:
            near = F.rint((i / self.fps - F.col("_low")) / self.step).cast("bigint")
            inside = F.greatest(F.lit(0).cast("bigint"), F.least(near, F.col("_n") - 1))
            return F.when(self.at(inside) == i, inside).when(self.at(F.col("_n") - 1) == i, F.col("_n") - 1)

        return F.filter(F.transform(indices, position), lambda p: p.isNotNull())


def with_procedure_frames(df: DataFrame, target_fps: float = 1.0, most: int = 52, local_fps: float = 2.0, radius: float = 1.0, local_most: int = 5) -> DataFrame:
    """Adds ``selected``, ``used_intent``, ``kept_anchors`` and ``description`` for rows with intent, anchors, start_time, fps, total_frames.

    Anchors outside the clip (but for a small tolerance) are dropped; without
    any, a special intent falls back to GLOBAL.  Work per row is bounded by the
    budget, not by the length of the video, unless the video's rate is no higher
    than the sampling rate.
    """
    fps, total = F.col("fps"), F.col("total_frames")
    k = min(local_most, most)
    df = df.withColumn("_last", (total - 1) / fps)
    tolerance = F.greatest(F.lit(1.0) / fps, F.lit(0.25))
    df = df.withColumn("kept_anchors", F.filter("anchors", lambda a: (a - F.col("start_time") >= -tolerance) & (a - F.col("start_time") <= F.col("_last") + tolerance)))
    df = df.withColumn("_rel", F.transform("kept_anchors", lambda a: F.greatest(F.lit(0.0), F.least(a - F.col("start_time"), F.col("_last")))))
    n = F.size("_rel")
    df = df.withColumn("used_intent", F.when((n == 0) | ((F.col("intent") == "INTERVAL") & (n < 2)), "GLOBAL").otherwise(F.col("intent")))
    intent = F.col("used_intent")
    search = intent.isin("FORWARD_SEARCH", "BACKWARD_SEARCH", "PREFIX_STATE")
    single, broad = search | (intent == "LOCAL_ANCHOR"), intent.isin("GLOBAL", "INTERVAL")
    a0, a1 = F.get("_rel", 0), F.get("_rel", 1)
    forward = intent == "FORWARD_SEARCH"
    quick = fps > target_fps
    df = df.withColumn("_local", F.when(single, around(a0, fps, total, radius, local_fps, k)))
    df = df.withColumn("_from", F.when(forward, a0).when(intent == "INTERVAL", F.least(a0, a1)).otherwise(F.lit(0.0)))
    df = df.withColumn("_to", F.when(forward | (intent == "GLOBAL"), F.col("_last")).when(intent == "INTERVAL", F.greatest(a0, a1)).when(search, a0))
    some_budget = F.greatest(F.lit(1), F.lit(most) - F.size("_local"))

    stretch = Stretch(fps, total, target_fps)
    df = stretch.put(df, F.col("_from"), F.col("_to"), quick & (search | broad))
    df = df.withColumn("_taken", F.when(F.col("_low").isNotNull() & search, cap_positions(F.col("_n"), some_budget)))
    df = df.withColumn("_region", F.when(~quick & (search | broad), region(F.col("_from"), F.col("_to"), fps, total, target_fps)))
    df = df.withColumn("_some", F.when(search, merged(F.col("_local"), F.when(quick, stretch.entries(F.col("_taken"))).otherwise(cap(F.col("_region"), some_budget)))))
    # fill what is left of the budget evenly from the entries not yet taken: the r-th of them follows all taken ones at or before it
    df = df.withColumn("_used", F.when(F.col("_taken").isNotNull(), merged(F.col("_taken"), stretch.positions_of(F.col("_local")))))
    df = df.withColumn("_used", F.transform("_used", lambda p, i: p - i))
    ranks = cap_positions(F.col("_n") - F.size("_used"), F.lit(most) - F.size("_some"))
    free = F.transform(ranks, lambda r: r + F.size(F.filter("_used", lambda u: u <= r)))
    extra = F.when(quick, stretch.entries(free)).otherwise(cap(F.array_except("_region", "_some"), F.lit(most) - F.size("_some")))
    filled = F.when(F.size("_some") >= most, cap(F.col("_some"), most)).otherwise(merged(F.col("_some"), extra))
    several = F.array_sort(F.array_distinct(F.flatten(F.transform("_rel", lambda a: around(a, fps, total, radius, local_fps, k)))))
    df = df.withColumn("_several", F.when(intent == "TWO_ANCHOR", several))
    whole = F.when(quick, stretch.entries(cap_positions(F.col("_n"), most))).otherwise(cap(F.col("_region"), most))
    selected = F.when(broad, whole).when(intent == "TWO_ANCHOR", cap(F.col("_several"), most)).when(intent == "LOCAL_ANCHOR", F.col("_local")).when(search, filled)
    df = df.withColumn("selected", selected)
    count = F.concat(F.size("selected").cast("string"), F.lit(" chronologically ordered frames "))
    t = lambda i: hhmmss(F.get("kept_anchors", i))
    # fixed values: sentences that describe a selection
    text = (
        F.when(intent == "GLOBAL", F.concat(count, F.lit("sampled for broad coverage across the supplied procedure-level video context.")))
        .when(intent == "INTERVAL", F.concat(count, F.lit("sampled across the explicit interval "), t(0), F.lit(" to "), t(1), F.lit(".")))
        .when(intent == "TWO_ANCHOR", F.concat(count, F.lit("sampled densely around the explicit comparison time points "), F.array_join(F.transform("kept_anchors", hhmmss), ", "), F.lit(".")))
        .when(intent == "LOCAL_ANCHOR", F.concat(count, F.lit("sampled densely around the explicit time point "), t(0), F.lit(".")))
        .when(forward, F.concat(count, F.lit("combining dense sampling around "), t(0), F.lit(" with broad coverage from that point to the end of the supplied context.")))
        .when(intent == "BACKWARD_SEARCH", F.concat(count, F.lit("combining broad coverage from the start through "), t(0), F.lit(" with dense sampling around that time point.")))
        .when(intent == "PREFIX_STATE", F.concat(count, F.lit("covering the supplied procedure history up to "), t(0), F.lit(", with denser sampling near that time point.")))
    )
    return df.withColumn("description", text).drop("_last", "_rel", "_local", "_from", "_to", "_low", "_high", "_count", "_final", "_n", "_taken", "_used", "_region", "_some", "_several")


def clip_violations(df: DataFrame, key: str, most: int) -> DataFrame:
    """(key, rule): selections that are out of order, repeated, out of range or too many."""
    s = F.col("selected")
    rules = {
        "empty": F.size(s) == 0,
        "too_many": F.size(s) > most,
        "not_increasing": s != F.array_sort(F.array_distinct(s)),
        "out_of_range": F.exists(s, lambda i: (i < 0) | (i >= F.col("total_frames"))),
    }
    return df.select(F.col(key), F.explode(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items()))).alias("rule")).where("rule is not null")
