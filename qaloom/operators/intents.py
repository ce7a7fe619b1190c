"""Routing of questions to temporal intents, as expressions.

Both routers are ordered CASE chains over literal patterns: Catalyst sees them,
filters on the outcome stay where they are, and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import intent_text, question_key
from qaloom.functions.timecode import clock_times, lenient_seconds, strict_seconds

# --- fixed values: question templates and cues --------------------------------
_TIME = r"\d{2}:[0-5]\d:[0-5]\d"
_OBJECT = r"[a-z][a-z0-9 /_-]{0,60}?"
INTERVAL = rf"\Awhat types of foreign objects are seen between ({_TIME}) and ({_TIME})\? please provide the class name\(s\) or answer none\.\z"
RETRIEVAL = rf"\Athere is one ({_OBJECT}) in the frame at ({_TIME})\. when is it retrieved from the surgical site\? please provide the answer in hh:mm:ss\.\z"
REAPPEAR = rf"\Adoes the ({_OBJECT}), last visible just before ({_TIME}), re-appear later in the video\? please answer with yes or no\.\z"

INTERVAL_CUES = (r"between\s+<time>\s+and\s+<time>", r"from\s+<time>\s*(?:-|to|until|through(?:\s+to)?)\s*<time>")
PREFIX_CUES = (r"considering\s+all\s+prior", r"by\s+(?:frame\s+)?<time>.*\b(?:remain|remains|remaining|left|present)\b")
FORWARD_CUES = (r"\breappear\b.*\b(?:later|afterwards|subsequently)\b", r"\bdoes\s+(?:a\s+)?retrieval\b.*\bexist\b", r"\bwhen\s+(?:is|was)\s+it\s+retrieved\b", r"\bwhen\s+is\b.*\bseen\s+in\s+frame\s+<time>.*\blast\s+seen\b")
BACKWARD_CUES = (r"\bwhen\s+was\b.*\b(?:visible|seen)\b.*(?:frame\s+at|frame|at)\s+<time>.*\bfirst\s+(?:inserted|created)\b",)
LOCAL_SPECIAL_CUES = (r"\bfirst\s+occurs\b.*at\s+time\s+point\s+<time>",)
UNRESOLVED_CUES = (r"\b(?:before|after|later|earlier|first|last|prior|previous(?:ly)?|subsequent(?:ly)?|until|remain(?:s|ing)?|retriev\w*|reappear)\b",)
LOCAL_CUES = (r"\bat\s+(?:time\s+point\s+)?<time>", r"\bin\s+frame\s+<time>")


def window_valid(start: Column, end: Column) -> Column:
    """Whether a window is finite, not negative and not reversed."""
    s, e = start.cast("double"), end.cast("double")
    return F.coalesce(~F.isnan(s) & ~F.isnan(e) & (s >= 0) & (e > s) & (e < F.lit(float("inf"))), F.lit(False))


def with_segment_intent(df: DataFrame, question: str = "question", start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Adds mode, template_id, anchor_s, t1_s, t2_s and object_name of the strict three-way router.

    A template that matches but fails its bounds makes the row GLOBAL; later
    templates are not tried.
    """
    q, s, e = F.col("_key"), F.col(start).cast("double"), F.col(end).cast("double")
    df = df.withColumn("_key", question_key(F.col(question)))
    group = lambda pattern, n: F.nullif(F.regexp_extract(q, pattern, n), F.lit(""))
    df = df.withColumn("_t1", strict_seconds(group(INTERVAL, 1))).withColumn("_t2", strict_seconds(group(INTERVAL, 2)))
    df = df.withColumn("_r", strict_seconds(group(RETRIEVAL, 2))).withColumn("_a", strict_seconds(group(REAPPEAR, 2)))
    valid = window_valid(s, e)
    in_window = lambda t: (t >= s) & (t < e)
    template = (
        F.when(~valid | (q == ""), "global_fallback")
        .when(F.col("_t1").isNotNull(), F.when((s <= F.col("_t1")) & (F.col("_t1") < F.col("_t2")) & (F.col("_t2") <= e), "interval_fo_seen_between").otherwise("global_fallback"))
        .when(F.col("_r").isNotNull(), F.when(in_window(F.col("_r")), "forward_retrieval_after_visible_anchor").otherwise("global_fallback"))
        .when(F.col("_a").isNotNull(), F.when(in_window(F.col("_a")), "forward_reappearance_after_last_visible").otherwise("global_fallback"))
        .otherwise("global_fallback")
    )
    df = df.withColumn("template_id", template)
    is_ = lambda name: F.col("template_id") == name
    interval, retrieval, reappear = is_("interval_fo_seen_between"), is_("forward_retrieval_after_visible_anchor"), is_("forward_reappearance_after_last_visible")
    return df.select(
        *(c for c in df.columns if c not in ("_key", "_t1", "_t2", "_r", "_a", "template_id")),
        F.when(interval, "INTERVAL").when(retrieval | reappear, "FORWARD").otherwise("GLOBAL").alias("mode"),
        "template_id",
        F.when(retrieval, F.col("_r")).when(reappear, F.col("_a")).alias("anchor_s"),
        F.when(interval, F.col("_t1")).alias("t1_s"),
        F.when(interval, F.col("_t2")).alias("t2_s"),
        F.when(retrieval, group(RETRIEVAL, 1)).when(reappear, group(REAPPEAR, 1)).alias("object_name"),
    )


def with_procedure_intent(df: DataFrame, question: str = "question") -> DataFrame:
    """Adds intent, anchors (array<double>), anchor_texts and malformed of the seven-way router.

    A question with a clock time out of range is ``malformed`` and has no
    intent; nor has a blank one.
    """
    df = df.withColumn("_text", intent_text(F.col(question))).withColumn("anchor_texts", clock_times(F.coalesce(F.col(question), F.lit(""))))
    df = df.withColumn("anchors", F.transform("anchor_texts", lenient_seconds))
    df = df.withColumn("malformed", F.exists("anchors", lambda a: a.isNull()))
    text = F.col("_text")
    any_of = lambda cues: F.lit(False) if not cues else text.rlike("|".join(f"(?:{c})" for c in cues))
    n = F.size("anchor_texts")
    intent = (
        F.when(F.coalesce(F.trim(F.col(question)), F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.col("malformed"), F.lit(None).cast("string"))
        .when(n == 0, "GLOBAL")
        .when(any_of(INTERVAL_CUES), "INTERVAL")
        .when(n >= 2, "TWO_ANCHOR")
        .when(any_of(PREFIX_CUES), "PREFIX_STATE")
        .when(any_of(FORWARD_CUES), "FORWARD_SEARCH")
        .when(any_of(BACKWARD_CUES), "BACKWARD_SEARCH")
        .when(any_of(LOCAL_SPECIAL_CUES), "LOCAL_ANCHOR")
        .when(any_of(UNRESOLVED_CUES), "GLOBAL")
        .when(any_of(LOCAL_CUES), "LOCAL_ANCHOR")
        .otherwise("GLOBAL")
    )
    return df.withColumn("intent", intent).drop("_text")
