"""Queries that plan frames and route questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions.text import cache_folder
from qaloom.operators import frames as fr
from qaloom.operators.intents import with_procedure_intent, with_segment_intent
from qaloom.plans import views as v

MOST_SEGMENT, MOST_PROCEDURE = 32, 52


def _rows(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return fr.frame_rows(v.request_frames(spark, sf), list(keep), most=MOST_SEGMENT)


def frame_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: one row for each request and frame."""
    rows = _rows(spark, sf, "qid", "dataset", "video")
    return rows.withColumn("relative_s", F.round("relative_s", 6)).withColumn("absolute_s", F.round("absolute_s", 6))


def frame_plan_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Per dataset: frames referred to, distinct cached files, and what sharing saves."""
    per = _rows(spark, sf, "dataset", "video").groupBy("dataset", "video", "file").agg(F.count(F.lit(1)).alias("n"))
    folders = per.groupBy("dataset", "video").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files")).withColumn("folder", cache_folder(F.col("dataset"), F.col("video")))
    return folders.groupBy("dataset").agg(F.sum("n").alias("n_references"), F.sum("files").alias("n_files"), (F.sum("n") - F.sum("files")).alias("n_saved"), F.count_distinct("folder").alias("n_folders"))


def decode_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Per video: which frames to decode, in batches of 128 in order of index."""
    from pyspark.sql import Window

    rows = _rows(spark, sf, "video").select("video", "source_index", "timestamp").distinct()
    # a video's distinct frames are bounded by its length, so one window per video is bounded too
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("video").orderBy("source_index", "timestamp")) - 1)
    return numbered.groupBy("video", F.floor(F.col("n") / 128).cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n_frames"), F.min("source_index").alias("first_index"), F.max("source_index").alias("last_index"))


def segment_intent(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_segment_intent(v.template_questions(spark, sf))
    return rows.select("qid", "asked", "mode", "template_id", "anchor_s", "t1_s", "t2_s", "object_name")


def procedure_intent(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_procedure_intent(v.requests(spark, sf))
    return rows.select("qid", "intent", F.array_join("anchor_texts", ",").alias("anchors"), "malformed")


def segment_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Interval and forward selections over each request's clip, GLOBAL where they don't apply."""
    rows = fr.with_segment_frames(with_segment_intent(v.template_questions(spark, sf)), most=MOST_SEGMENT)
    return rows.select("qid", "asked", "mode", "used_mode", F.size("selected").cast("bigint").alias("n_frames"), F.array_join(F.col("selected").cast("array<string>"), ",").alias("frames"), "description")


def _procedures(spark: SparkSession, sf: str) -> DataFrame:
    """Questions over their whole video: the clip starts at 0."""
    rows = with_procedure_intent(v.request_frames(spark, sf)).where("intent is not null")
    return fr.with_procedure_frames(rows.withColumn("start_time", F.lit(0.0)), most=MOST_PROCEDURE)


def procedure_frames(spark: SparkSession, sf: str) -> DataFrame:
    return _procedures(spark, sf).select("qid", "intent", "used_intent", F.size("selected").cast("bigint").alias("n_frames"), F.array_join(F.col("selected").cast("array<string>"), ",").alias("frames"), "description")


def clip_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rules broken by any selection; none is expected."""
    a = fr.clip_violations(_procedures(spark, sf), "qid", MOST_PROCEDURE).withColumn("track", F.lit("procedure"))
    b = fr.clip_violations(fr.with_segment_frames(with_segment_intent(v.template_questions(spark, sf)), most=MOST_SEGMENT), "qid", MOST_SEGMENT).withColumn("track", F.lit("segment"))
    return a.unionByName(b)


QUERIES = {"frame_plan": frame_plan, "frame_plan_dedup": frame_plan_dedup, "decode_jobs": decode_jobs, "segment_intent": segment_intent, "procedure_intent": procedure_intent, "segment_frames": segment_frames, "procedure_frames": procedure_frames, "clip_violations": clip_violations}

# --- SQL ------------------------------------------------------------------------

_PLAN = f"""with {v.REQUESTS},{v.VIDEOS},
pl0 as (select qid, dataset, rq.video, start_time, fps, total_frames, range(greatest(1, ceil((end_time - start_time) - 1e-9)::bigint)) as t from rq join vd using (video)),
pl1 as (select *, {v.cap_sql('t', str(MOST_SEGMENT))} as c from pl0),
pl2 as (select qid, dataset, video, start_time, fps, total_frames, unnest(range(len(c))) as frame_no, unnest(c)::double as relative_s from pl1),
pl3 as (select *, start_time + relative_s as absolute_s, {v.rint_sql('start_time + relative_s', 'fps', 'total_frames')} as source_index, {v.clock_sql('floor(start_time + relative_s)::bigint')} as timestamp from pl2),
pl as (select qid, dataset, video, frame_no, source_index, round(relative_s, 6) as relative_s, round(absolute_s, 6) as absolute_s, timestamp, 'frame_' || lpad(source_index::varchar, 9, '0') || '_' || replace(timestamp, ':', '-') || '.jpg' as file from pl3)
"""
_SLUG = r"substr(coalesce(nullif(trim(regexp_replace(regexp_replace(video, '^(.+)\.[^.]+$', '\1'), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'video'), 1, 60)"

# fixed values: question templates and cues, the same as those of operators/intents.py, as one alternation each
_T = r"\d{2}:[0-5]\d:[0-5]\d"
_INTERVAL = rf"^what types of foreign objects are seen between ({_T}) and ({_T})\? please provide the class name\(s\) or answer none\.$"
_RETRIEVAL = rf"^there is one ([a-z][a-z0-9 /_-]{{0,60}}?) in the frame at ({_T})\. when is it retrieved from the surgical site\? please provide the answer in hh:mm:ss\.$"
_REAPPEAR = rf"^does the ([a-z][a-z0-9 /_-]{{0,60}}?), last visible just before ({_T}), re-appear later in the video\? please answer with yes or no\.$"
_SEC = "(split_part({0}, ':', 1)::double * 3600 + split_part({0}, ':', 2)::double * 60 + split_part({0}, ':', 3)::double)"
_SEGMENT = f"""with {v.REQUESTS},{v.TEMPLATES},
sg0 as (select *, replace(lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))), 'ß', 'ss') as q from tq),
sg1 as (select *, nullif(regexp_extract(q, '{_INTERVAL}', 1), '') as a, nullif(regexp_extract(q, '{_INTERVAL}', 2), '') as b, nullif(regexp_extract(q, '{_RETRIEVAL}', 2), '') as r, nullif(regexp_extract(q, '{_REAPPEAR}', 2), '') as p from sg0),
sg2 as (select *, {_SEC.format('a')} as t1, {_SEC.format('b')} as t2, {_SEC.format('r')} as tr, {_SEC.format('p')} as tp from sg1),
sg3 as (select *, case
  when a is not null then case when start_time <= t1 and t1 < t2 and t2 <= end_time then 'interval_fo_seen_between' else 'global_fallback' end
  when r is not null then case when start_time <= tr and tr < end_time then 'forward_retrieval_after_visible_anchor' else 'global_fallback' end
  when p is not null then case when start_time <= tp and tp < end_time then 'forward_reappearance_after_last_visible' else 'global_fallback' end
  else 'global_fallback' end as template_id from sg2),
sg as (select *, case when template_id like 'interval%' then 'INTERVAL' when template_id like 'forward%' then 'FORWARD' else 'GLOBAL' end as mode,
  case template_id when 'forward_retrieval_after_visible_anchor' then tr when 'forward_reappearance_after_last_visible' then tp end as anchor_s,
  case when template_id like 'interval%' then t1 end as t1_s, case when template_id like 'interval%' then t2 end as t2_s,
  case template_id when 'forward_retrieval_after_visible_anchor' then regexp_extract(q, '{_RETRIEVAL}', 1) when 'forward_reappearance_after_last_visible' then regexp_extract(q, '{_REAPPEAR}', 1) end as object_name from sg3)
"""
_SEGMENT_FRAMES = (
    _SEGMENT
    + f""",
sf0 as (select *, list_distinct(list_transform(range(floor((total_frames - 1) / fps)::bigint + 1), lambda i: {v.rint_sql('i', 'fps', 'total_frames')})) as g0 from sg),
sf1 as (select *, list_sort(g0) as g, anchor_s - start_time as rel from sf0),
sf2 as (select *, case when mode = 'INTERVAL' then list_filter(g, lambda i: start_time + i / fps >= t1_s and start_time + i / fps <= t2_s) end as inside,
  case when mode = 'FORWARD' and rel >= g[1] / fps and rel <= g[-1] / fps then rel end as anchor from sf1),
sf3 as (select *, list_filter(list_transform([-1.0::double, 0.0, 1.0, 2.0], lambda d: anchor + d), lambda t: t >= g[1] / fps and t <= g[-1] / fps) as targets from sf2),
sf4 as (select *, list_sort(list_distinct(list_transform(targets, lambda t: list_min(list_transform(g, lambda i: {{'far': abs(i / fps - t), 'i': i}})).i))) as near, list_filter(g, lambda i: i / fps > anchor + 2.0) as pool from sf3),
sf5 as (select *, {v.cap_sql('pool', f'({MOST_SEGMENT} - len(near))')} as broad from sf4),
sf6 as (select *, case when mode = 'INTERVAL' and len(inside) > 0 then {v.cap_sql('inside', str(MOST_SEGMENT))} when anchor is not null then list_sort(list_distinct(list_concat(near, broad))) end as special from sf5),
sf as (select qid, asked, t1_s, t2_s, anchor_s, end_time - start_time as d, mode, case when special is null then 'GLOBAL' else mode end as used_mode, case when special is null then {v.cap_sql('g', str(MOST_SEGMENT))} else {v.cap_sql('special', str(MOST_SEGMENT))} end as s from sf6)
select qid, asked, mode, used_mode, len(s) as n_frames, array_to_string(s, ',') as frames, 'The input consists of ' || len(s)::varchar || ' chronologically ordered frames ' || case used_mode
  when 'INTERVAL' then 'sampled from the explicit interval ' || {v.clock_sql('t1_s::bigint')} || ' to ' || {v.clock_sql('t2_s::bigint')} || ' specified in the question. When the interval contains more candidate frames than the frame budget, they are uniformly selected within that interval.'
  when 'FORWARD' then 'selected for a forward temporal search from the question''s anchor at ' || {v.clock_sql('anchor_s::bigint')} || '. The frames include local context around the anchor and broad coverage after it toward the end of the supplied video segment. Sampling is not uniform across the full segment.'
  else case when len(s) >= {MOST_SEGMENT} and d > {MOST_SEGMENT} then 'uniformly selected across the ' || format('{{:g}}', d) || '-second trimmed video segment after sampling at 1 fps.' else 'sampled at 1 fps from the ' || format('{{:g}}', d) || '-second trimmed video segment.' end end as description from sf"""
)

_CUES = [
    ("INTERVAL", r"(?:between\s+<time>\s+and\s+<time>)|(?:from\s+<time>\s*(?:-|to|until|through(?:\s+to)?)\s*<time>)"),
    ("TWO_ANCHOR", None),
    ("PREFIX_STATE", r"(?:considering\s+all\s+prior)|(?:by\s+(?:frame\s+)?<time>.*\b(?:remain|remains|remaining|left|present)\b)"),
    ("FORWARD_SEARCH", r"(?:\breappear\b.*\b(?:later|afterwards|subsequently)\b)|(?:\bdoes\s+(?:a\s+)?retrieval\b.*\bexist\b)|(?:\bwhen\s+(?:is|was)\s+it\s+retrieved\b)|(?:\bwhen\s+is\b.*\bseen\s+in\s+frame\s+<time>.*\blast\s+seen\b)"),
    ("BACKWARD_SEARCH", r"\bwhen\s+was\b.*\b(?:visible|seen)\b.*(?:frame\s+at|frame|at)\s+<time>.*\bfirst\s+(?:inserted|created)\b"),
    ("LOCAL_ANCHOR", r"\bfirst\s+occurs\b.*at\s+time\s+point\s+<time>"),
    ("GLOBAL", r"\b(?:before|after|later|earlier|first|last|prior|previous(?:ly)?|subsequent(?:ly)?|until|remain(?:s|ing)?|retriev\w*|reappear)\b"),
    ("LOCAL_ANCHOR", r"(?:\bat\s+(?:time\s+point\s+)?<time>)|(?:\bin\s+frame\s+<time>)"),
]
_INTENT = (
    f"""with {v.REQUESTS},
pi0 as (select *, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(question), 'ß', 'ss'), '[–—]', '-', 'g'), '\\btime[\\s-]*point\\b', 'time point', 'g'), '\\bre[\\s-]*appear\\b', 'reappear', 'g'), '\\s+', ' ', 'g')), '\\b\\d{{2}}:\\d{{2}}:\\d{{2}}\\b', '<time>', 'g') as t,
  regexp_extract_all(question, '\\b\\d{{2}}:\\d{{2}}:\\d{{2}}\\b') as found from rq),
pi1 as (select *, [x for x, i in found if list_position(found, x) = i] as anchor_texts from pi0),
pi2 as (select *, len(list_filter(anchor_texts, lambda x: split_part(x, ':', 2)::int > 59 or split_part(x, ':', 3)::int > 59)) > 0 as malformed,
  list_transform(anchor_texts, lambda x: {_SEC.format('x')}) as anchors from pi1),
pi as (select *, case when malformed then null when len(anchor_texts) = 0 then 'GLOBAL' """
    + " ".join(f"when len(anchor_texts) >= 2 then '{k}'" if p is None else f"when regexp_matches(t, '{p}') then '{k}'" for k, p in _CUES)
    + " else 'GLOBAL' end as intent from pi2)\n"
)


def _region(low: str, high: str, rate: float) -> str:
    """List of indices of a stretch of seconds that lies within the clip, low <= high."""
    n = f"(floor(({high} - {low}) / {1 / rate})::bigint)"
    return (
        f"(case when abs({low} - {high}) <= 1e-8 + 1e-5 * abs({high}) then [{v.rint_sql(low, 'fps', 'total_frames')}] else list_sort(list_distinct(list_concat("
        f"list_transform(range({n} + 1), lambda j_: {v.rint_sql(f'{low} + j_ * {1 / rate}', 'fps', 'total_frames')}), "
        f"case when {low} + {n} * {1 / rate} < {high} - 1e-9 then [{v.rint_sql(high, 'fps', 'total_frames')}] else []::bigint[] end))) end)"
    )


_UNION = "list_sort(list_distinct(list_concat({}, {})))"
#: One anchor a row: its surroundings, at most five frames and always its own.
_AROUND = f"""
ar0 as (select qid, fps, total_frames, unnest(range(len(rel))) as k, unnest(rel) as a, (total_frames - 1) / fps as last from pf2),
ar1 as (select *, {v.rint_sql('a', 'fps', 'total_frames')} as own, greatest(0.0, a - 1.0) as lo, least(last, a + 1.0) as hi from ar0),
ar2 as (select *, {_UNION.format(_region('lo', 'hi', 2.0), '[own]')} as w from ar1),
ar3 as (select *, list_filter(w, lambda x: x <> own) as rest from ar2),
ar as (select qid, k, case when len(w) <= 5 then w else {_UNION.format('[own]', v.cap_sql('rest', '4'))} end as w from ar3)"""
_M = str(MOST_PROCEDURE)
_PROCEDURE = (
    _INTENT
    + f""",{v.VIDEOS},
pf0 as (select pi.qid, intent, anchors, fps, total_frames, (total_frames - 1) / fps as last, greatest(1.0 / fps, 0.25) as tol from pi join vd using (video) where intent is not null),
pf1 as (select *, list_filter(anchors, lambda x: x >= -tol and x <= last + tol) as kept from pf0),
pf2 as (select *, list_transform(kept, lambda x: greatest(0.0, least(x, last))) as rel, case when len(kept) = 0 or (intent = 'INTERVAL' and len(kept) < 2) then 'GLOBAL' else intent end as used from pf1),{_AROUND},
al as (select qid, list_sort(list_distinct(flatten(list(w)))) as several, max(w) filter (where k = 0) as near from ar group by qid),
pf3 as (select pf2.*, several, near, case when used = 'FORWARD_SEARCH' then rel[1] when used = 'INTERVAL' then least(rel[1], rel[2]) else 0.0 end as lo,
  case when used in ('FORWARD_SEARCH', 'GLOBAL') then last when used = 'INTERVAL' then greatest(rel[1], rel[2]) else rel[1] end as hi from pf2 left join al using (qid)),
pf4 as (select *, case when used in ('TWO_ANCHOR', 'LOCAL_ANCHOR') then []::bigint[] else {_region('lo', 'hi', 1.0)} end as pool from pf3),
pf5 as (select *, {_UNION.format('near', v.cap_sql('pool', f'greatest(1, {_M} - len(near))'))} as sel from pf4),
pf6 as (select *, list_filter(pool, lambda x: not list_contains(sel, x)) as more from pf5),
pf7 as (select *, case when used in ('GLOBAL', 'INTERVAL') then {v.cap_sql('pool', _M)} when used = 'TWO_ANCHOR' then {v.cap_sql('several', _M)} when used = 'LOCAL_ANCHOR' then near
  when len(sel) >= {_M} then {v.cap_sql('sel', _M)} else {_UNION.format('sel', v.cap_sql('more', f'({_M} - len(sel))'))} end as s from pf6),
pf8 as (select *, list_transform(kept, lambda x: {v.clock_sql('x::bigint')}) as c, len(s)::varchar || ' chronologically ordered frames ' as n from pf7)
select qid, intent, used as used_intent, len(s) as n_frames, array_to_string(s, ',') as frames, n || case used
  when 'GLOBAL' then 'sampled for broad coverage across the supplied procedure-level video context.'
  when 'INTERVAL' then 'sampled across the explicit interval ' || c[1] || ' to ' || c[2] || '.'
  when 'TWO_ANCHOR' then 'sampled densely around the explicit comparison time points ' || array_to_string(c, ', ') || '.'
  when 'LOCAL_ANCHOR' then 'sampled densely around the explicit time point ' || c[1] || '.'
  when 'FORWARD_SEARCH' then 'combining dense sampling around ' || c[1] || ' with broad coverage from that point to the end of the supplied context.'
  when 'BACKWARD_SEARCH' then 'combining broad coverage from the start through ' || c[1] || ' with dense sampling around that time point.'
  else 'covering the supplied procedure history up to ' || c[1] || ', with denser sampling near that time point.' end as description from pf8"""
)

ORACLES = {
    "frame_plan": _PLAN + "select * from pl",
    "frame_plan_dedup": _PLAN + f", f as (select dataset, {_SLUG} || '_' || substr(sha1(dataset || '|' || video), 1, 12) as folder, file, count(*) as n from pl group by all) select dataset, sum(n)::bigint as n_references, count(*) as n_files, sum(n)::bigint - count(*) as n_saved, count(distinct folder) as n_folders from f group by dataset",
    "decode_jobs": _PLAN + ", d as (select distinct video, source_index, timestamp from pl), e as (select *, (row_number() over (partition by video order by source_index, timestamp) - 1) // 128 as batch from d) select video, batch, count(*) as n_frames, min(source_index) as first_index, max(source_index) as last_index from e group by video, batch",
    "segment_intent": _SEGMENT + "select qid, asked, mode, template_id, anchor_s, t1_s, t2_s, object_name from sg",
    "procedure_intent": _INTENT + "select qid, intent, array_to_string(anchor_texts, ',') as anchors, malformed from pi",
    "segment_frames": _SEGMENT_FRAMES,
    "procedure_frames": _PROCEDURE,
    "clip_violations": "select ''::varchar as qid, ''::varchar as rule, ''::varchar as track where false",
}
