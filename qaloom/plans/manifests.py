"""Manifests, training records, their rules and summaries, and resuming runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import capabilities, prompts
from qaloom.functions.text import blank, trimmed_lower
from qaloom.functions.timecode import hhmmss, rint_index
from qaloom.operators import contracts, lookup, providers, resume
from qaloom.operators.frames import planned_times
from qaloom.plans import views as v


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Training records each once, with split and dataset made uniform."""
    rows = v.table(spark, sf, "train_sft").where("sample_id is not null").select("sample_id", "qid", trimmed_lower(F.col("dataset")).alias("dataset"), trimmed_lower(F.col("split")).alias("split"), "num_frames", "user_text", "assistant_text", "images", "frame_labels", "metadata").distinct()
    return rows


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the windows of their questions and the times to look at; joined first, so only what is needed is planned."""
    windows = v.request_frames(spark, sf).drop("dataset")
    rows = _samples(spark, sf).select("sample_id", "qid", "dataset", "split", "metadata", "assistant_text").join(windows, "qid")
    return planned_times(v.spread(rows, "sample_id"))


def manifest_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest as plain cells: lists as JSON text."""
    m = _manifest(spark, sf)
    code = F.col("metadata.primary_capability")
    return m.select(
        "sample_id", "qid", F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce("split", F.lit("")).alias("split"), "video", F.round(F.col("end_time") - F.col("start_time"), 6).alias("duration_s"), F.col("metadata.candidate_count_1fps").alias("candidate_count"),
        F.size("times").cast("bigint").alias("n_frames"), F.to_json(F.transform("times", lambda t: hhmmss(F.col("start_time") + t))).alias("timestamps"), F.to_json(F.transform("times", lambda t: rint_index(F.col("start_time") + t, F.col("fps"), F.col("total_frames")))).alias("source_indices"),
        code.alias("capability"), capabilities.code_group(code).alias("capability_digit"), capabilities.joined_codes(F.col("metadata.secondary_capabilities")).alias("secondary"), F.coalesce("metadata.ood", F.lit(False)).alias("ood"),
    )


def sft_records(spark: SparkSession, sf: str) -> DataFrame:
    """Training records from the manifest: image lines, prompt and answer, as digests."""
    m = _manifest(spark, sf)
    user = F.concat(prompts.image_prefix(prompts.absolute_labels(F.col("start_time"), F.col("times"))), prompts.request_prompt(F.col("procedure"), F.col("question")))
    m = m.withColumn("user", user)
    return m.select("sample_id", F.size("times").cast("bigint").alias("num_frames"), F.sha2("user", 256).alias("user_digest"), F.char_length("user").cast("bigint").alias("user_chars"), F.coalesce("assistant_text", F.lit("")).alias("assistant_text"), F.coalesce("metadata.answer_format", F.lit("")).alias("answer_format"))


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Records per dataset and split, and of all evaluation splits together."""
    rows = _samples(spark, sf).select(F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce("split", F.lit("")).alias("split"))
    both = rows.unionByName(rows.where("split in ('val', 'test')").withColumn("split", F.lit("all_eval")))
    return both.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n_records"))


def smoke_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the first four videos of each dataset and split."""
    rows = _samples(spark, sf).select("sample_id", "qid", "dataset", "split").join(v.requests(spark, sf).select("qid", "video"), "qid")
    return lookup.first_groups(rows, ["dataset", "split"], "video", 4).select("sample_id", "dataset", "split", "video")


def plan_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that can't be planned, and windows that reach beyond their video."""
    r = v.table(spark, sf, "request").select("qid", "videoid", "start_time", "end_time", "question").distinct()
    rules = contracts.window_rules() | {"blank_question": blank(F.col("question")), "no_video": blank(F.col("videoid")), "blank_key": blank(F.col("qid"))}
    own = contracts.broken(r, F.col("qid"), rules)
    beyond = contracts.broken(v.request_frames(spark, sf), F.col("qid"), {"beyond_video": F.col("end_time") > (F.col("total_frames") / F.col("fps")) + 1.0})
    return contracts.united(own, beyond).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n_rows"))


def sft_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that training records break."""
    return contracts.broken(_samples(spark, sf), F.col("sample_id"), contracts.sample_rules()).select("rule", "key")


def frame_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of the one-image track: its window has no length, which only warns."""
    r = v.table(spark, sf, "request").select("qid", "start_time", "end_time", "question").distinct()
    found = contracts.broken(r, F.col("qid"), {"blank_key": blank(F.col("qid")), "blank_question": blank(F.col("question")), "negative_start": F.coalesce(F.col("start_time") < 0, F.lit(False)), "has_length": F.coalesce(F.col("end_time") != F.col("start_time"), F.lit(False))})
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select("rule", F.when(F.col("rule") == "has_length", "warning").otherwise("error").alias("severity"), "n")


def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per dataset: frames and seconds, least, most, mean and median."""
    m = v.requests(spark, sf).withColumn("d", F.col("end_time") - F.col("start_time")).withColumn("n", F.least(F.lit(32), F.greatest(F.lit(1), F.ceil(F.col("d") - 1e-9))).cast("bigint"))
    return m.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n").alias("n_frames"), F.min("n").alias("min_frames"), F.max("n").alias("max_frames"), F.avg("n").alias("mean_frames"), F.median("n").alias("median_frames"), F.min("d").alias("min_s"), F.max("d").alias("max_s"), F.round(F.avg("d"), 6).alias("mean_s"), F.round(F.median("d"), 6).alias("median_s"))


def record_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per split: records, frames, lengths of texts."""
    r = _samples(spark, sf)
    return r.groupBy(F.coalesce("split", F.lit("")).alias("split")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("num_frames").alias("n_frames"), F.min("num_frames").alias("min_frames"), F.max("num_frames").alias("max_frames"), F.avg("num_frames").alias("mean_frames"), F.max(F.char_length("user_text")).cast("bigint").alias("longest_text"), F.sum(F.aggregate("images", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))).alias("path_chars"))


def short_first(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred records with the fewest frames: a training smoke run."""
    return _samples(spark, sf).select("sample_id", "num_frames").orderBy("num_frames", "sample_id").limit(100)


def gradient_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of six records of a video in order, as gradients are accumulated."""
    rows = _samples(spark, sf).select("sample_id", "qid", "num_frames").join(v.requests(spark, sf).select("qid", "video"), "qid")
    return lookup.chunked(rows, "video", ["sample_id"], 6).groupBy("video", "chunk").agg(F.count(F.lit(1)).alias("n_records"), F.sum("num_frames").alias("n_frames"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"))


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    return resume.pending(v.requests(spark, sf).select("qid", "video"), v.answers(spark, sf), v.log(spark, sf))


def failed_rows(spark: SparkSession, sf: str) -> DataFrame:
    log = v.log(spark, sf)
    a = resume.failed(log).withColumn("list", F.lit("failed"))
    return a.unionByName(resume.not_successful(log).select("qid", "error_type", "latency").withColumn("list", F.lit("not_successful")))


def prediction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return resume.summary(v.requests(spark, sf), v.log(spark, sf)).withColumn("mean_latency_s", F.round("mean_latency_s", 6))


def ordered_responses(spark: SparkSession, sf: str) -> DataFrame:
    """All requests in order of their selection with response or default."""
    from qaloom.plans.scores import _selected
    from qaloom.sources.sinks import ordered_responses as ordered

    return ordered(_selected(spark, sf), v.answers(spark, sf))


def default_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = resume.with_defaults(v.requests(spark, sf).select("qid"), v.answers(spark, sf).select("qid", "answer", "latency"))
    return rows.groupBy((F.col("answer") == "").alias("blank")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency"), 3).alias("latency_s"))


def log_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows as text cells."""
    from qaloom.sources.sinks import prediction_log

    r = v.results(spark, sf).select("qid", "latency_s", "start_time_s", "timed_out", "inference_status")
    return prediction_log(r)


def lr_patience(spark: SparkSession, sf: str) -> DataFrame:
    """Learning rates of made-up runs: one per supplier nation, losses from account balances in order of key."""
    s = v.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("epoch"), F.col("s_acctbal").alias("loss"))
    out = resume.learning_rates(s, 1.0)
    return out.select("run", "epoch", "loss", "improved", F.col("stale").cast("bigint").alias("stale"), F.round("rate", 9).alias("rate"))


def provider_null(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the provider that has no model."""
    return providers.answered(v.requests(spark, sf).select("qid", "question"), ["question"]).drop("latency")


QUERIES = {
    "manifest_flat": manifest_flat, "sft_records": sft_records, "split_counts": split_counts, "smoke_subset": smoke_subset, "plan_violations": plan_violations, "sft_violations": sft_violations, "frame_requests": frame_requests, "plan_summary": plan_summary, "record_summary": record_summary,
    "short_first": short_first, "gradient_groups": gradient_groups, "resume_pending": resume_pending, "failed_rows": failed_rows, "prediction_summary": prediction_summary, "ordered_responses": ordered_responses, "default_responses": default_responses, "log_cells": log_cells, "lr_patience": lr_patience, "provider_null": provider_null,
}

# --- SQL ------------------------------------------------------------------------

_LOW = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"
_SAMPLES = f"sm as (select distinct sample_id, qid, {_LOW.format('dataset')} as dataset, {_LOW.format('split')} as split, num_frames, user_text, assistant_text, images, frame_labels, metadata from train_sft where sample_id is not null)"
_LOWQ = _LOW.format("qid")
_MANIFEST = f"""with {v.REQUESTS},{v.VIDEOS},{_SAMPLES},
mf0 as (select rq.*, fps, total_frames, range(greatest(1, ceil((end_time - start_time) - 1e-9)::bigint)) as t from rq join vd using (video)),
mf1 as (select *, {v.cap_sql('t', '32')} as c from mf0),
mf as (select sample_id, sm.qid, sm.dataset, sm.split, metadata, assistant_text, video, start_time, end_time, question, procedure, [{v.clock_sql('floor(start_time + x)::bigint')} for x in c] as stamps, [{v.rint_sql('start_time + x', 'fps', 'total_frames')} for x in c] as indices from sm join mf1 using (qid))
"""
_DONE = ", lo as (select qid, max((lower(trim(status)) = 'success')::int) as ok from lg group by qid), dn as (select distinct qid from an full join lo using (qid) where coalesce(ok, -1) = 1 or (ok is null and regexp_replace(coalesce(answer, ''), '@WS@+', '', 'g') <> ''))"
_RULES = {
    "blank_user_text": "regexp_replace(coalesce(user_text, ''), '@WS@+', '', 'g') = ''", "blank_assistant_text": "regexp_replace(coalesce(assistant_text, ''), '@WS@+', '', 'g') = ''", "image_count": "len(images) <> num_frames", "label_count": "len(frame_labels) <> num_frames", "mark_count": "(length(user_text) - length(replace(user_text, '<image>', ''))) / 7 <> num_frames",
    "labels_not_increasing": "len([x for x, i in frame_labels if i > 1 and frame_labels[i - 1] >= x]) > 0", "malformed_label": r"len([x for x in frame_labels if not regexp_full_match(x, '\d{2,}:[0-5]\d:[0-5]\d')]) > 0", "repeated_image": "len(list_distinct(images)) <> len(images)",
}
_WINDOW = {
    "missing_window": "start_time is null or end_time is null or isnan(start_time) or isnan(end_time)", "empty_window": "not isnan(start_time) and not isnan(end_time) and end_time = start_time", "reversed_window": "not isnan(start_time) and not isnan(end_time) and end_time < start_time",
    "negative_start": "not isnan(start_time) and not isnan(end_time) and start_time < 0", "window_too_long": "not isnan(start_time) and not isnan(end_time) and end_time - start_time > 300.001",
    "blank_question": "regexp_replace(coalesce(question, ''), '@WS@+', '', 'g') = ''", "no_video": "regexp_replace(coalesce(videoid, ''), '@WS@+', '', 'g') = ''", "blank_key": "regexp_replace(coalesce(qid, ''), '@WS@+', '', 'g') = ''",
}

ORACLES = {
    "manifest_flat": _MANIFEST + "select sample_id, qid, coalesce(dataset, '') as dataset, coalesce(split, '') as split, video, round(end_time - start_time, 6) as duration_s, metadata.candidate_count_1fps as candidate_count, len(stamps) as n_frames, to_json(stamps)::varchar as timestamps, to_json(indices)::varchar as source_indices, metadata.primary_capability as capability, substr(metadata.primary_capability, 1, 1) as capability_digit, coalesce(array_to_string(metadata.secondary_capabilities, ';'), '') as secondary, coalesce(metadata.ood, false) as ood from mf",
    "sft_records": _MANIFEST + f", u as (select *, array_to_string([x || ': <image>' || chr(10) for x in stamps], '') || 'Current request:' || chr(10) || 'Procedure type: ' || coalesce(procedure, 'Unknown') || chr(10) || 'Question: ' || regexp_replace(question, '^@WS@+|@WS@+$', '', 'g') || chr(10) || 'Answer:' as user from mf) select sample_id, len(stamps) as num_frames, sha256(user) as user_digest, length(user) as user_chars, coalesce(assistant_text, '') as assistant_text, coalesce(metadata.answer_format, '') as answer_format from u",
    "split_counts": f"with {_SAMPLES}, r as (select coalesce(dataset, '') as dataset, coalesce(split, '') as split from sm) select dataset, split, count(*) as n_records from (from r union all select dataset, 'all_eval' from r where split in ('val', 'test')) group by all",
    "smoke_subset": f"with {v.REQUESTS},{_SAMPLES}, r as (select sample_id, sm.dataset, split, video from sm join rq using (qid)), g as (select distinct dataset, split, video from r), k as (select *, row_number() over (partition by dataset, split order by video) as n from g) select r.* from r join k using (dataset, split, video) where n <= 4",
    "plan_violations": f"with {v.REQUESTS},{v.VIDEOS}, d as (select distinct qid, videoid, start_time, end_time, question from request), b as ({' union all '.join(f'select {chr(39)}{k}{chr(39)} as rule, qid as key from d where {c}' for k, c in _WINDOW.items())} union all select 'beyond_video', qid from rq join vd using (video) where end_time > total_frames / fps + 1.0) select rule, key, count(*) as n_rows from b group by all",
    "sft_violations": f"with {_SAMPLES} " + " union all ".join(f"select '{k}' as rule, sample_id as key from sm where {c}" for k, c in _RULES.items()),
    "frame_requests": "with d as (select distinct qid, start_time, end_time, question from request), b as (select 'blank_key' as rule from d where regexp_replace(coalesce(qid, ''), '@WS@+', '', 'g') = '' union all select 'blank_question' from d where regexp_replace(coalesce(question, ''), '@WS@+', '', 'g') = '' union all select 'negative_start' from d where start_time < 0 union all select 'has_length' from d where end_time <> start_time) select rule, case when rule = 'has_length' then 'warning' else 'error' end as severity, count(*) as n from b group by rule",
    "plan_summary": f"with {v.REQUESTS}, m as (select *, end_time - start_time as d, least(32, greatest(1, ceil(end_time - start_time - 1e-9)))::bigint as n from rq) select dataset, count(*) as n_requests, sum(n)::bigint as n_frames, min(n) as min_frames, max(n) as max_frames, avg(n) as mean_frames, median(n) as median_frames, min(d) as min_s, max(d) as max_s, round(avg(d), 6) as mean_s, round(median(d), 6) as median_s from m group by dataset",
    "record_summary": f"with {_SAMPLES} select coalesce(split, '') as split, count(*) as n_records, sum(num_frames)::bigint as n_frames, min(num_frames) as min_frames, max(num_frames) as max_frames, avg(num_frames) as mean_frames, max(length(user_text)) as longest_text, sum(length(array_to_string(images, '')))::bigint as path_chars from sm group by 1",
    "short_first": f"with {_SAMPLES} select sample_id, num_frames from sm order by num_frames, sample_id limit 100",
    "gradient_groups": f"with {v.REQUESTS},{_SAMPLES}, r as (select sample_id, num_frames, video from sm join rq using (qid)), k as (select *, (row_number() over (partition by video order by sample_id) - 1) // 6 as chunk from r) select video, chunk, count(*) as n_records, sum(num_frames)::bigint as n_frames, min(sample_id) as first_id, max(sample_id) as last_id from k group by all",
    "resume_pending": f"with {v.REQUESTS},{v.ANSWERS},{v.RESULTS},{v.LOG}{_DONE} select qid, video from rq where qid not in (select qid from dn where qid is not null)",
    "failed_rows": f"with {v.RESULTS},{v.LOG} select qid, error_type, latency, 'failed' as list from lg where lower(trim(status)) = 'failed' union all select qid, error_type, latency, 'not_successful' from lg where lower(trim(status)) <> 'success'",
    "prediction_summary": f"with {v.REQUESTS},{v.RESULTS},{v.LOG} select count(*) as n, count(*) filter (where lower(trim(status)) = 'success') as n_success, count(*) filter (where lower(trim(status)) = 'failed') as n_failed, count(*) filter (where status is null) as n_unprocessed, round(avg(try_cast(nullif(latency, '') as double)) filter (where lower(trim(status)) = 'success'), 6) as mean_latency_s from rq left join lg using (qid)",
    "ordered_responses": f"with {v.ANSWERS}, s as (select {_LOWQ} as qid, min(pos) as pos from selected_qids where {_LOWQ} is not null and pos is not null group by 1) select pos, qid, coalesce(answer, '') as content, coalesce(latency, 0.0) as latency from s left join an using (qid)",
    "default_responses": f"with {v.REQUESTS},{v.ANSWERS} select coalesce(answer, '') = '' as blank, count(*) as n, round(sum(coalesce(latency, 0.0)), 3) as latency_s from rq left join an using (qid) group by 1",
    "log_cells": f"with {v.RESULTS} select qid, coalesce(format('{{:.6f}}', latency_s), '') as latency_s, coalesce(format('{{:.6f}}', start_time_s), '') as start_time_s, coalesce(timed_out::varchar, '') as timed_out, coalesce(inference_status, '') as inference_status from rs",
    "lr_patience": """with recursive e as (select s_nationkey as run, s_suppkey as epoch, s_acctbal as loss, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier),
 f as (select run, epoch, loss, n, true as improved, 0::bigint as stale, 1.0::double as rate, loss as best from e where n = 1
  union all select e.run, e.epoch, e.loss, e.n, e.loss < best, case when e.loss < best then 0 when stale + 1 >= 3 then 0 else stale + 1 end, case when e.loss < best then rate when stale + 1 >= 3 then rate * 0.8 else rate end, least(best, e.loss) from f join e on e.run = f.run and e.n = f.n + 1)
 select run, epoch, loss, improved, stale, round(rate, 9) as rate from f""",
    "provider_null": f"with {v.REQUESTS} select qid, '' as answer, 'success' as status, '' as error_type, '' as error_message from rq",
}
ORACLES = v.with_white_space(ORACLES)
