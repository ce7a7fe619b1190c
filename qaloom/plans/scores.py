"""Scored reports and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import answers, capabilities
from qaloom.functions.text import as_double, as_whole, trimmed_lower, vkey
from qaloom.operators import contracts, evaluation, lookup
from qaloom.plans import views as v


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, qid): the drawn identifiers in order, each at its first place."""
    ids = v.table(spark, sf, "selected_qids").select("pos", trimmed_lower(F.col("qid")).alias("qid")).where("qid is not null and pos is not null")
    return ids.groupBy("qid").agg(F.min("pos").alias("pos"))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return v.results(spark, sf).withColumn("capability_group", capabilities.group(F.col("capability_group")))


def selected_join(spark: SparkSession, sf: str) -> DataFrame:
    """Selected questions in order with request and response."""
    joined = lookup.in_order(_selected(spark, sf), v.requests(spark, sf).select("qid", "video", "question"), "qid")
    both = joined.join(v.answers(spark, sf).select("qid", "answer", "response_id"), "qid", "left")
    return both.select("pos", "qid", "video", "question", "answer", "response_id")


def detailed_results(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with place among the drawn ones, request, reference, response, official score and log cells, '' or null where the log has no row."""
    scores = _rows(spark, sf).select("qid", "dataset", "reference_answer", "answer_format", "scoring_method", "primary_capability", "primary_capability_value", "capability_group", "ood", "clinical", "format_valid", "timed_out", "correctness")
    log = v.inference_log(spark, sf).where(F.lower(F.trim("status")) != "failed")
    secondary = v.table(spark, sf, "train_sft").where("qid is not null").groupBy("qid").agg(F.min(capabilities.joined_codes(F.col("metadata.secondary_capabilities"))).alias("secondary"))
    drawn = lookup.numbered(_selected(spark, sf), [], ["pos"], "selected_index").select("qid", (F.col("selected_index") + 1).alias("selected_index"))
    out = v.requests(spark, sf).select("qid", "video", "procedure", "start_time", "end_time", "question").join(scores, "qid")
    for other in (v.answers(spark, sf).select("qid", "answer", "latency"), log, secondary, drawn):
        out = out.join(other, "qid", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.round(as_double(F.col(c)), 6).alias(c)
    return out.select(
        "selected_index", "qid", "dataset", "video", F.col("procedure").alias("procedure_type"), F.col("start_time").alias("start_time_s"), F.col("end_time").alias("end_time_s"), "question", "reference_answer",
        F.coalesce("answer", F.lit("")).alias("candidate_answer"), F.coalesce("raw_answer", F.lit("")).alias("raw_model_answer"), "answer_format", "scoring_method", capabilities.code(F.col("primary_capability"), F.col("primary_capability_value")).alias("primary_capability"), "primary_capability_value",
        "capability_group", F.coalesce("secondary", F.lit("")).alias("secondary_capabilities"), "ood", "clinical", "format_valid", answers.format_error(F.col("format_valid"), F.col("answer_format")).alias("format_error"), F.coalesce("latency", F.lit(0.0)).alias("latency_s"), "timed_out", "correctness",
        F.coalesce("status", F.lit("")).alias("inference_status"), number("model_inference_s"), number("source_fps"), number("clip_duration_s"), as_whole(F.col("num_frames")).alias("num_frames"), as_whole(F.col("num_patches")).alias("num_patches"), number("peak_gpu_memory_gb"),
        text("first_absolute_timestamp"), text("last_absolute_timestamp"),
    )


def bucket_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.in_given_order(evaluation.buckets(_rows(spark, sf)), "capability_group", list(capabilities.GROUPS))


SETS = {"format": ["answer_format", "scoring_method"], "leaf": ["primary_capability", "primary_capability_value", "capability_group"], "dataset": ["dataset"], "procedure": ["procedure_type"], "status": ["inference_status"]}


def score_sets(spark: SparkSession, sf: str) -> DataFrame:
    """All group summaries in one pass."""
    return evaluation.scored_sets(_rows(spark, sf), SETS)


def _one_set(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return evaluation.scored(_rows(spark, sf), SETS[name])

    return query


def macro_micro(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return evaluation.overall(rows, evaluation.buckets(rows))


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.value_counts(_rows(spark, sf), ["dataset", "answer_format", "scoring_method", "capability_group", "ood", "inference_status"])


def bucket_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of the known groups, in distribution, that don't have exactly 200 questions."""
    rows = _rows(spark, sf).where("not ood")
    return contracts.wrong_counts(rows.withColumn("g", F.coalesce("capability_group", F.lit("none"))), "g", {g: 200 for g in capabilities.GROUPS}).select("rule", "key", "detail")


def wrong_or_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for the error reports."""
    rows = _rows(spark, sf).where("not format_valid or not correctness")
    return rows.select("qid", F.when(~F.col("format_valid"), "invalid_format").otherwise("incorrect").alias("report"), "reference_answer", "candidate_answer")


def error_heads(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty wrong answers by qid: a report's excerpt."""
    return wrong_or_invalid(spark, sf).select("qid", "report").orderBy("qid", "report").limit(20)


def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Questions without a response, and responses of no question."""
    r, a = v.table(spark, sf, "request").select("qid"), v.table(spark, sf, "responses").select("qid")
    return contracts.united(contracts.missing_keys(r, a, "qid", "no_response"), contracts.missing_keys(a, r, "qid", "unknown_question"))


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of more than one row, per table."""
    of = lambda name, key: contracts.repeated_keys(v.table(spark, sf, name).select(key), key, name)
    return contracts.united(of("request", "qid"), of("responses", "response_id"), of("train_sft", "sample_id"), of("selected_qids", "qid"))


def key_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Scored questions against answered ones, both ways."""
    return contracts.key_difference(v.table(spark, sf, "detailed_results"), v.table(spark, sf, "responses"), "qid")


def video_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Names of videos in the corpus, found among those of requests: exactly, but for letter case, or by number."""
    names = v.table(spark, sf, "documents").select("videoid").where("videoid is not null").distinct()
    files = v.table(spark, sf, "request").select(vkey(F.col("videoid")).alias("f")).where("f is not null").distinct()
    return lookup.resolve(names, "videoid", files, "f")


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand questions in a seeded order that no layout changes."""
    r = v.table(spark, sf, "request").select("qid").where("qid is not null").distinct()
    return r.select("qid", lookup.seeded_order("qid", 50).alias("place")).orderBy("place", "qid").limit(1000)


QUERIES = {
    "selected_join": selected_join, "detailed_results": detailed_results, "bucket_scores": bucket_scores, "score_sets": score_sets, **{f"{n}_scores": _one_set(n) for n in SETS}, "macro_micro": macro_micro, "value_counts": value_counts, "bucket_contract": bucket_contract,
    "wrong_or_invalid": wrong_or_invalid, "error_heads": error_heads, "missing_keys": missing_keys, "repeated_keys": repeated_keys, "key_differences": key_differences, "video_resolve": video_resolve, "seeded_sample": seeded_sample,
}

# --- SQL ------------------------------------------------------------------------

_TOKEN = "trim(regexp_replace(lower(trim(capability_group)), '[^a-z0-9]+', '_', 'g'), '_')"
_GROUP = f"(case when contains({_TOKEN}, 'object_recognition') then 'object_recognition' when contains({_TOKEN}, 'temporal_grounding') then 'temporal_grounding' when {_TOKEN} = 'aggregation' or suffix({_TOKEN}, '_aggregation') then 'aggregation' when contains({_TOKEN}, 'event_understanding') or contains({_TOKEN}, 'event_and_procedural_understanding') then 'event_understanding' when contains({_TOKEN}, 'complex_reasoning') then 'complex_reasoning' end)"
_ROWS = f"with {v.RESULTS}, sr as (select * replace ({_GROUP} as capability_group) from rs)\n"
_SCORED = "coalesce(sum(correctness::int), 0)::bigint as correct, count(*) as count, avg(coalesce(correctness::int, 0)) as accuracy"
_BUCKETS = f", bk as (select concat_ws('_', case when ood then 'ood' else 'id' end, coalesce(capability_group, 'none')) as bucket_name, capability_group, case when ood then 'ood' else 'id' end as distribution, {_SCORED} from sr group by all)\n"
_LOWQ = r"nullif(lower(regexp_replace(qid, '^\s+|\s+$', '', 'g')), '')"
_KEY = lambda columns: "concat_ws('|', " + ", ".join(f"coalesce({c}::varchar, '')" for c in columns) + ")"
_VALUES = ("dataset", "answer_format", "scoring_method", "capability_group", "ood", "inference_status")

ORACLES = {
    "selected_join": f"with {v.REQUESTS},{v.ANSWERS}, s as (select {_LOWQ} as qid, min(pos) as pos from selected_qids where {_LOWQ} is not null and pos is not null group by 1) select pos, qid, video, question, answer, response_id from s join rq using (qid) left join an using (qid)",
    "detailed_results": _ROWS + f""", {v.REQUESTS},{v.ANSWERS},{v.FULL_LOG},
 sc as (select qid, min(coalesce(array_to_string(metadata.secondary_capabilities, ';'), '')) as secondary from train_sft where qid is not null group by qid),
 dr as (select qid, row_number() over (order by pos) as selected_index from (select {_LOWQ} as qid, min(pos) as pos from selected_qids where {_LOWQ} is not null and pos is not null group by 1))
 select selected_index, rq.qid, sr.dataset, rq.video, rq.procedure as procedure_type, rq.start_time as start_time_s, rq.end_time as end_time_s, rq.question, reference_answer, coalesce(an.answer, '') as candidate_answer, coalesce(raw_answer, '') as raw_model_answer, answer_format, scoring_method,
  coalesce(nullif(primary_capability, ''), map {{{', '.join(f"'{k}': '{c}'" for k, c in capabilities.CODES.items())}}}[primary_capability_value], primary_capability_value) as primary_capability, primary_capability_value, capability_group, coalesce(secondary, '') as secondary_capabilities, ood, clinical, format_valid,
  case when format_valid then '' else 'not in the format ' || coalesce(answer_format, '(none)') end as format_error, coalesce(an.latency, 0.0) as latency_s, timed_out, correctness, coalesce(fl.status, '') as inference_status, round(try_cast(nullif(model_inference_s, '') as double), 6) as model_inference_s,
  round(try_cast(nullif(source_fps, '') as double), 6) as source_fps, round(try_cast(nullif(clip_duration_s, '') as double), 6) as clip_duration_s, try_cast(nullif(num_frames, '') as bigint) as num_frames, try_cast(nullif(num_patches, '') as bigint) as num_patches, try_cast(nullif(peak_gpu_memory_gb, '') as double) as peak_gpu_memory_gb,
  coalesce(first_absolute_timestamp, '') as first_absolute_timestamp, coalesce(last_absolute_timestamp, '') as last_absolute_timestamp
 from rq join sr using (qid) left join an using (qid) left join fl on fl.qid = rq.qid and lower(trim(fl.status)) <> 'failed' left join sc on sc.qid = rq.qid left join dr on dr.qid = rq.qid""",
    "bucket_scores": _ROWS + _BUCKETS + "select * from bk",
    "score_sets": _ROWS + " union all ".join(f"select '{n}' as report, {_KEY(c)} as key, {_SCORED} from sr group by {_KEY(c)}" for n, c in SETS.items()),
    **{f"{n}_scores": _ROWS + f"select {', '.join(c)}, {_SCORED} from sr group by all" for n, c in SETS.items()},
    "macro_micro": _ROWS + _BUCKETS + """select count(*) as n, coalesce(sum(correctness::int), 0)::bigint as n_correct, count(*) filter (where not correctness) as n_incorrect, count(*) filter (where not format_valid) as n_invalid_format, count(*) filter (where regexp_replace(coalesce(candidate_answer, ''), '@WS@+', '', 'g') = '') as n_blank, count(*) filter (where timed_out) as n_timed_out,
 avg(correctness::int) as micro, avg(correctness::int) filter (where scoring_method = 'llm_judge') as judged_accuracy, count(*) filter (where scoring_method = 'llm_judge') as n_judged, avg(correctness::int) filter (where scoring_method = 'deterministic') as fixed_accuracy, count(*) filter (where scoring_method = 'deterministic') as n_fixed, avg(latency_s) as mean_latency_s, (select avg(accuracy) from bk) as macro from sr""",
    "value_counts": _ROWS + " union all ".join(f"select '{c}' as \"column\", coalesce({c}::varchar, '') as value, count(*) as count from sr group by 2" for c in _VALUES),
    "bucket_contract": _ROWS + f""", w as (select unnest([{', '.join(repr(g) for g in capabilities.GROUPS)}]) as key, 200 as want), h as (select coalesce(capability_group, 'none') as key, count(*) as have from sr where not ood group by 1)
 select case when want is null then 'unexpected_group' when have is null then 'missing_group' else 'wrong_count' end as rule, key, coalesce(have, 0)::varchar || ' of ' || coalesce(want, 0)::varchar as detail from w full join h using (key) where have is distinct from want""",
    "wrong_or_invalid": _ROWS + "select qid, case when not format_valid then 'invalid_format' else 'incorrect' end as report, reference_answer, candidate_answer from sr where not format_valid or not correctness",
    "error_heads": _ROWS + "select qid, case when not format_valid then 'invalid_format' else 'incorrect' end as report from sr where not format_valid or not correctness order by 1, 2 limit 20",
    "missing_keys": "select distinct 'no_response' as rule, qid as key, '' as detail from request where qid is not null and qid not in (select qid from responses where qid is not null) union all select distinct 'unknown_question', qid, '' from responses where qid is not null and qid not in (select qid from request where qid is not null)",
    "repeated_keys": " union all ".join(f"select '{t}' as rule, {k}::varchar as key, count(*)::varchar as detail from {t} group by {k} having count(*) > 1" for t, k in (("request", "qid"), ("responses", "response_id"), ("train_sft", "sample_id"), ("selected_qids", "qid"))),
    "key_differences": "with l as (select distinct qid from detailed_results where qid is not null), r as (select distinct qid from responses where qid is not null) select 'only_left' as rule, qid as key, '' as detail from l where qid not in (from r) union all select 'only_right', qid, '' from r where qid not in (from l)",
    "video_resolve": rf"""with n as (select distinct videoid from documents where videoid is not null), f as (select distinct {v.VKEY.format('videoid')} as f from request where {v.VKEY.format('videoid')} is not null),
 c as (select lower(f) as k, min(f) as f_case from f group by 1), p as (select regexp_extract(f, '^(\d{{4}})\b', 1) as k, min(f) as f_prefix, count(*) as n_prefix from f where regexp_extract(f, '^(\d{{4}})\b', 1) <> '' group by 1)
 select videoid, coalesce(f.f, f_case, case when n_prefix = 1 then f_prefix end) as file, case when f.f is not null then 'exact' when f_case is not null then 'case' when n_prefix = 1 then 'prefix' when n_prefix > 1 then 'ambiguous' else 'missing' end as how
 from n left join f on f.f = videoid left join c on c.k = lower(videoid) left join p on p.k = nullif(regexp_extract(videoid, '^(\d{{4}})\b', 1), '')""",
}
ORACLES["seeded_sample"] = "select qid, md5(qid || ':50') as place from (select distinct qid from request where qid is not null) order by place, qid limit 1000"
ORACLES = v.with_white_space(ORACLES)
