"""Domain views over the tables, in Spark and as SQL text.

Every view names only the columns it needs, so scans read only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions.text import label, vkey
from qaloom.functions.timecode import hhmmss
from qaloom.operators.intents import window_valid

LONGEST_WINDOW_S = 300.001


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


BYTES_A_PART = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """The one exchange by an even key that an aggregation needs anyway, over all cores.

    Rows here are small but each costs much arithmetic later on; a number of
    partitions that is asked for isn't merged to a few by their bytes.  It grows
    with the estimated size of the rows.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, min(size // BYTES_A_PART, 200_000)), key)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each question with a video, a sound window and a text: qid, dataset, video, start_time, end_time, question, procedure."""
    r = table(spark, sf, "request").select("qid", vkey(F.col("videoid")).alias("video"), "start_time", "end_time", trimmed(F.col("question")).alias("question"), label(F.col("procedure_type")).alias("procedure"))
    r = r.where("qid is not null and video is not null and question <> ''").where(window_valid(F.col("start_time"), F.col("end_time")))
    r = spread(r, "qid").groupBy("qid").agg(*(F.min(c).alias(c) for c in ("video", "start_time", "end_time", "question", "procedure")))
    return r.withColumn("dataset", F.element_at(F.split("qid", "_"), 1))


def videos(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each video: video, duration_s, fps, total_frames.  Rates come from the name, as no table holds them.

    A video is as long as its last sound window, of any row: so this reads three
    columns and exchanges one partial maximum a video and task.
    """
    r = table(spark, sf, "request").where(window_valid(F.col("start_time"), F.col("end_time"))).select(vkey(F.col("videoid")).alias("video"), "end_time")
    r = r.where("video is not null").groupBy("video").agg(F.max("end_time").alias("duration_s"))
    r = r.withColumn("fps", F.when(F.length("video") % 2 == 0, F.lit(25.0)).otherwise(F.lit(29.97)))
    return r.withColumn("total_frames", F.floor((F.col("duration_s") + 1) * F.col("fps")).cast("bigint"))


def request_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with their video's rate and length."""
    return requests(spark, sf).join(videos(spark, sf), "video")


def template_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with their own question (``asked`` real) and one of the special templates by the last digit of the qid (``asked`` template), and a clip of their own window."""
    r = requests(spark, sf)
    clock = lambda c: F.format_string("%02d:%02d:%02d", F.floor(c / 3600).cast("bigint"), F.floor(c % 3600 / 60).cast("bigint"), c % 60)
    start, end = F.floor("start_time").cast("bigint"), F.floor("end_time").cast("bigint")
    digit = F.right("qid", F.lit(1)).try_cast("int")
    t1, t2 = clock(start + 1), clock(F.greatest(start + 2, end - 3))
    middle = clock(F.floor((start + end) / 2).cast("bigint"))
    # fixed values: sentences of the special templates
    text = (
        F.when(digit <= 2, F.concat(F.lit("What types of foreign objects are seen between "), t1, F.lit(" and "), t2, F.lit("? Please provide the class name(s) or answer none.")))
        .when(digit <= 4, F.concat(F.lit("There is one Specimen Bag in the frame at "), middle, F.lit(". When is it retrieved from the surgical site? Please provide the answer in hh:mm:ss.")))
        .when(digit <= 6, F.concat(F.lit("Does the Needle, last visible just before "), middle, F.lit(", re-appear later in the video? Please answer with yes or no.")))
        .when(digit == 7, F.concat(F.lit("Does the Needle, last visible just before "), clock(end + 5), F.lit(", re-appear later in the video? Please answer with yes or no.")))
    )
    both = F.filter(F.array(F.struct(F.lit("real").alias("asked"), F.col("question").alias("question")), F.struct(F.lit("template").alias("asked"), text.alias("question"))), lambda x: x["question"].isNotNull())
    clip = r.withColumn("both", F.explode(both)).withColumn("asked", F.col("both.asked")).withColumn("question", F.col("both.question")).drop("both").withColumn("fps", F.when(digit % 2 == 0, F.lit(25.0)).otherwise(F.lit(29.97)))
    return clip.withColumn("total_frames", F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("end_time") - F.col("start_time")) * F.col("fps")).cast("bigint")))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Scored questions, each row once."""
    return table(spark, sf, "detailed_results").distinct()


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """One response for each question: the first of several by response_id.  qid, answer, latency, response_id."""
    r = table(spark, sf, "responses").where("qid is not null and response_id is not null").select("qid", "response_id", "answer", "latency")
    return r.groupBy("qid").agg(F.min(F.struct("response_id", "answer", "latency")).alias("r")).select("qid", "r.answer", "r.latency", "r.response_id")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """The inference log: text cells as a CSV file has them, '' for what is missing."""
    r = results(spark, sf)
    return r.select("qid", F.coalesce("inference_status", F.lit("")).alias("status"), F.when(F.col("latency_s").isNotNull(), F.format_string("%.6f", "latency_s")).otherwise("").alias("latency"), F.when(F.col("timed_out"), "TimeoutError").otherwise("").alias("error_type"))


def inference_log(spark: SparkSession, sf: str) -> DataFrame:
    """The full log of a run as text cells, '' for what is missing: the frames and times of each question from its window."""
    start, end = F.col("start_time_s"), F.col("end_time_s")
    d = end - start
    sound = d.isNotNull() & ~F.isnan(d) & (d > 0)
    cell = lambda c: F.coalesce(c, F.lit(""))
    n = F.least(F.lit(32), F.greatest(F.lit(1), F.ceil(d - 1e-9)))
    return results(spark, sf).select(
        "qid", cell(F.col("inference_status")).alias("status"), cell(F.concat(F.lit("Answer: "), F.col("candidate_answer"))).alias("raw_answer"), cell(F.when(F.col("latency_s").isNotNull(), F.format_string("%.6f", "latency_s"))).alias("model_inference_s"),
        cell(F.when(F.col("videoid").isNotNull(), F.when(F.length("videoid") % 2 == 0, "25.0").otherwise("29.97"))).alias("source_fps"), cell(F.when(sound, F.format_string("%.6f", d))).alias("clip_duration_s"), cell(F.when(sound, n.cast("bigint").cast("string"))).alias("num_frames"),
        cell(F.when(sound, (n * 2).cast("bigint").cast("string"))).alias("num_patches"), F.lit("").alias("peak_gpu_memory_gb"), cell(F.when(sound, hhmmss(start))).alias("first_absolute_timestamp"), cell(F.when(sound, hhmmss(end))).alias("last_absolute_timestamp"),
    )


# --- the same as SQL ------------------------------------------------------------

LABEL = r"nullif(regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), '')"
VKEY = r"nullif(regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '')"
#: Class of white-space characters, also beyond ASCII.  SQL texts name it ``@WS@``, see ``with_white_space``.
WHITE_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def clock_sql(x: str) -> str:
    """Clock text of whole seconds."""
    return f"(lpad((({x}) // 3600)::varchar, greatest(2, length((({x}) // 3600)::varchar))::int, '0') || ':' || lpad((({x}) % 3600 // 60)::varchar, 2, '0') || ':' || lpad((({x}) % 60)::varchar, 2, '0'))"


REQUESTS = f"""
rq0 as (select qid, {VKEY.format('videoid')} as video, start_time, end_time, {TRIM.format('question')} as question, {LABEL.format('procedure_type')} as procedure from request
  where qid is not null and isfinite(start_time) and isfinite(end_time) and start_time >= 0 and end_time > start_time),
rq as (select qid, min(video) as video, min(start_time) as start_time, min(end_time) as end_time, min(question) as question, min(procedure) as procedure, split_part(qid, '_', 1) as dataset
  from rq0 where video is not null and question <> '' group by qid)"""
VIDEOS = f"""
vd0 as (select {VKEY.format('videoid')} as video, max(end_time) as duration_s from request
  where isfinite(start_time) and isfinite(end_time) and start_time >= 0 and end_time > start_time and {VKEY.format('videoid')} is not null group by 1),
vd1 as (select *, case when length(video) % 2 = 0 then 25.0::double else 29.97::double end as fps from vd0),
vd as (select *, floor((duration_s + 1) * fps)::bigint as total_frames from vd1)"""
# fixed values: sentences of the special templates, as above
TEMPLATES = f"""
tq0 as (select *, floor(start_time)::bigint as s, floor(end_time)::bigint as e, try_cast(right(qid, 1) as int) as digit from rq),
tq1 as (select * replace (case
  when digit <= 2 then 'What types of foreign objects are seen between ' || {clock_sql('s + 1')} || ' and ' || {clock_sql('greatest(s + 2, e - 3)')} || '? Please provide the class name(s) or answer none.'
  when digit <= 4 then 'There is one Specimen Bag in the frame at ' || {clock_sql('(s + e) // 2')} || '. When is it retrieved from the surgical site? Please provide the answer in hh:mm:ss.'
  when digit <= 6 then 'Does the Needle, last visible just before ' || {clock_sql('(s + e) // 2')} || ', re-appear later in the video? Please answer with yes or no.'
  when digit = 7 then 'Does the Needle, last visible just before ' || {clock_sql('e + 5')} || ', re-appear later in the video? Please answer with yes or no.' end as question), 'template' as asked from tq0),
tq as (select qid, dataset, video, start_time, end_time, procedure, question, asked, case when digit % 2 = 0 then 25.0::double else 29.97::double end as fps,
  greatest(1, floor((end_time - start_time) * (case when digit % 2 = 0 then 25.0::double else 29.97::double end))::bigint) as total_frames
  from (select * from tq1 where question is not null union all select *, 'real' from tq0))"""
RESULTS = "\nrs as (select distinct * from detailed_results)"
ANSWERS = "\nan as (select qid, r.answer as answer, r.latency as latency, r.response_id as response_id from (select qid, arg_min({'answer': answer, 'latency': latency, 'response_id': response_id}, response_id) as r from responses where qid is not null and response_id is not null group by qid))"
LOG = "\nlg as (select qid, coalesce(inference_status, '') as status, coalesce(format('{:.6f}', latency_s), '') as latency, case when timed_out then 'TimeoutError' else '' end as error_type from rs)"

_D = "end_time_s - start_time_s"
_SOUND = f"isfinite({_D}) and {_D} > 0"
_N = f"least(32, greatest(1, ceil({_D} - 1e-9)))::bigint"
FULL_LOG = f"""
fl as (select qid, coalesce(inference_status, '') as status, coalesce('Answer: ' || candidate_answer, '') as raw_answer, coalesce(format('{{:.6f}}', latency_s), '') as model_inference_s,
  coalesce(case when length(videoid) % 2 = 0 then '25.0' when videoid is not null then '29.97' end, '') as source_fps, case when {_SOUND} then format('{{:.6f}}', {_D}) else '' end as clip_duration_s,
  case when {_SOUND} then ({_N})::varchar else '' end as num_frames, case when {_SOUND} then ({_N} * 2)::varchar else '' end as num_patches, '' as peak_gpu_memory_gb,
  case when {_SOUND} then {clock_sql('floor(start_time_s)::bigint')} else '' end as first_absolute_timestamp, case when {_SOUND} then {clock_sql('floor(end_time_s)::bigint')} else '' end as last_absolute_timestamp from rs)"""


def cap_sql(a: str, k: str) -> str:
    """At most k entries of a list, evenly spaced."""
    return (
        f"(case when {k} <= 0 then ({a})[1:0] when len({a}) <= {k} then {a} when {k} = 1 then ({a})[1:1] "
        f"else list_transform(range(({k})::bigint), lambda i_: ({a})[(case when i_ = {k} - 1 then len({a}) else 1 + round_even(i_ * ((len({a}) - 1)::double / ({k} - 1)), 0) end)::bigint]) end)"
    )


def rint_sql(t: str, fps: str, total: str) -> str:
    return f"greatest(0, least({total} - 1, round_even(({t}) * {fps}, 0)::bigint))"


def with_white_space(oracles: dict[str, str]) -> dict[str, str]:
    return {name: sql.replace("@WS@", WHITE_SPACE) for name, sql in oracles.items()}
