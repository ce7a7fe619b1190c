"""Audits and small reports, and rules tried on rows that are broken on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import answers as an
from qaloom.functions import prompts, text, tiles
from qaloom.functions.timecode import hhmmss
from qaloom.operators import contracts, evaluation, frames, lookup, providers, resume, tokens
from qaloom.plans import checks, manifests, scores
from qaloom.plans import views as v
from qaloom.plans.frames import _PLAN, _rows


def score_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Whether micro and macro mean agree, over all rows."""
    rows = scores._rows(spark, sf)
    return evaluation.consistency(rows, evaluation.buckets(rows))


def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Per bucket: accuracy, and whether its interval holds it and is as wide as it should be (within a half)."""
    found = evaluation.bootstrap(evaluation.buckets(scores._rows(spark, sf)), "bucket_name")
    width = 2 * 1.96 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("count"))
    return found.select("bucket_name", "count", "accuracy", ((F.col("low") <= F.col("accuracy")) & (F.col("high") >= F.col("accuracy"))).alias("holds"), ((F.col("high") - F.col("low") - width) <= 0.5 * width + 2 / F.col("count")).alias("narrow"))


def judged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of each format under the judge that compares texts."""
    return providers.judged(v.results(spark, sf), ["answer_format"]).withColumn("mean_score", F.round("mean_score", 9))


def mean_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Mean losses of made-up runs: one per supplier nation, account balances as losses, each fifth step a validation."""
    s = v.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run"), F.when(F.col("s_suppkey") % 5 == 0, "val").otherwise("train").alias("phase"), F.col("s_acctbal").alias("loss"))
    return resume.mean_losses(s).withColumn("mean_loss", F.round("mean_loss", 6))


def path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a video that would be cached in two places, were questions with odd last digits given a folder of their own."""
    odd = F.right("qid", F.lit(1)).isin("1", "3", "5", "7", "9")
    rows = _rows(spark, sf, "qid", "video").select("video", "source_index", "timestamp", F.concat(F.when(odd, "b/").otherwise("a/"), "file").alias("path"))
    return contracts.path_collisions(rows, ["video", "source_index", "timestamp"], "path")


def cache_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation split: images that training's cache has already, and those to be written."""
    r = manifests._samples(spark, sf).select("split", F.explode("images").alias("path")).distinct()
    have = r.where("split = 'train'").select("path", F.lit(True).alias("there"))
    return r.where("split in ('val', 'test')").join(have, "path", "left").groupBy("split").agg(F.count_if(F.col("there").isNull()).alias("n_written"), F.count("there").alias("n_reused"))


def patch_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of each question's frames, frames being of one to three tiles in turn."""
    n = F.least(F.lit(32), F.greatest(F.lit(1), F.ceil(F.col("end_time") - F.col("start_time") - 1e-9))).cast("bigint")
    r = v.requests(spark, sf).select("qid", n.alias("n_frames"))
    return r.withColumn("n_patches", tiles.patch_total(F.transform(frames.span(F.col("n_frames")), lambda i: i % 3 + 1)))


def progress_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Each hundredth question of a dataset in order."""
    return lookup.every(v.requests(spark, sf).select("dataset", "qid"), ["dataset"], ["qid"], 100)


def clip_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where each question's clip and image lie."""
    return v.requests(spark, sf).select("qid", text.file_for("/input/clips", F.col("qid"), "mp4").alias("clip"), text.file_for("/input/frames/", F.col("qid"), ".png").alias("image"))


def lacking_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that one of requests, results and responses lacks."""
    return contracts.lacking_keys({n: v.table(spark, sf, n).select("qid") for n in ("request", "detailed_results", "responses")}, "qid")


def shared_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Each question under the one instruction that lists the classes."""
    shared = spark.range(1).select(F.concat(F.lit("Classes: "), text.listing(an.class_names()), F.lit(".\n")).alias("shared"))
    rows = v.requests(spark, sf).crossJoin(F.broadcast(shared))  # one row
    return rows.select("qid", F.sha2(F.concat("shared", "question"), 256).alias("digest"))


def class_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """How often answers name each class, the longest name that fits at each place."""
    found = F.regexp_extract_all(F.lower("answer"), F.lit(rf"\b({text.alternation([n.lower() for n in an.CLASS_NAMES])})\b"), F.lit(1))
    return v.answers(spark, sf).where("answer is not null").select(F.explode(found).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def sft_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Training records as ids and labels: the labels spell the answer and its closing mark, nothing else."""
    r = manifests._samples(spark, sf).select("sample_id", F.coalesce("user_text", F.lit("")).alias("user_text"), F.coalesce("assistant_text", F.lit("")).alias("assistant_text"))
    return tokens.supervised_text(tokens.sft_tokens(r)).select("sample_id", F.col("text").alias("supervised"), (F.col("n_ids") > 0).alias("has_ids"))


def shared_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds that a question's plan shares with the labels of its training records."""
    plan = frames.planned_times(v.requests(spark, sf)).select("qid", F.transform("times", lambda t: hhmmss(F.col("start_time") + t)).alias("planned"))
    r = manifests._samples(spark, sf).select("sample_id", "qid", "frame_labels").join(plan, "qid")
    return r.select("sample_id", F.size(F.array_intersect("planned", "frame_labels")).cast("bigint").alias("n_shared"))


# --- broken on purpose: what is broken follows from the last digit of the key ---


def _digit(key: str) -> Column:
    return F.right(key, F.lit(1))


def planted_manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows with one thing wrong each, and the rules they break."""
    m = manifests._manifest(spark, sf).withColumn("candidate_count", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("end_time") - F.col("start_time") - 1e-9).cast("bigint")))
    d, t = _digit("sample_id"), F.col("times")
    few = F.slice(t, F.lit(1), F.lit(16))
    long = F.transform(frames.span(F.lit(40)), lambda i: i * (F.col("end_time") - F.col("start_time")) / 41)
    wrong = F.when(d == "0", F.slice(t, F.lit(1), F.lit(0))).when(d == "1", long).when(d == "2", F.transform(t, lambda x: x + 0.25)).when(d == "3", F.concat(few, F.slice(t, F.lit(1), F.lit(1)))).when(d == "4", F.concat(few, F.array(F.col("end_time") - F.col("start_time") + 1))).otherwise(t)
    m = m.withColumn("times", wrong).withColumn("candidate_count", F.when(d == "5", F.col("candidate_count") + 1).otherwise(F.col("candidate_count"))).withColumn("n", F.size(t))
    return contracts.broken(m, F.col("sample_id"), contracts.manifest_rules()).where("not (rule = 'beyond_window' and right(key, 1) = '2')").select("rule", "key")


def planted_clip_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Selections with one thing wrong each, and the rules they break."""
    r = v.request_frames(spark, sf).select("qid", "total_frames", frames.span(F.lit(5)).alias("s"))
    d, s = _digit("qid"), F.col("s")
    wrong = F.when(d == "0", F.slice(s, F.lit(1), F.lit(0))).when(d == "1", frames.span(F.lit(40))).when(d == "2", F.reverse(s)).when(d == "3", F.concat(s, F.slice(s, F.lit(5), F.lit(1)))).when(d == "4", F.concat(s, F.array(F.col("total_frames")))).otherwise(s)
    return frames.clip_violations(r.withColumn("selected", wrong), "qid", 32)


def planted_label_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose labels were moved by one place against their images, where that shows."""
    r = manifests._samples(spark, sf).select("sample_id", "images", F.when(_digit("sample_id").isin("3", "7"), F.reverse("frame_labels")).otherwise(F.col("frame_labels")).alias("frame_labels"))
    return checks.mismatched(r)


QUERIES = {
    "score_consistency": score_consistency, "bootstrap_intervals": bootstrap_intervals, "judged_scores": judged_scores, "mean_losses": mean_losses, "path_collisions": path_collisions, "cache_writes": cache_writes, "patch_sums": patch_sums, "progress_marks": progress_marks, "clip_paths": clip_paths,
    "lacking_keys": lacking_keys, "shared_prompt": shared_prompt, "class_mentions": class_mentions, "sft_tokens": sft_tokens, "shared_frames": shared_frames,
    "planted_manifest_violations": planted_manifest_violations, "planted_clip_violations": planted_clip_violations, "planted_label_mismatches": planted_label_mismatches,
}

# --- SQL ------------------------------------------------------------------------

_SAMPLES = manifests._SAMPLES
_NAMES = ", ".join(an.CLASS_NAMES[:-1]) + ", and " + an.CLASS_NAMES[-1]
_ALTERNATION = text.alternation([n.lower() for n in an.CLASS_NAMES])
_STAMPS = f"pt0 as (select *, range(greatest(1, ceil((end_time - start_time) - 1e-9)::bigint)) as t from rq), pt1 as (select *, {v.cap_sql('t', '32')} as c from pt0)"
_COUNT = "greatest(1, ceil(end_time - start_time - 1e-9)::bigint)"
_PLANTED = {
    "no_frames": "d = '0'", "too_many_frames": "d = '1'", "first_not_at_start": "d = '2'", "times_not_increasing": "d = '3'",
    "beyond_window": "d = '4'", "wrong_candidate_count": "d = '5'",
}
_BROKEN_CLIPS = {"empty": "d = '0'", "too_many": "d = '1'", "not_increasing": "d in ('2', '3')", "out_of_range": "d = '4' or (d = '1' and total_frames < 40) or (d not in ('0', '1', '4') and total_frames < 5)"}
ORACLES = {
    "score_consistency": scores._ROWS + scores._BUCKETS + ", b as (select count(*) as n_buckets, min(count) = max(count) as equal_sizes, avg(accuracy) as macro from bk) select n_buckets, equal_sizes, not equal_sizes or abs(macro - (select avg(correctness::int) from sr)) <= 1e-12 as agree from b",
    "bootstrap_intervals": scores._ROWS + scores._BUCKETS + "select bucket_name, count, accuracy, true as holds, true as narrow from bk",
    "judged_scores": f"with {v.RESULTS} select answer_format, count(*) as n, round(avg((coalesce(lower(regexp_replace(reference_answer, '^@WS@+|@WS@+$', '', 'g')) = lower(regexp_replace(candidate_answer, '^@WS@+|@WS@+$', '', 'g')), false))::int), 9) as mean_score from rs group by answer_format",
    "mean_losses": "select s_nationkey as run, case when s_suppkey % 5 = 0 then 'val' else 'train' end as phase, count(*) as n, round(avg(s_acctbal), 6) as mean_loss from supplier group by all",
    "path_collisions": _PLAN + ", p as (select video, source_index, timestamp, case when right(qid, 1) in ('1', '3', '5', '7', '9') then 'b/' else 'a/' end || file as path from pl) select video, source_index, timestamp, min(path) as path, max(path) as other from p group by 1, 2, 3 having min(path) <> max(path)",
    "cache_writes": f"with {_SAMPLES}, p as (select distinct split, unnest(images) as path from sm), h as (select path from p where split = 'train') select split, count(*) filter (where path not in (from h)) as n_written, count(*) filter (where path in (from h)) as n_reused from p where split in ('val', 'test') group by split",
    "patch_sums": f"with {v.REQUESTS}, n as (select qid, least(32, {_COUNT}) as n_frames from rq) select qid, n_frames, list_sum([i % 3 + 1 for i in range(n_frames)])::bigint as n_patches from n",
    "progress_marks": f"with {v.REQUESTS}, n as (select dataset, qid, row_number() over (partition by dataset order by qid) as number from rq) select * from n where number % 100 = 0",
    "clip_paths": f"with {v.REQUESTS} select qid, '/input/clips/' || qid || '.mp4' as clip, '/input/frames/' || qid || '.png' as image from rq",
    "lacking_keys": "with a as (select 'detailed_results' as name, qid from detailed_results union all select 'request', qid from request union all select 'responses', qid from responses), k as (select qid, list(distinct name) as names from a where qid is not null group by qid) select qid as key, array_to_string([n for n in ['detailed_results', 'request', 'responses'] if not list_contains(names, n)], ',') as lacking from k where len(names) < 3",
    "shared_prompt": f"with {v.REQUESTS} select qid, sha256('Classes: {_NAMES}.' || chr(10) || question) as digest from rq",
    "class_mentions": f"with {v.ANSWERS}, m as (select unnest(regexp_extract_all(lower(answer), '\\b({_ALTERNATION})\\b')) as name from an where answer is not null) select name, count(*) as n from m group by name",
    "sft_tokens": f"with {_SAMPLES} select sample_id, coalesce(assistant_text, '') || '<|im_end|>' as supervised, true as has_ids from sm",
    "shared_frames": f"with {v.REQUESTS},{_SAMPLES},{_STAMPS}, pt as (select qid, [{v.clock_sql('floor(start_time + x)::bigint')} for x in c] as stamps from pt1) select sample_id, len(list_intersect(stamps, frame_labels)) as n_shared from sm join pt using (qid)",
    "planted_manifest_violations": manifests._MANIFEST + ", x as (select sample_id, right(sample_id, 1) as d from mf) " + " union all ".join(f"select '{k}' as rule, sample_id as key from x where {c}" for k, c in _PLANTED.items()),
    "planted_clip_violations": f"with {v.REQUESTS},{v.VIDEOS}, x as (select qid, right(qid, 1) as d, total_frames from rq join vd using (video)) " + " union all ".join(f"select qid, '{k}' as rule from x where {c}" for k, c in _BROKEN_CLIPS.items()),
    "planted_label_mismatches": f"with {_SAMPLES} select 'label_differs' as rule, sample_id as key from sm where right(sample_id, 1) in ('3', '7') and len(list_distinct(frame_labels)) > 1 and frame_labels <> list_reverse(frame_labels)",
}
ORACLES = v.with_white_space(ORACLES)
