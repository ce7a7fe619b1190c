"""More rules as queries: formats, orders, subsets, labels and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import answers as an
from qaloom.functions.timecode import hhmmss
from qaloom.operators import contracts, lookup
from qaloom.operators.frames import planned_times
from qaloom.plans import manifests
from qaloom.plans import views as v


def format_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per answer format: answers, and how many can be read in it."""
    rows = v.results(spark, sf).where("candidate_answer is not null")
    ok = an.format_valid(F.col("candidate_answer"), F.col("answer_format"), an.class_names())
    return rows.select("answer_format", ok.alias("ok")).groupBy("answer_format").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_valid"))


def ood_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Questions out of distribution where only others are allowed."""
    return contracts.broken(v.results(spark, sf), F.col("qid"), {"out_of_distribution": F.col("ood")}, F.col("dataset"))


def smoke_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets and splits whose smoke subset doesn't hold exactly four videos."""
    rows = manifests.smoke_subset(spark, sf).where("dataset is not null and split is not null")
    counts = rows.groupBy("dataset", "split").agg(F.count_distinct("video").alias("n_videos"))
    return counts.where("n_videos <> 4")


def selection_order(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn identifiers whose place differs from their place in sorted order."""
    from qaloom.plans.scores import _selected

    drawn = _selected(spark, sf)
    ranked = lookup.numbered(drawn.select("qid"), [], ["qid"], "pos")
    return contracts.order_difference(drawn, ranked, "qid").select("key", "detail")


def mismatched(records: DataFrame) -> DataFrame:
    wanted = F.transform("images", lambda p: hhmmss(F.regexp_extract(p, r"f(\d+)\.[a-z]+$", 1).try_cast("bigint")))
    return contracts.broken(records, F.col("sample_id"), {"label_differs": ~F.col("frame_labels").eqNullSafe(wanted)}).select("rule", "key")


def label_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose labels aren't the clock times of their images' numbers."""
    return mismatched(manifests._samples(spark, sf).select("sample_id", "images", "frame_labels"))


def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that planned manifest rows break; the count of candidates is the one that the record states."""
    m = manifests._manifest(spark, sf).withColumn("candidate_count", F.col("metadata.candidate_count_1fps"))
    return contracts.broken(m, F.col("sample_id"), contracts.manifest_rules()).select("rule", "key")


def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Images of evaluation records that no training record has: what a cache made for training still lacks."""
    r = manifests._samples(spark, sf).select("split", F.explode("images").alias("path"))
    have = r.where("split = 'train'").select("path", F.lit(1).alias("length")).distinct()
    return contracts.missing_files(r.where("split in ('val', 'test')"), "path", have).select("key")


def epoch_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten records of each of three epochs' shuffles."""
    r = manifests._samples(spark, sf).select("sample_id")
    parts = [r.select(F.lit(e).alias("epoch"), "sample_id", lookup.seeded_order("sample_id", 50, e).alias("place")).orderBy("place", "sample_id").limit(10) for e in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def window_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct planned times of a video's requests, and how many requests share them."""
    rows = planned_times(v.requests(spark, sf)).select("video", F.explode(F.transform("times", lambda t: F.floor(F.col("start_time") + t).cast("bigint"))).alias("second"))
    per = rows.groupBy("video", "second").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("video").agg(F.count(F.lit(1)).alias("n_seconds"), F.sum("n").alias("n_looks"), F.max("n").alias("most_shared"))


QUERIES = {"format_checks": format_checks, "ood_violations": ood_violations, "smoke_contract": smoke_contract, "selection_order": selection_order, "label_mismatches": label_mismatches, "manifest_violations": manifest_violations, "cache_misses": cache_misses, "epoch_orders": epoch_orders, "window_dedup": window_dedup}

# --- SQL ------------------------------------------------------------------------

_SAMPLES = manifests._SAMPLES
_FORMATS = f"""with {v.RESULTS},
n0 as (select answer_format, regexp_replace(candidate_answer, '^@WS@+|@WS@+$', '', 'g') as s from rs where candidate_answer is not null),
n1 as (select *, regexp_replace(s, '[.!?;:]+@WS@*$', '') as c from n0),
n2 as (select *, [x for x in [regexp_replace(y, '^@WS@+|@WS@+$', '', 'g') for y in string_split(c, ',')] if x <> ''] as items from n1),
n3 as (select *, len(items) > 0 and len([x for x in items if not list_contains([{', '.join(repr(n.lower()) for n in an.CLASS_NAMES)}], lower(x))]) = 0 as classes, len(items) = 1 and lower(items[1]) = 'none' as nothing from n2)
select answer_format, count(*) as n, count(*) filter (where s <> '' and case answer_format when 'yesno' then regexp_full_match(c, '(?i)yes|no') when 'count' then regexp_full_match(c, '\\d+') when 'percent' then regexp_full_match(c, '\\d+(?:\\.\\d+)?\\s*%')
  when 'time' then len(items) > 0 and len([x for x in items if not regexp_full_match(x, '\\d{{2}}:[0-5]\\d:[0-5]\\d')]) = 0 when 'cls' then nothing or (classes and len(items) = 1) when 'clslist' then nothing or classes
  when 'layout' then regexp_full_match(c, '(?i)(?:\\d+\\.\\s*[a-z ]+:\\s*(?:top|bottom)/(?:left|right)\\s*)+') else true end) as n_valid from n3 group by answer_format"""
_MANIFEST = manifests._MANIFEST
_NUMBER = "regexp_extract(p, 'f([0-9]+)[.][a-z]+$', 1)::bigint"

ORACLES = {
    "format_checks": _FORMATS,
    "ood_violations": f"with {v.RESULTS} select 'out_of_distribution' as rule, qid as key, coalesce(dataset, '') as detail from rs where ood",
    "smoke_contract": f"with x as ({manifests.ORACLES['smoke_subset']}) select dataset, split, count(distinct video) as n_videos from x where dataset is not null and split is not null group by all having count(distinct video) <> 4",
    "selection_order": f"with s as (select {manifests._LOWQ} as qid, min(pos) as pos from selected_qids where {manifests._LOWQ} is not null and pos is not null group by 1), r as (select *, row_number() over (order by qid) - 1 as k from s) select qid as key, pos::varchar || ' ' || k::varchar as detail from r where pos <> k",
    "label_mismatches": f"with {_SAMPLES} select 'label_differs' as rule, sample_id as key from sm where frame_labels is distinct from [{v.clock_sql(_NUMBER)} for p in images]",
    "manifest_violations": _MANIFEST + "select 'wrong_candidate_count' as rule, sample_id as key from mf where metadata.candidate_count_1fps <> greatest(1, ceil(end_time - start_time - 1e-9)::bigint)",
    "cache_misses": f"with {_SAMPLES}, p as (select split, unnest(images) as path from sm) select distinct path as key from p where split in ('val', 'test') and path not in (select path from p where split = 'train')",
    "epoch_orders": f"with {_SAMPLES}, k as (select unnest([0, 1, 2]) as epoch), o as (select epoch, sample_id, md5(sample_id || ':' || (50 + epoch)::varchar) as place from sm, k), r as (select *, row_number() over (partition by epoch order by place, sample_id) as n from o) select epoch, sample_id, place from r where n <= 10",
    "window_dedup": f"with {v.REQUESTS}, p0 as (select *, range(greatest(1, ceil((end_time - start_time) - 1e-9)::bigint)) as t from rq), p1 as (select video, start_time, {v.cap_sql('t', '32')} as c from p0), p as (select video, floor(start_time + x)::bigint as second, count(*) as n from (select video, start_time, unnest(c) as x from p1) group by all) select video, count(*) as n_seconds, sum(n)::bigint as n_looks, max(n) as most_shared from p group by video",
}
ORACLES = v.with_white_space(ORACLES)
