"""Queries of the llm problems with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions.text import trimmed_lower, vkey
from qaloom.llm import cross_split, defects, encoding, group_splits, leakage, mixing, proportional, stable_sample
from qaloom.operators.lineage import cut

SAMPLE_RATE = 0.05


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 1: same or nearly same records across splits ---------------------------


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split.cross_split_overlaps(table(spark, sf, "train_sft"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = p1_pairs(spark, sf)
    return pairs.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")).distinct()


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Links of classes of equal records, a class named by its least id, with the numbers of its records."""
    links, members = cross_split.linked_classes(table(spark, sf, "train_sft"))
    named = cut(members.groupBy("side", "class").agg(F.min("id").alias("name"), F.count_distinct("id").alias("n")))
    of = lambda side, x: named.where(F.col("side") == side).select(F.col("class").alias(f"class_{x}"), F.col("name").alias(f"{x}_class"), F.col("n").alias(f"n_{x}"))
    return links.join(of(0, "train"), "class_train").join(of(1, "eval"), "class_eval").select("train_class", "eval_class", "n_train", "n_eval", "edits")


def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    """Records of linked classes with their class."""
    _, members = cross_split.linked_classes(table(spark, sf, "train_sft"))
    members = cut(members)
    named = members.groupBy("side", "class").agg(F.min("id").alias("class_name"))
    return members.join(named, ["side", "class"]).select(F.col("id").alias("sample_id"), "split", F.when(F.col("side") == 0, "train").otherwise("eval").alias("side"), "class_name")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation split and dataset: pairs, evaluation records concerned, exact pairs."""
    datasets = table(spark, sf, "train_sft").groupBy(F.col("sample_id").alias("eval_id")).agg(F.min(trimmed_lower(F.col("dataset"))).alias("dataset"))
    pairs = p1_pairs(spark, sf).join(datasets, "eval_id")
    return pairs.groupBy("eval_split", "dataset").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("eval_id").alias("n_records"), F.count_if(F.col("edits") == 0).alias("n_exact"))


# --- 2: a sample stable as data grow ----------------------------------------


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stable_sample.stable_sample(table(spark, sf, "request"), "qid", SAMPLE_RATE, keep=table(spark, sf, "selected_qids"))


def p2_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Per wave: distinct questions that first came with it, and how many of them the sample holds."""
    first = table(spark, sf, "request").groupBy(trimmed_lower(F.col("qid")).alias("qid")).agg(F.min("wave").alias("wave")).where("qid is not null")
    sample = p2_sample(spark, sf)
    return first.join(sample, "qid", "left").groupBy("wave").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("origin") == "kept").alias("n_kept"), F.count_if(F.col("origin") != "kept").alias("n_drawn"))


# --- 3: broken prompt and response pairs ------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "request").where(F.col("question").rlike(r"\S")).groupBy("qid").agg(F.max("question").alias("question"))
    responses = table(spark, sf, "responses").where("response_id is not null").select("response_id", "qid", "answer").distinct()
    a = responses.join(asked, "qid", "left").select(F.lit("responses").alias("record_table"), F.col("response_id").cast("string").alias("record_key"), "question", "answer")
    records = table(spark, sf, "train_sft").where("sample_id is not null").select("sample_id", defects.asked_last("user_text").alias("question"), F.col("assistant_text").alias("answer")).distinct()
    b = records.select(F.lit("train_sft").alias("record_table"), F.col("sample_id").alias("record_key"), "question", "answer")
    return a.unionByName(b)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.find_defects(_pairs(spark, sf))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return p3_found(spark, sf).groupBy("record_table", "defect").agg(F.count(F.lit(1)).alias("n_records"))


# --- 4: splits that keep related records together ---------------------------


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, qid, split, dataset, vkey): records with the videos of their question; vkey null if none is known."""
    videos = table(spark, sf, "request").select("qid", vkey(F.col("videoid")).alias("vkey")).where("qid is not null and vkey is not null").distinct()
    records = table(spark, sf, "train_sft").select("sample_id", "qid", trimmed_lower(F.col("split")).alias("split"), trimmed_lower(F.col("dataset")).alias("dataset")).distinct()
    return records.join(videos, "qid", "left")


def p4_torn(spark: SparkSession, sf: str) -> DataFrame:
    """Videos of linked groups that lie in several splits, with the number of splits of their own records."""
    return group_splits.torn(_linked(spark, sf), "sample_id", "vkey", "split").select("component", F.col("entity").alias("vkey"), "n_splits")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_torn(spark, sf).where("n_splits > 1").select("vkey")


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    """A new split for each record: records of one video, or else of one question, share it."""
    shares = {r["split"]: float(r["target_pct"]) for r in table(spark, sf, "split_target").collect()}  # one row for each split
    rows = _linked(spark, sf).withColumn("entity", F.coalesce("vkey", F.concat(F.lit("qid:"), "qid")))
    found = group_splits.group_splits(rows, shares, "sample_id", "entity", "dataset")
    return found.select(F.col("record").alias("sample_id"), "component", "new_split")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per dataset and new split: records and the split's share of the dataset."""
    datasets = table(spark, sf, "train_sft").groupBy("sample_id").agg(F.min(F.coalesce(trimmed_lower(F.col("dataset")), F.lit("(none)"))).alias("dataset"))
    counts = p4_splits(spark, sf).join(datasets, "sample_id").groupBy("dataset", "new_split").agg(F.count(F.lit(1)).alias("n_records"))
    whole = counts.groupBy("dataset").agg(F.sum("n_records").alias("n"))
    return counts.join(whole, "dataset").select("dataset", "new_split", "n_records", (F.col("n_records") * 100.0 / F.col("n")).alias("share_pct"))


def p4_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per dataset: records that got a split, and how many of them share a video with a record of another new split."""
    new = cut(p4_splits(spark, sf))
    rows = _linked(spark, sf).groupBy("sample_id").agg(F.min(F.coalesce("dataset", F.lit("(none)"))).alias("dataset"), F.min("vkey").alias("vkey")).join(new, "sample_id")
    broken = rows.where("vkey is not null").groupBy("vkey").agg(F.count_distinct("new_split").alias("k")).where("k > 1")
    return rows.join(broken, "vkey", "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_records"), F.count("k").alias("n_torn"))


# --- 5: a sample matching target proportions --------------------------------

FIELDS = {"request.procedure_type": "qid", "train_sft.dataset": "sample_id", "detailed_results.capability_group": "qid"}
SAMPLES = {"p5_request_sample": "request.procedure_type", "p5_train_sample": "train_sft.dataset", "p5_results_sample": "detailed_results.capability_group"}


def _field(spark: SparkSession, sf: str, field: str) -> tuple[DataFrame, DataFrame]:
    name, column = field.split(".")
    records = proportional.categorised(table(spark, sf, name), FIELDS[field], column)
    targets = table(spark, sf, "sample_target").where(F.col("field_name") == field).select(F.col("category").alias("label"), "target_pct", "min_rows", "sample_pct")
    return records, targets


def p5_plan(spark: SparkSession, sf: str) -> DataFrame:
    """All targets with what is there and what is wanted."""
    out = None
    for field in FIELDS:
        plan = proportional.sampling_plan(*_field(spark, sf, field)).withColumn("field_name", F.lit(field))
        out = plan if out is None else out.unionByName(plan)
    return out.select("field_name", F.col("label").alias("category"), "available", "all_records", "wanted", "met")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of which the sample holds fewer records than wanted, with the exact check on counts after it."""
    return p5_report(spark, sf).where("drawn < wanted and not met").select("field_name", "category").distinct()


def _sample(field: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        records, targets = _field(spark, sf, field)
        found = proportional.proportional_sample(cut(records), targets)  # the plan and both levels of the ranks read them
        return found.select(F.col("id").alias(FIELDS[field]), "category", "how")

    return query


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per target: records there, wanted and drawn, and how many of them a floor added."""
    out = None
    for field in FIELDS:
        records, targets = _field(spark, sf, field)
        records = cut(records)  # read by the plan and by both levels of the ranks
        planned = cut(proportional.sampling_plan(records, targets))  # a row for each target
        drawn = proportional.proportional_sample(records, targets, planned=planned).groupBy("category").agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("how") == "floor").alias("by_floor"))
        part = planned.join(drawn, "category", "left").select(F.lit(field).alias("field_name"), F.col("label").alias("category"), "available", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("by_floor", F.lit(0)).alias("by_floor"), "met")
        out = part if out is None else out.unionByName(part)
    return out


# --- 7: evaluation texts leaking into a corpus ------------------------------


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).where("longest >= 12").select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per leaked item: documents that hold any of it, half of it, nearly all of it."""
    items = table(spark, sf, "eval_item").select("item_id", trimmed_lower(F.col("split")).alias("split")).distinct()
    found = p7_leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("coverage") >= 0.5).alias("n_half"), F.count_if(F.col("coverage") >= 0.9).alias("n_whole"), F.max("longest").alias("longest"))
    return found.join(items, "item_id")


# --- 8: mixing sources to target weights ------------------------------------


def p8_plan(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixing_plan(mixing.token_counts(table(spark, sf, "documents")), table(spark, sf, "mix_target"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts, targets, places of documents, mixture."""
    counts = cut(mixing.token_counts(table(spark, sf, "documents")))  # read by plan and packing
    targets = table(spark, sf, "mix_target")
    places, blocks = mixing.pack(counts)
    return counts, targets, places, mixing.mixture(counts, targets, blocks)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose blocks in the mixture don't reach their share, with the exact check on tokens after it."""
    counts, targets, _, mixed = _mixed(spark, sf)
    return mixing.short_sources(counts, mixed, targets)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """All slots of the mixture with the token ids of their blocks."""
    _, _, places, mixed = _mixed(spark, sf)
    return mixing.filled(mixed, mixing.block_tokens(table(spark, sf, "documents"), places))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    counts, targets, _, mixed = _mixed(spark, sf)
    return mixing.mixture_report(counts, mixed, targets)


def p8_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: whether it is short, keeps to its repeats, and, if not short, has its share within five standard errors of the draw and a percent."""
    rows = p8_report(spark, sf).join(table(spark, sf, "mix_target").select(trimmed_lower(F.col("source")).alias("source"), "max_repeats", "budget_pct").distinct(), "source")
    budget, p = F.col("all_tokens") * F.col("budget_pct") / 100, F.col("target_pct") / 100
    error = 5 * F.sqrt(p * (1 - p) * 512 / budget) + 0.01
    close = F.col("short") | (F.abs(F.col("mixed_tokens") / budget - p) < error)
    return rows.select("source", "short", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), close.alias("share_kept"))


# --- 9: garbled text from wrong character encoding --------------------------


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.restore_encoding(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_restored(spark, sf).select("doc_id").distinct()


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return p9_restored(spark, sf).groupBy("mapping").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("lost").alias("n_lost"))


QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs, "p1_classes": p1_classes, "p1_members": p1_members, "p1_report": p1_report,
    "p2_sample": p2_sample, "p2_growth": p2_growth,
    "p3_found": p3_found, "p3_report": p3_report,
    "p4_found": p4_found, "p4_torn": p4_torn, "p4_totals": p4_totals, "p4_splits": p4_splits, "p4_report": p4_report,
    "p5_found": p5_found, "p5_plan": p5_plan, **{name: _sample(field) for name, field in SAMPLES.items()}, "p5_report": p5_report,
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_report": p7_report,
    "p8_found": p8_found, "p8_plan": p8_plan, "p8_mixture": p8_mixture, "p8_report": p8_report, "p8_bounds": p8_bounds,
    "p9_found": p9_found, "p9_restored": p9_restored, "p9_report": p9_report,
}

_LABEL = r"nullif(regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), '')"
_LOW = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"
_VKEY = r"nullif(regexp_replace(lower(regexp_replace(videoid, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '')"


def _p5_plan_sql() -> str:
    parts = []
    for field, key in FIELDS.items():
        name, column = field.split(".")
        parts.append(f"select '{field}' as field_name, {key} as id, min({_LABEL.format(column)}) as c from {name} where {key} is not null and {_LABEL.format(column)} is not null group by {key}")
    return f"""
with r as ({' union all '.join(parts)}),
 n as (select field_name, c, count(*) as available from r group by 1, 2),
 a as (select field_name, count(*) as all_records from r group by 1),
 t as (select distinct *, {_LABEL.format('category')} as c from sample_target),
 p as (
  select t.field_name, t.category, t.c, t.target_pct, t.sample_pct, t.min_rows, coalesce(n.available, 0) as available, coalesce(a.all_records, 0) as all_records,
    greatest(t.min_rows::bigint, (t.target_pct::bigint * t.sample_pct * coalesce(a.all_records, 0) + 9999) // 10000) as wanted
  from t left join a using (field_name) left join n on n.field_name = t.field_name and n.c = t.c)
"""


# the sample's line: for each category its quota, where it begins, and its records by rank
_P5_LINE = f""",
 k as (select p.field_name, c, max(p.available) as available, max(p.wanted) as wanted, max({{'a': target_pct, 'b': sample_pct, 'c': min_rows}}) as m, max(p.all_records) as all_records
  from p group by 1, 2),
 q as (select field_name, c, available, wanted, least(available::hugeint * 10000, m.a::hugeint * m.b * all_records) as quota from k),
 l as (select *, {proportional.start(1)} + coalesce(sum(quota) over (partition by field_name order by c rows between unbounded preceding and 1 preceding), 0) as base from q),
 f as (select field_name, c, id, available, least(available, wanted) as floor,
   (base * available + x * quota) // (available::hugeint * 10000) as here, (base * available + (x - 1) * quota) // (available::hugeint * 10000) as until,
   base // 10000 as first, (base + quota) // 10000 as last, x
  from (select r.field_name, r.id, l.c, l.available, l.wanted, l.quota, l.base,
     row_number() over (partition by r.field_name, r.c order by ('0x' || substr(md5(r.id || ':1'), 1, 15))::bigint, r.id) as x
    from r join l on r.field_name = l.field_name and r.c = l.c)),
 drawn as (select field_name, c as category, id, case when here > until then 'crossing' else 'floor' end as how
  from f where here > until or x - (here - first) <= floor - (last - first))
"""


def _p2_sql() -> str:
    left, right, form = stable_sample.LEFT, stable_sample.RIGHT, stable_sample.FORM
    powers = ", ".join(f"{stable_sample.BASE**k}::hugeint" for k in range(stable_sample.LETTERS))
    before = ", ".join(f"{n}::bigint" for n in stable_sample.BEFORE)
    letters = " + ".join(f"case when length(l) >= {i} then strpos('{stable_sample.ALPHABET}', substr(l, {i}, 1)) * [{powers}][length(l) - {i} + 1] else 0 end" for i in range(1, stable_sample.LETTERS + 1))
    sql = f"""
with ids as (select distinct {_LOW.format('qid')} as qid from request where {_LOW.format('qid')} is not null),
 parts as (select qid, coalesce(regexp_extract(qid, '{form}', 1), '') as l, regexp_extract(qid, '{form}', 2) as r from ids where regexp_matches(qid, '{form}')),
 f0 as (select qid, ({letters})::bigint as a, r::bigint + [{before}][length(r)] as b from parts)"""
    for k in range(stable_sample.ROUNDS):
        digest = lambda x, k=k: f"('0x' || substr(md5({x}::varchar || ':1:{k}'), 1, 15))::bigint"
        step = f"(a + {digest('b')} % {left}) % {left} as a, b" if k % 2 == 0 else f"a, (b + {digest('a')} % {right}) % {right} as b"
        sql += f",\n f{k + 1} as (select qid, {step} from f{k})"
    bound = left * round(SAMPLE_RATE * 1_000_000) // 1_000_000
    return (
        sql
        + f""",
 kept as (select distinct {_LOW.format('qid')} as qid, true as kept from selected_qids)
select f.qid, case when kept then 'kept' else 'drawn' end as origin from f{stable_sample.ROUNDS} f left join kept using (qid) where kept or a < {bound}"""
    )


_P4_FOUND = f"""
with v as (select distinct qid, {_VKEY} as vkey from request where {_VKEY} is not null)
select vkey from train_sft join v using (qid) where {_LOW.format('split')} is not null
group by vkey having count(distinct {_LOW.format('split')}) > 1"""

_P4_TORN = f"""
with recursive v as (select distinct qid, {_VKEY} as vkey from request where {_VKEY} is not null),
 r as (select sample_id, {_LOW.format('split')} as split, vkey from train_sft join v using (qid)),
 l as (select distinct sample_id, vkey from r where sample_id in (select sample_id from r group by 1 having count(distinct vkey) > 1)),
 next as (select distinct a.vkey, b.vkey as other from l a join l b using (sample_id)),
 reach as (select distinct vkey, vkey as c from r union select n.other, reach.c from reach join next n using (vkey)),
 part as (select vkey, min(c) as component from reach group by vkey),
 own as (select component, vkey, count(distinct split) as n_splits, min(split) as a, max(split) as b from r join part using (vkey) where split is not null group by 1, 2)
select component, vkey, n_splits from own where component in (select component from own group by 1 having min(a) <> max(b))"""

_P4_TOTALS = f"""
select dataset, count(*) as n_records, 0::bigint as n_torn
from (select sample_id, min(coalesce({_LOW.format('dataset')}, '(none)')) as dataset from train_sft where sample_id is not null group by 1) group by dataset"""

_P7_FOUND = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as x from documents where text is not null and doc_id is not null),
 i as (select distinct item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as x from eval_item where text is not null and item_id is not null),
 d as (select doc_id, unnest([array_to_string(x[k:k + 11], ' ') for k in range(1, len(x) - 10)]) as g from w where len(x) >= 12),
 s as (select distinct item_id, unnest([array_to_string(x[k:k + 11], ' ') for k in range(1, len(x) - 10)]) as g from i where len(x) >= 12)
select distinct doc_id, item_id from d join s using (g)"""

# tokens are counted here as words and marks: any common count gives the same sources
_P8 = rf"""
with d as (select distinct doc_id, {_LOW.format('source')} as source, text from documents),
 n as (select source, sum(coalesce(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')), 0)) as tokens from d group by source),
 t as (select distinct {_LOW.format('source')} as source, target_pct, max_repeats, budget_pct from mix_target),
 s as (select source, max_repeats * coalesce(tokens, 0) < target_pct / 100.0 * budget_pct / 100.0 * (select sum(tokens) from n) as short from t left join n using (source) where source is not null)
"""

_P2_GROWTH = f"""
with first as (select {_LOW.format('qid')} as qid, min(wave) as wave from request where {_LOW.format('qid')} is not null group by 1), sample as ({_p2_sql()})
select wave, count(*) as n_questions, count(*) filter (where origin = 'kept') as n_kept, count(*) filter (where origin <> 'kept') as n_drawn from first left join sample using (qid) group by wave"""

ORACLES = {
    "p2_sample": _p2_sql(),
    "p2_growth": _P2_GROWTH,
    "p7_found": _P7_FOUND,
    "p8_found": _P8 + "select distinct source from s where short",
    "p8_bounds": _P8 + "select source, short, true as repeats_kept, true as share_kept from s",
    "p4_found": _P4_FOUND,
    "p4_torn": _P4_TORN,
    "p4_totals": _P4_TOTALS,
    "p5_plan": _p5_plan_sql() + "select field_name, category, available, all_records, wanted, available >= wanted as met from p",
    **{name: _p5_plan_sql() + _P5_LINE + f"select id as {FIELDS[field]}, category, how from drawn where field_name = '{field}'" for name, field in SAMPLES.items()},
    "p5_report": _p5_plan_sql() + _P5_LINE + """,
 d as (select field_name, category as c, count(*) as drawn, count(*) filter (where how = 'floor') as by_floor from drawn group by 1, 2)
select field_name, category, available, wanted, coalesce(drawn, 0) as drawn, coalesce(by_floor, 0) as by_floor, available >= wanted as met from p left join d using (field_name, c)""",
    "p5_found": _p5_plan_sql() + "select distinct field_name, category from p where available < wanted",
}
