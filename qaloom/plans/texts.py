"""Queries on answers, prompts and images' tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import answers as an
from qaloom.functions import capabilities, prompts, text, tiles
from qaloom.operators.frames import planned_times
from qaloom.plans import views as v

#: A definitions document in the public format, made here for the queries.
DEFINITIONS = "Foreign objects\n===============\n\n" + "\n\n".join(f"{n}\n{'-' * len(n)}\nA {n.lower()} that may be left behind." for n in an.CLASS_NAMES)


def answer_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.answers(spark, sf).where("answer is not null")
    return rows.select("qid", an.normalise(F.col("answer"), an.class_names()).alias("normalized"), an.kind(F.col("answer"), an.class_names()).alias("kind"))


def fo_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class names of a definitions document, in order."""
    doc = spark.range(1).select(an.resolved_names(F.lit(DEFINITIONS), an.class_names(), 3).alias("names"))
    return doc.select(F.posexplode("names").alias("pos", "name"), text.listing(F.col("names")).alias("listing")).select(F.col("pos").cast("bigint").alias("pos"), "name", "listing")


def label_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Per dataset and video: slug, stem and folder of the cache."""
    r = v.requests(spark, sf).select("dataset", "video").distinct()
    return r.select("dataset", "video", text.stem(F.col("video")).alias("stem"), text.slug(F.col("video")).alias("slug"), text.token(F.col("video")).alias("token"), text.cache_folder(F.col("dataset"), F.col("video")).alias("folder"))


def capability_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Capability labels as they are written, with code, group and number of rows."""
    r = v.results(spark, sf).groupBy("primary_capability", "primary_capability_value", "capability_group").agg(F.count(F.lit(1)).alias("n_rows"))
    code = capabilities.code(F.col("primary_capability"), F.col("primary_capability_value"))
    return r.select("primary_capability", "primary_capability_value", "capability_group", code.alias("code"), capabilities.code_group(code).alias("code_group"), capabilities.group(F.col("capability_group")).alias("metric_group"), "n_rows")


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = planned_times(v.requests(spark, sf), most=32)
    labels = prompts.absolute_labels(F.col("start_time"), F.col("times"))
    shared = prompts.global_sampling_text(F.size("times"), F.col("end_time") - F.col("start_time"), 1.0, 32)
    rows = rows.withColumn("labels", labels)
    return rows.withColumn("prompt", F.concat(prompts.image_prefix(F.col("labels")), shared, F.lit("\n\n"), prompts.request_prompt(F.col("procedure"), F.col("question"))))


def request_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prompts(spark, sf)
    return rows.select("qid", F.size("labels").cast("bigint").alias("n_frames"), F.get("labels", 0).alias("first_label"), F.element_at("labels", -1).alias("last_label"), prompts.placeholders(F.col("prompt")).alias("n_marks"), F.char_length("prompt").cast("bigint").alias("n_chars"), F.sha2("prompt", 256).alias("digest"))


def single_image_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The one-image track: label of the frame at the start of the window, unknown procedures allowed."""
    rows = v.requests(spark, sf)
    whole = F.concat(prompts.single_image_prefix(F.col("start_time")), prompts.request_prompt(F.col("procedure"), F.col("question")))
    return rows.select("qid", prompts.single_image_prefix(F.col("start_time")).alias("prefix"), F.sha2(whole, 256).alias("digest"))


def chat_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Training records in chat markup, with image marks expanded: length and digest."""
    rows = v.table(spark, sf, "train_sft").where("sample_id is not null").select("sample_id", "user_text", "assistant_text", "num_frames").distinct()
    chat = prompts.chat(F.coalesce("user_text", F.lit("")), F.coalesce("assistant_text", F.lit("")))
    return rows.select("sample_id", prompts.placeholders(chat).alias("n_marks"), F.char_length(prompts.expanded(chat, 4)).cast("bigint").alias("n_chars"), F.sha2(chat, 256).alias("digest"))


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Tile grids of image sizes derived from part keys: columns, rows, patches and the platform's size."""
    p = v.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 1900 + 64).cast("int").alias("width"), (F.col("p_partkey") * 7 % 1100 + 64).cast("int").alias("height"))
    p = p.withColumn("grid", tiles.best_grid(F.col("width"), F.col("height"), 4)).withColumn("size", tiles.platform_size(F.col("width"), F.col("height")))
    return p.select("p_partkey", "width", "height", "grid.cols", "grid.rows", tiles.patch_count(F.col("grid")).alias("patches"), F.size(tiles.tile_boxes(F.col("grid"))).alias("n_boxes"), F.col("size.width").alias("platform_width"), F.col("size.height").alias("platform_height"))


QUERIES = {"answer_normalize": answer_normalize, "fo_classes": fo_classes, "label_keys": label_keys, "capability_codes": capability_codes, "request_prompts": request_prompts, "single_image_prompts": single_image_prompts, "chat_texts": chat_texts, "tile_grid": tile_grid}

# --- SQL ------------------------------------------------------------------------

_NAMES = "[" + ", ".join(f"'{n}'" for n in an.CLASS_NAMES) + "]"
_STRIP = lambda x: f"regexp_replace({x}, '^@WS@+|@WS@+$', '', 'g')"
_ANSWER = f"""with {v.ANSWERS},
n0 as (select qid, {_STRIP('answer')} as s from an where answer is not null),
n1 as (select *, regexp_replace(s, '[.!?;:]+@WS@*$', '') as c from n0),
n2 as (select *, [x for x in [{_STRIP('y')} for y in string_split(c, ',')] if x <> ''] as items from n1),
n3 as (select *, [replace(lower(x), 'ß', 'ss') for x in items] as low from n2),
n4 as (select *, [list_filter({_NAMES}, lambda n_: lower(n_) = x)[1] for x in low] as spelled from n3),
n5 as (select *, case when len(items) > 0 and len(list_filter(items, lambda x: not regexp_full_match(x, '\\d{{2}}:[0-5]\\d:[0-5]\\d'))) = 0 then array_to_string(items, ', ') end as times,
  case when len(items) = 1 and low[1] = 'none' then 'none' when len(items) > 0 and len(list_filter(spelled, lambda x: x is null)) = 0 then array_to_string([x for x, i in spelled if list_position(spelled, x) = i], ', ') end as classes from n4)
select qid, case when s = '' then '' when regexp_full_match(c, '(?i)yes|no') then lower(c) when regexp_full_match(c, '\\d+') then c when regexp_full_match(c, '\\d+(?:\\.\\d+)?\\s*%?') then regexp_replace(c, '\\s+%', '%', 'g') else coalesce(times, classes, s) end as normalized,
  case when s = '' then 'blank' when regexp_full_match(c, '(?i)yes|no') then 'binary' when regexp_full_match(c, '\\d+') then 'count' when regexp_full_match(c, '\\d+(?:\\.\\d+)?\\s*%?') then 'percentage' when times is not null then 'time' when classes = 'none' then 'none' when classes is not null then 'classes' else 'open' end as kind from n5"""
_SLUG = r"substr(coalesce(nullif(trim(regexp_replace({}, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'video'), 1, 60)"
_STEM = r"regexp_replace(video, '^(.+)\.[^.]+$', '\1')"
_TOKEN = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '_')"
_PROMPT = f"""with {v.REQUESTS},
pr0 as (select *, range(greatest(1, ceil((end_time - start_time) - 1e-9)::bigint)) as t, end_time - start_time as d from rq),
pr1 as (select *, {v.cap_sql('t', '32')} as c from pr0),
pr2 as (select *, [{v.clock_sql('floor(start_time + x)::bigint')} for x in c] as labels from pr1),
pr as (select *, array_to_string([x || ': <image>' || chr(10) for x in labels], '') || 'The input consists of ' || len(c)::varchar || case when len(c) >= 32 and d > 32
   then ' chronologically ordered frames uniformly selected across the ' || format('{{:g}}', d) || '-second trimmed video segment after sampling at 1 fps.'
   else ' chronologically ordered frames sampled at 1 fps from the ' || format('{{:g}}', d) || '-second trimmed video segment.' end || chr(10) || chr(10)
  || 'Current request:' || chr(10) || 'Procedure type: ' || coalesce(procedure, 'Unknown') || chr(10) || 'Question: ' || {_STRIP('question')} || chr(10) || 'Answer:' as prompt from pr2)
"""
_GRIDS = ", ".join(f"({i}, {c}, {r})" for i, (c, r) in enumerate(tiles.grids(4)))
_CODES = "map {" + ", ".join(f"'{k}': '{c}'" for k, c in capabilities.CODES.items()) + "}"

ORACLES = {
    "answer_normalize": _ANSWER,
    "fo_classes": f"select unnest(range({len(an.CLASS_NAMES)})) as pos, unnest({_NAMES}) as name, '{', '.join(an.CLASS_NAMES[:-1])}, and {an.CLASS_NAMES[-1]}' as listing",
    "label_keys": f"with {v.REQUESTS}, d as (select distinct dataset, video from rq) select dataset, video, {_STEM} as stem, {_SLUG.format('video')} as slug, {_TOKEN.format('video')} as token, {_SLUG.format(_STEM)} || '_' || substr(sha1(dataset || '|' || video), 1, 12) as folder from d",
    "capability_codes": f"""with {v.RESULTS}, g as (select primary_capability, primary_capability_value, capability_group, count(*) as n_rows from rs group by all),
 h as (select *, coalesce(nullif(primary_capability, ''), {_CODES}[primary_capability_value], primary_capability_value) as code, {_TOKEN.format('capability_group')} as t from g)
 select primary_capability, primary_capability_value, capability_group, code, substr(code, 1, 1) as code_group, case when t like '%object!_recognition%' escape '!' then 'object_recognition' when t like '%temporal!_grounding%' escape '!' then 'temporal_grounding'
  when t = 'aggregation' or t like '%!_aggregation' escape '!' then 'aggregation' when t like '%event!_understanding%' escape '!' or t like '%event!_and!_procedural!_understanding%' escape '!' then 'event_understanding' when t like '%complex!_reasoning%' escape '!' then 'complex_reasoning' end as metric_group, n_rows from h""",
    "request_prompts": _PROMPT + "select qid, len(labels) as n_frames, labels[1] as first_label, labels[-1] as last_label, (length(prompt) - length(replace(prompt, '<image>', ''))) // 7 as n_marks, length(prompt) as n_chars, sha256(prompt) as digest from pr",
    "single_image_prompts": f"with {v.REQUESTS}, p as (select *, 'Image at ' || {v.clock_sql('floor(start_time)::bigint')} || ': <image>' || chr(10) as prefix from rq) select qid, prefix, sha256(prefix || 'Current request:' || chr(10) || 'Procedure type: ' || coalesce(procedure, 'Unknown') || chr(10) || 'Question: ' || {_STRIP('question')} || chr(10) || 'Answer:') as digest from p",
    "chat_texts": """with t as (select distinct sample_id, user_text, assistant_text, num_frames from train_sft where sample_id is not null),
 c as (select *, '<|im_start|>user' || chr(10) || coalesce(user_text, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || coalesce(assistant_text, '') || '<|im_end|>' || chr(10) as chat from t)
 select sample_id, (length(chat) - length(replace(chat, '<image>', ''))) // 7 as n_marks, length(replace(chat, '<image>', '<img>' || repeat('<IMG_CONTEXT>', 4) || '</img>')) as n_chars, sha256(chat) as digest from c""",
    "tile_grid": f"""with p as (select p_partkey, (p_partkey % 1900 + 64)::int as width, (p_partkey * 7 % 1100 + 64)::int as height from part),
 g(k, cols, rows) as (values {_GRIDS}),
 x as (select *, abs(width / height - cols / rows) as far, width * height > 0.5 * 448 * 448 * cols * rows as large from p, g),
 m as (select *, min(far) over (partition by p_partkey) as best from x),
 e as (select *, row_number() over (partition by p_partkey order by k) as n from m where far = best),
 w as (select p_partkey, width, height, coalesce(max(k) filter (where n > 1 and large), min(k)) as k from e group by all)
 select p_partkey, width, height, g.cols, g.rows, (g.cols * g.rows + case when g.cols * g.rows > 1 then 1 else 0 end) as patches, g.cols * g.rows as n_boxes,
  greatest(2, round_even(width * (greatest(2, least(height, 576) - least(height, 576) % 2)) / height / 2, 0)::int * 2) as platform_width, greatest(2, least(height, 576) - least(height, 576) % 2) as platform_height from w join g using (k)""",
}
ORACLES = v.with_white_space(ORACLES)
