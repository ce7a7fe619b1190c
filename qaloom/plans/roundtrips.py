"""Readers and writers, each as a query: a table is written below the checkpoint folder, read back and compared with SQL on the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import answers as an
from qaloom.operators.contracts import ContractError
from qaloom.operators.lineage import scratch
from qaloom.plans import manifests, scores, texts
from qaloom.plans import views as v
from qaloom.sources import readers, sinks


def _number(c: str) -> Column:
    """JSON has no NaN and no infinity."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)


def source_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as documents of arrays."""
    folder = scratch(spark, "requests")
    rows = v.table(spark, sf, "request").select(F.col("qid").alias("qID"), F.col("videoid").alias("videoID"), _number("start_time"), _number("end_time"), "procedure_type", "question").distinct()
    sinks.json_document(rows, folder)
    return readers.requests(spark, folder).select(F.col("qID").alias("qid"), F.col("videoID").alias("videoid"), "start_time", "end_time", "procedure_type", "question")


def source_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as one document."""
    folder = scratch(spark, "responses")
    sinks.json_document(v.table(spark, sf, "responses").select(F.col("qid").alias("qID"), F.col("answer").alias("content"), "latency").distinct(), folder, files=1)
    return readers.responses(spark, folder).select(F.col("qID").alias("qid"), "content", "latency")


def source_references(spark: SparkSession, sf: str) -> DataFrame:
    """References with nested capabilities; some name their format only inside it."""
    folder = scratch(spark, "references")
    r = v.results(spark, sf)
    inside = F.right("qid", F.lit(1)).isin("0", "1", "2", "3", "4")
    primary = F.struct(F.col("primary_capability").alias("code"), F.col("primary_capability_value").alias("value"), F.col("capability_group").alias("group"))
    rows = r.select(
        F.col("qid").alias("qID"), F.col("reference_answer").alias("answer"), F.when(~inside, F.col("answer_format")).alias("_format"), F.struct(F.col("answer_format").alias("type")).alias("format"), primary.alias("primary"),
        F.array(F.struct(F.col("primary_capability").alias("code"), F.col("dataset").alias("value"))).alias("secondaries"), "ood", "clinical",
    )
    sinks.json_document(rows, folder)
    back = readers.references(spark, folder)
    return back.select(F.col("qID").alias("qid"), "answer", an.format_name(F.col("_format"), F.col("format")).alias("answer_format"), "primary.code", "primary.value", F.col("primary.group").alias("capability_group"), F.array_join(F.transform("secondaries", lambda x: F.concat_ws("=", x["code"], x["value"])), ";").alias("secondary"), "ood", "clinical")


def source_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Training records one a line; their number is checked when they are written."""
    folder = scratch(spark, "jsonl")
    rows = v.table(spark, sf, "train_sft").withColumnRenamed("qid", "qID").distinct()
    sinks.json_lines(rows, folder, expected=rows.count())
    back = readers.checked_json_lines(spark, folder, readers.SFT)
    return back.select("sample_id", F.col("qID").alias("qid"), "dataset", "split", F.array_join("images", ";").alias("images"), F.array_join("frame_labels", ";").alias("labels"), "num_frames", "user_text", "assistant_text", "metadata.answer_format", "metadata.ood", F.col("metadata.candidate_count_1fps").alias("candidate_count"))


def source_csv_log(spark: SparkSession, sf: str) -> DataFrame:
    """The inference log as ordered CSV files."""
    folder = scratch(spark, "log")
    sinks.csv(v.log(spark, sf), folder, order=["qid"])
    return readers.csv_log(spark, folder)


def source_id_list(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn identifiers as one document, in order and each once."""
    folder = scratch(spark, "ids")
    drawn = scores._selected(spark, sf)
    sinks.id_document(drawn, folder)
    return readers.id_list(spark, folder, drawn.count()).select(F.col("pos").cast("bigint").alias("pos"), "qid")


def source_text(spark: SparkSession, sf: str) -> DataFrame:
    """A document that is one JSON string: the definitions."""
    folder = scratch(spark, "text")
    spark.range(1).select(F.lit(texts.DEFINITIONS).alias("t")).select(F.expr("substring(to_json(array(t)), 2, length(to_json(array(t))) - 2)").alias("value")).coalesce(1).write.mode("overwrite").text(folder)
    return readers.scalar_text(spark, f"{folder}/part-*").select("text")


def source_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of questions of a procedure, as objects with a list and a map."""
    folder = scratch(spark, "batches")
    r = v.requests(spark, sf).groupBy("dataset", "procedure").agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("a"), F.max("qid").alias("b"))
    sinks.json_document(r.select(F.array("a", "b").alias("qIDs"), F.col("n").alias("batch_size"), F.create_map(F.lit("dataset"), F.col("dataset"), F.lit("procedure"), F.coalesce("procedure", F.lit(""))).alias("layout")), folder)
    return readers.batch(spark, folder).select(F.get("qIDs", 0).alias("first_id"), F.get("qIDs", 1).alias("last_id"), "batch_size", F.col("layout.dataset").alias("dataset"), F.col("layout.procedure").alias("procedure"))


def name_index(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the corpus's videos as an index of a folder has them."""
    return readers.name_index(v.table(spark, sf, "documents").select(F.col("videoid").alias("name")))


def split_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Per manifest: records, and the first and last of them."""
    folder = scratch(spark, "manifests")
    rows = manifests._samples(spark, sf).select("sample_id", "dataset", "split", "num_frames")
    out = None
    for name in sinks.split_manifests(rows, folder):
        back = spark.read.schema("sample_id string, dataset string, split string, num_frames bigint").json(f"{folder}/{name}")
        part = back.agg(F.lit(name).alias("manifest"), F.count(F.lit(1)).alias("n_records"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"), F.sum("num_frames").alias("n_frames"))
        out = part if out is None else out.unionByName(part)
    return out


def annotated_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset and split of a table partitioned by both; no other partition is read."""
    folder = scratch(spark, "annotated")
    rows = manifests._samples(spark, sf).where("dataset is not null and split is not null").select("sample_id", "dataset", "split", "num_frames")
    rows.write.mode("overwrite").partitionBy("dataset", "split").parquet(folder)
    return readers.annotated(spark, folder, "heico", "train").select("sample_id", "num_frames")


def run_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The three outputs of a run, written and read back: rows of each."""
    folder = scratch(spark, "run")
    log = v.log(spark, sf)
    sinks.checkpoint(v.answers(spark, sf), log, log.where(F.lower(F.trim("status")) == "failed"), folder)
    counts = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("n"), F.min("qid").alias("first_id")) for n in ("responses", "log", "failures")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def refuse_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Writing to the same place twice: the second is refused, and the first stays whole."""
    folder = scratch(spark, "new")
    sinks.new_only(v.table(spark, sf, "region").select("r_regionkey", "r_name"), folder)
    try:
        sinks.new_only(v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")), folder)
        refused = False
    except Exception as e:  # noqa: BLE001 - Spark's own error of an existing path, any other is one to see
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise ContractError(str(e)) from e
        refused = True
    return spark.read.schema("r_regionkey bigint, r_name string").json(folder).withColumn("refused", F.lit(refused))


REPORTS = ("detailed_results", "bucket_scores", "format_scores", "leaf_scores", "dataset_scores", "procedure_scores", "status_scores", "macro_micro", "value_counts", "wrong_or_invalid", "error_heads")


def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """All reports as CSV: rows of each, as read back."""
    folder = scratch(spark, "reports")
    sinks.reports({n: scores.QUERIES[n](spark, sf) for n in REPORTS}, folder)
    out = None
    for n in REPORTS:
        part = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{n}").agg(F.lit(n).alias("report"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "source_requests": source_requests, "source_responses": source_responses, "source_references": source_references, "source_jsonl": source_jsonl, "source_csv_log": source_csv_log, "source_id_list": source_id_list, "source_text": source_text, "source_batch": source_batch,
    "name_index": name_index, "split_manifests": split_manifests, "annotated_scan": annotated_scan, "run_checkpoint": run_checkpoint, "refuse_overwrite": refuse_overwrite, "report_files": report_files,
}

# --- SQL ------------------------------------------------------------------------

_FINITE = "case when isfinite({0}) then {0} end as {0}"
_SELECTED = f"(select {manifests._LOWQ} as qid, min(pos) as pos from selected_qids where {manifests._LOWQ} is not null and pos is not null group by 1)"
_TEXT = texts.DEFINITIONS.replace("'", "''")
ORACLES = {
    "source_requests": f"select distinct qid, videoid, {_FINITE.format('start_time')}, {_FINITE.format('end_time')}, procedure_type, question from request",
    "source_responses": "select distinct qid, answer as content, latency from responses",
    "source_references": f"with {v.RESULTS} select qid, reference_answer as answer, coalesce(answer_format, '') as answer_format, primary_capability as code, primary_capability_value as value, capability_group, concat_ws('=', primary_capability, dataset) as secondary, ood, clinical from rs",
    "source_jsonl": "with d as (select distinct * from train_sft) select sample_id, qid, dataset, split, array_to_string(images, ';') as images, array_to_string(frame_labels, ';') as labels, num_frames, user_text, assistant_text, metadata.answer_format as answer_format, metadata.ood as ood, metadata.candidate_count_1fps as candidate_count from d",
    "source_csv_log": f"with {v.RESULTS},{v.LOG} select qid, status, latency, error_type from lg",
    "source_id_list": f"select row_number() over (order by pos) - 1 as pos, qid from {_SELECTED}",
    "source_text": f"select '{_TEXT}' as text",
    "source_batch": f"with {v.REQUESTS} select min(qid) as first_id, max(qid) as last_id, count(*) as batch_size, dataset, coalesce(procedure, '') as procedure from rq group by dataset, rq.procedure",
    "name_index": "with n as (select distinct videoid as name from documents where videoid is not null), k as (select name, name as key, 'exact' as kind from n union all select name, lower(name), 'lower' from n) select key, kind, min(name) as name, count(*) as n_names from k group by key, kind",
    "split_manifests": f"with {manifests._SAMPLES}, m as (select 'train' as manifest, * from sm where split = 'train' union all select 'val_' || dataset, * from sm where split = 'val' and dataset is not null union all select 'val_all', * from sm where split = 'val' and dataset is not null) select manifest, count(*) as n_records, min(sample_id) as first_id, max(sample_id) as last_id, sum(num_frames)::bigint as n_frames from m group by manifest",
    "annotated_scan": f"with {manifests._SAMPLES} select sample_id, num_frames from sm where dataset = 'heico' and split = 'train'",
    "run_checkpoint": f"with {v.ANSWERS},{v.RESULTS},{v.LOG} select 'responses' as output, count(*) as n, min(qid) as first_id from an union all select 'log', count(*), min(qid) from lg union all select 'failures', count(*), min(qid) from lg where lower(trim(status)) = 'failed'",
    "refuse_overwrite": "select r_regionkey::bigint as r_regionkey, r_name, true as refused from region",
    "report_files": " union all ".join(f"select '{n}' as report, count(*) as n_rows from ({scores.ORACLES[n]})" for n in REPORTS),
}
