"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.operators.contracts import ContractError, enforce, repeated_keys

REQUEST = "qID string, videoID string, start_time double, end_time double, procedure_type string, question string"
RESPONSE = "qID string, content string, latency double"
REFERENCE = "qID string, answer string, _format string, format struct<type:string>, primary struct<code:string,value:string,group:string>, secondaries array<struct<code:string,value:string>>, ood boolean, clinical boolean"
BATCH = "qIDs array<string>, batch_size bigint, layout map<string,string>"
SFT = "sample_id string, qID string, dataset string, split string, images array<string>, frame_labels array<string>, num_frames bigint, user_text string, assistant_text string, metadata struct<answer_format:string,primary_capability:string,capability_group:string,secondary_capabilities:array<string>,ood:boolean,clinical:boolean,candidate_count_1fps:bigint>"
LOG_FIELDS = ("qid", "status", "latency", "error_type")


def require_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document that holds an array of objects; malformed ones fail."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def requests(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, REQUEST)


def responses(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, RESPONSE)


def references(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, REFERENCE)


def batch(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, BATCH)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, anything but an object fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = ~F.trim("value").startswith("{")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80)))).otherwise(F.col("value"))
    parsed = F.from_json(checked, schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): lines that are neither blank nor an object, with their number from 1.

    Lines have no number while files are read in pieces, so only files that hold
    a bad line are read once more, whole, to count.
    """
    bad = (F.trim("value") != "") & F.coalesce(F.expr("schema_of_variant(try_parse_json(value)) not like 'OBJECT%'"), F.lit(True))
    files = [r[0] for r in spark.read.text(path).where(bad).select("_metadata.file_path").distinct().limit(1000).collect()]
    if not files:
        return spark.createDataFrame([], "file string, line int, text string")
    lines = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("n", "value"))
    return lines.where(bad).select("file", (F.col("n") + 1).alias("line"), F.substring("value", 1, 80).alias("text"))


def checked_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``json_lines``, but bad lines are looked for first and named with file and number."""
    some = bad_json_lines(spark, path).orderBy("file", "line").limit(5).collect()
    if some:
        raise ContractError("; ".join(f"{r['file']} line {r['line']}: {r['text']}" for r in some))
    return json_lines(spark, path, schema)


def scalar_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): a document that is one JSON string; '' for an empty file or null, anything else fails."""
    raw = spark.read.text(path, wholetext=True)
    kind = F.when(F.trim("value").isin("", "null"), "none").when(F.expr("schema_of_variant(try_parse_json(value)) = 'STRING'"), "string")
    text = F.when(kind == "none", "").when(kind == "string", F.expr("try_variant_get(try_parse_json(value), '$', 'string')")).otherwise(F.raise_error(F.lit("the document is not a string")))
    return raw.select(text.alias("text"))


def csv_log(spark: SparkSession, path: str, fields: tuple[str, ...] = LOG_FIELDS, unique: bool = True) -> DataFrame:
    """A log with a header: all cells text, '' for missing ones; rows without a key are skipped, a repeated key is an error."""
    head = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    require_columns(head, fields)
    rows = head.select(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))
    rows = rows.where(F.trim(fields[0]) != "")
    if unique:
        enforce(repeated_keys(rows, fields[0]))
    return rows


def id_list(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(pos, qid): a JSON array of identifiers in order; none blank or repeated, and so many if ``number`` is given."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "qid"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("qid", F.lit(""))) == "").alias("blank"), F.count_distinct("qid").alias("distinct")).first()
    if facts["blank"] or facts["distinct"] != facts["n"] or (number is not None and facts["n"] != number):
        raise ContractError(f"{facts['n']} identifiers, {facts['blank']} blank, {facts['distinct']} distinct, {number} expected")
    return rows


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length): files of a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def name_index(files: DataFrame, name: str = "name") -> DataFrame:
    """(key, kind, name, n_names): each name by itself (exact) and in lower case (lower, the least of those that differ in case only)."""
    names = files.select(F.col(name).alias("name")).where("name is not null").distinct()
    keys = F.array(F.struct(F.lit("exact").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("lower").alias("kind"), F.lower("name").alias("key")))
    return names.select("name", F.explode(keys).alias("k")).groupBy(F.col("k.key").alias("key"), F.col("k.kind").alias("kind")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n_names"))


def png_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, is_png): by the first eight bytes."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", "length", (F.substring("content", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))).alias("is_png"))


def jpeg_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content): files of a cache of JPEGs; one without the format's first bytes is an error when it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jp*g").load(folder)
    sound = F.substring("content", 1, 3) == F.unhex(F.lit("FFD8FF"))
    return files.select("path", "length", F.when(sound, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not a JPEG: "), "path"))).alias("content"))


def annotated(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """Rows of one dataset and split of a partitioned table; other partitions are not read."""
    return spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("split") == split))


@dataclass(frozen=True)
class Paths:
    source: str
    target: str


def resolve_paths(default: Paths, environment: dict[str, str] | None = None, source: str = "QALOOM_INPUT", target: str = "QALOOM_OUTPUT") -> Paths:
    """Both paths from the environment, or neither."""
    env = os.environ if environment is None else environment
    given = env.get(source), env.get(target)
    if all(given):
        return Paths(*given)
    if any(given):
        raise ContractError(f"set both {source} and {target}, or neither")
    return default


def fields(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)
