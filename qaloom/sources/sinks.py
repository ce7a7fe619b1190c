"""Writers.  Spark's commit protocol makes each dataset appear whole or not at all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from qaloom.operators.contracts import ContractError


def json_lines(df: DataFrame, path: str, expected: int | None = None, mode: str = "overwrite") -> int:
    """Writes one object a line; the number of rows is counted on the way and checked if one is expected."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    n = seen.get["n"]
    if expected is not None and n != expected:
        raise ContractError(f"{n} rows written, {expected} expected")
    return n


def manifests(df: DataFrame, path: str) -> None:
    """One folder for each dataset and split."""
    df.write.mode("overwrite").partitionBy("dataset", "split").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text, for formats of plain cells."""
    nested = ("array", "map", "struct")
    return df.select(*(F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes))


def json_document(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON documents, each an array of objects: one for each partition, or so many as asked for (1 for the one that a single reader wants).

    Rows stream to their file, so a document may be of any length.
    """
    def work(batches):
        begun = False
        for batch in batches:
            if len(batch):
                lines = (("[" if not begun else ",") + batch["r"].iloc[:1]).tolist() + ("," + batch["r"].iloc[1:]).tolist()
                begun = True
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["]" if begun else "[]"]})

    rows = df.select(F.to_json(F.struct(*df.columns)).alias("r"))
    (rows.coalesce(files) if files else rows).mapInPandas(work, "value string").write.mode("overwrite").text(path)


def id_document(df: DataFrame, path: str, key: str = "qid", position: str = "pos") -> None:
    """One JSON array of identifiers in order of position; such a list is one file by its format."""
    place = df.select(F.to_json(F.array(key)).alias("r"), position).repartitionByRange(1, position).sortWithinPartitions(position).select(F.expr("substring(r, 2, length(r) - 2)").alias("r"))

    def work(batches):
        begun = False
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": (("[" if not begun else ",") + batch["r"].iloc[:1]).tolist() + ("," + batch["r"].iloc[1:]).tolist()})
                begun = True
        yield pd.DataFrame({"value": ["]" if begun else "[]"]})

    place.mapInPandas(work, "value string").write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, order: list[str | Column] | None = None, mode: str = "overwrite", files: int | None = None) -> None:
    """A CSV with a header; with an order, files that follow each other in it, or a single one if asked for."""
    rows = flat(df)
    if order:
        rows = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    rows.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(path)


def split_manifests(df: DataFrame, path: str, train: str = "train", held_out: str = "val") -> list[str]:
    """The manifests ``train``, ``val_<dataset>`` and ``val_all``, the last with the datasets in order; their names.

    Datasets are few; records of other splits are in none.
    """
    names = sorted(r[0] for r in df.where(F.col("split") == held_out).select("dataset").distinct().collect() if r[0])
    parts = {"train": df.where(F.col("split") == train)} | {f"val_{n}": df.where((F.col("split") == held_out) & (F.col("dataset") == n)) for n in names}
    parts["val_all"] = df.where((F.col("split") == held_out) & F.col("dataset").isNotNull()).orderBy("dataset")
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
    return list(parts)


def reports(frames: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder for each report."""
    for name, df in frames.items():
        csv(df, f"{folder}/{name}")


def new_only(df: DataFrame, path: str) -> None:
    """Fails if there is anything at the path."""
    df.write.mode("errorifexists").json(path)


def ordered_responses(requests: DataFrame, responses: DataFrame, missing: str = "default") -> DataFrame:
    """(pos, qid, content, latency) in the order of the requests (pos); a request without a response has the default '', is dropped, or fails."""
    rows = requests.select("pos", "qid").join(responses.select("qid", F.col("answer").alias("content"), "latency", F.lit(True).alias("_has")), "qid", "left")
    if missing == "drop":
        rows = rows.where("_has")
    elif missing == "fail":
        rows = rows.withColumn("pos", F.when(F.col("_has").isNull(), F.raise_error(F.concat(F.lit("no response for "), "qid"))).otherwise(F.col("pos")))
    return rows.select("pos", "qid", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("latency", F.lit(0.0)).alias("latency")).orderBy("pos")


def prediction_log(df: DataFrame) -> DataFrame:
    """Log rows as text cells: numbers with six places, '' for what is missing."""
    cell = lambda c, t: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.6f", c)) if t in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    return df.select(*(cell(c, t).alias(c) for c, t in df.dtypes))


def checkpoint(responses: DataFrame, log: DataFrame, failures: DataFrame, folder: str) -> None:
    """The three outputs of a run, each replaced as a whole."""
    for name, df in (("responses", responses), ("log", log), ("failures", failures)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
