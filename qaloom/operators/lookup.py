"""Lookup joins: by key in a given order, and by several ways of naming the same thing."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.operators.lineage import cut


def in_order(ids: DataFrame, rows: DataFrame, key: str, position: str = "pos", missing: str = "drop") -> DataFrame:
    """Rows of the listed keys, with the list's position; a key without a row is left out (drop), kept with nulls (null) or an error (fail)."""
    out = ids.join(rows.withColumn("_there", F.lit(True)), key, "inner" if missing == "drop" else "left")
    if missing == "fail":
        out = out.withColumn(position, F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.col(position)))
    return out.drop("_there")


def resolve(names: DataFrame, name: str, files: DataFrame, file: str) -> DataFrame:
    """names with ``file`` and ``how``: the exact file name, else one equal but for letter case, else the only one with the same leading number.

    ``how`` is exact, case, prefix, ambiguous (several files with the number) or missing.  Each way is an equi-join on a
    key that files have at most once, so no row is repeated.
    """
    prefix = lambda c: F.nullif(F.regexp_extract(c, r"^(\d{4})\b", 1), F.lit(""))
    f = files.select(F.col(file).alias("f")).where("f is not null").distinct()
    by_case = f.groupBy(F.lower("f").alias("k_case")).agg(F.min("f").alias("f_case"))
    by_prefix = f.withColumn("k_prefix", prefix(F.col("f"))).where("k_prefix is not null").groupBy("k_prefix").agg(F.min("f").alias("f_prefix"), F.count(F.lit(1)).alias("n_prefix"))
    exact = f.select(F.col("f").alias("k_exact"), F.col("f").alias("f_exact"))
    n = names.withColumn("k_exact", F.col(name)).withColumn("k_case", F.lower(F.col(name))).withColumn("k_prefix", prefix(F.col(name)))
    out = n.join(exact, "k_exact", "left").join(by_case, "k_case", "left").join(by_prefix, "k_prefix", "left")
    how = F.when(F.col("f_exact").isNotNull(), "exact").when(F.col("f_case").isNotNull(), "case").when(F.col("n_prefix") == 1, "prefix").when(F.col("n_prefix") > 1, "ambiguous").otherwise("missing")
    found = F.coalesce("f_exact", "f_case", F.when(F.col("n_prefix") == 1, F.col("f_prefix")))
    return out.select(*names.columns, found.alias("file"), how.alias("how"))


def first_groups(rows: DataFrame, parts: list[str], group: str, most: int) -> DataFrame:
    """Rows of the first ``most`` groups (by name) of each part.

    Groups are ranked once each, not once per row, and a part's groups are few
    next to its rows.
    """
    groups = rows.select(*parts, group).where(F.col(group).isNotNull()).distinct()
    ranked = groups.withColumn("_rank", F.row_number().over(Window.partitionBy(*parts).orderBy(group))).where(F.col("_rank") <= most).drop("_rank")
    return rows.join(ranked, [*parts, group], "left_semi")


def numbered(rows: DataFrame, parts: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Adds the number of each row within its part, from 0, in order, in place of a column of that name; null is a part of its own.

    Rows are laid out by ranges of part and order and written, so a part of any
    size lies in many pieces; numbers come from the rows of one piece and the
    small table of the pieces' sizes.  With no part, all rows are numbered.
    """
    laid = cut(rows.repartitionByRange(*parts, *order).withColumn("_piece", F.spark_partition_id()))
    key = [*parts, "_piece"]
    sizes = laid.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*parts).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in key), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = laid.withColumn("_own", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key))
    return own.join(sizes, same).select(*(c for c in rows.columns if c != name), (F.col("_before") + F.col("_own")).cast("bigint").alias(name))


def chunked(rows: DataFrame, part: str, order: list[str], size: int) -> DataFrame:
    """Adds ``chunk``: groups of ``size`` rows of a part, in order."""
    return numbered(rows, [part], order, "chunk").withColumn("chunk", F.floor(F.col("chunk") / size).cast("bigint"))


def seeded_order(key: str, seed: int, epoch: int = 0) -> Column:
    """A sort key that shuffles rows by seed and epoch, the same for every layout."""
    return F.md5(F.concat_ws(":", F.col(key), F.lit(str(seed + epoch))))


def every(rows: DataFrame, parts: list[str], order: list[str], k: int) -> DataFrame:
    """Each k-th row of a part in order, with its number from 1: the marks of a progress report."""
    return numbered(rows, parts, order).withColumn("number", F.col("number") + 1).where(F.col("number") % k == 0)
