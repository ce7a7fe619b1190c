"""Scored reports.  Whether an answer is correct is an input column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import blank


def scored(rows: DataFrame, by: list[str | Column], correct: str = "correctness") -> DataFrame:
    """Group columns, correct, count, accuracy; null keys are groups."""
    ok = F.col(correct).cast("int")
    return rows.groupBy(*by).agg(F.coalesce(F.sum(ok), F.lit(0)).alias("correct"), F.count(F.lit(1)).alias("count"), F.avg(F.coalesce(ok, F.lit(0))).alias("accuracy"))


def scored_sets(rows: DataFrame, sets: dict[str, list[str]], correct: str = "correctness") -> DataFrame:
    """All summaries in one pass: report, key (values joined by ``|``), correct, count, accuracy.

    The rows are expanded once per report before the partial aggregation, so
    the exchange carries only group totals.
    """
    keys = F.array(*(F.struct(F.lit(name).alias("report"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("key")) for name, columns in sets.items()))
    return scored(rows.select(F.col(correct).alias("correctness"), F.explode(keys).alias("k")).select("correctness", "k.report", "k.key"), ["report", "key"])


def buckets(rows: DataFrame, group: str = "capability_group", ood: str = "ood") -> DataFrame:
    """bucket_name, capability_group, distribution and scores of each group, in and out of distribution."""
    distribution = F.when(F.col(ood), "ood").otherwise("id")
    s = scored(rows.select(F.col(group).alias("capability_group"), distribution.alias("distribution"), "correctness"), ["capability_group", "distribution"])
    return s.select(F.concat_ws("_", "distribution", F.coalesce("capability_group", F.lit("none"))).alias("bucket_name"), "capability_group", "distribution", "correct", "count", "accuracy")


def overall(rows: DataFrame, bucket_scores: DataFrame) -> DataFrame:
    """One row: macro (mean of bucket accuracies), micro, per kind of scoring, and counts of conditions."""
    c = F.col("correctness").cast("int")
    judged, fixed = F.col("scoring_method") == "llm_judge", F.col("scoring_method") == "deterministic"
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("n_correct"), F.count_if(~F.col("correctness")).alias("n_incorrect"), F.count_if(~F.col("format_valid")).alias("n_invalid_format"),
        F.count_if(blank(F.col("candidate_answer"))).alias("n_blank"), F.count_if("timed_out").alias("n_timed_out"),
        F.avg(c).alias("micro"), F.avg(F.when(judged, c)).alias("judged_accuracy"), F.count_if(judged).alias("n_judged"), F.avg(F.when(fixed, c)).alias("fixed_accuracy"), F.count_if(fixed).alias("n_fixed"),
        F.avg("latency_s").alias("mean_latency_s"),
    )
    macro = bucket_scores.agg(F.avg("accuracy").alias("macro"))
    return one.crossJoin(macro)  # one row each


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, count of several columns in one pass; null as ''."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.column").alias("column"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def in_given_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows sorted by an explicit list of values, others last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def consistency(rows: DataFrame, bucket_scores: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(n_buckets, equal_sizes, agree): whether micro and macro mean agree, as they must where all buckets are of one size."""
    b = bucket_scores.agg(F.count(F.lit(1)).alias("n_buckets"), (F.min("count") == F.max("count")).alias("equal_sizes"), F.avg("accuracy").alias("macro"))
    both = rows.agg(F.avg(F.col("correctness").cast("int")).alias("micro")).crossJoin(b)  # one row each
    return both.select("n_buckets", "equal_sizes", (~F.col("equal_sizes") | (F.abs(F.col("micro") - F.col("macro")) <= tolerance)).alias("agree"))


def bootstrap(scores: DataFrame, key: str, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(key, count, accuracy, low, high): percentile interval of each accuracy under resampling with replacement.

    scores: key, correct, count.  Answers are right or wrong, so the right ones
    of a resample are binomially distributed and nothing but the counts is drawn
    from: the cost doesn't depend on the rows.
    """
    edges = [50 * (1 - level), 50 * (1 + level)]

    def work(batches):
        for b in batches:
            out = []
            for k, c, n in zip(b["key"], b["correct"], b["count"]):
                rng = np.random.Generator(np.random.PCG64([seed, *str(k).encode()]))
                low, high = np.percentile(rng.binomial(int(n), c / n, draws) / n, edges)
                out.append((k, int(n), c / n, float(low), float(high)))
            yield pd.DataFrame(out, columns=[key, "count", "accuracy", "low", "high"])

    rows = scores.where("count > 0").select(F.col(key).cast("string").alias("key"), "correct", "count")
    return rows.mapInPandas(work, f"{key} string, count long, accuracy double, low double, high double")
