"""A sample that matches target category proportions.

Systematic unequal-probability sampling.  Records lie in sorted categories, in
random order within each; inclusion probabilities are summed up along this line
and one random start decides whose step crosses a whole number.  Then floors are
repaired: a category below its minimum, or below its share rounded up, takes its
next records in order.

The probabilities of a category are equal, so the sum before a record follows
from its rank.  Ranks come from two levels: records are hashed into buckets of
about ``bucket_rows``, the small table of bucket sizes is summed up, and only
the records of one bucket are ever sorted together, so a category may hold any
part of all rows.  All sums are whole numbers in decimal(38,0): the sample is
the same for every layout.

Defined results: identifiers are distinct, a record's category is the least of
its non-null ones, null and blank categories are none and don't count; a
category without a target is not sampled; one with fewer records than wanted is
taken whole and reported as not met.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import label

MOST_TARGETS = 10_000
_WHOLE = "decimal(38,0)"


def categorised(rows: DataFrame, record_id: str, category: str) -> DataFrame:
    """(id, category): each record once."""
    r = rows.select(F.col(record_id).alias("id"), label(F.col(category)).alias("category"))
    return r.where("id is not null and category is not null").groupBy("id").agg(F.min("category").alias("category"))


def sampling_plan(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, label, target_pct, min_rows, sample_pct, available, all_records, wanted, met): one row per target.

    targets: (label, target_pct, min_rows, sample_pct); repeated rows count once.
    """
    t = targets.select(F.col("label"), label(F.col("label")).alias("category"), "target_pct", "min_rows", "sample_pct").where("category is not null").distinct()
    counts = records.where("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    everything = counts.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("all_records"))
    plan = t.join(counts, "category", "left").withColumn("available", F.coalesce("available", F.lit(0))).crossJoin(F.broadcast(everything))  # one row
    share = F.expr("(cast(target_pct as bigint) * sample_pct * all_records + 9999) div 10000")
    plan = plan.withColumn("wanted", F.greatest(F.coalesce(F.col("min_rows").cast("bigint"), F.lit(0)), F.coalesce(share, F.lit(0))))
    return plan.withColumn("met", F.col("available") >= F.col("wanted"))


def start(seed: int) -> int:
    """The random start of the sampling step, in 10000ths."""
    return int(hashlib.md5(f"start:{seed}".encode()).hexdigest()[:12], 16) % 10_000


def proportional_sample(records: DataFrame, targets: DataFrame, seed: int = 1, bucket_rows: int = 50_000, planned: DataFrame | None = None) -> DataFrame:
    """(id, category, how): records drawn, ``crossing`` or ``floor``.  planned: the ``sampling_plan``, if it is there already."""
    records = records.select("id", "category").where("id is not null and category is not null")
    planned = sampling_plan(records, targets) if planned is None else planned
    # N_c * 10000 * probability: of a short category everything is taken
    plan = planned.groupBy("category").agg(F.max("available").alias("available"), F.max("wanted").alias("wanted"), F.max(F.struct("target_pct", "sample_pct", "min_rows", "all_records")).alias("t"))
    quota = F.least(F.col("available").cast(_WHOLE) * 10000, F.col("t.target_pct").cast(_WHOLE) * F.col("t.sample_pct").cast("int") * F.col("t.all_records"))
    plan = plan.select("category", "available", F.coalesce(quota, F.lit(0)).cast(_WHOLE).alias("quota"), F.least("available", "wanted").alias("floor"))
    line = Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)  # over the targets only
    plan = plan.withColumn("base", F.coalesce(F.sum("quota").over(line), F.lit(0)).cast(_WHOLE) + F.lit(start(seed)).cast(_WHOLE))
    plan = plan.where("available > 0")

    small = targets.count() <= MOST_TARGETS
    order = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("bigint")  # 60 bits
    rows = records.join(F.broadcast(plan) if small else plan, "category").withColumn("order", order)
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("available") / bucket_rows)).cast("bigint")
    # buckets are slices of the hash's range, so that their order is the order of the hash
    rows = rows.withColumn("bucket", F.floor(F.col("order") / F.lit(float(2**60)) * n_buckets).cast("bigint"))
    sizes = rows.groupBy("category", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("category", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("category", "bucket").orderBy("order", "id")
    ranked = rows.withColumn("in_bucket", F.row_number().over(within)).join(offsets, ["category", "bucket"])

    crossed = lambda rank: F.expr(f"cast(((base * available) + ({rank}) * quota) div (cast(available as {_WHOLE}) * 10000) as bigint)")
    ranked = ranked.withColumn("rank", (F.col("offset") + F.col("in_bucket")).cast("bigint"))
    ranked = ranked.withColumn("here", crossed("rank")).withColumn("until", crossed("rank - 1")).withColumn("start", crossed("0")).withColumn("end", crossed("available"))
    chosen = F.col("here") > F.col("until")
    lacking = F.col("floor") - (F.col("end") - F.col("start"))
    passed_over = F.col("rank") - (F.col("here") - F.col("start"))  # records up to here that were not chosen
    how = F.when(chosen, "crossing").when(passed_over <= lacking, "floor")
    return ranked.select("id", "category", how.alias("how")).where("how is not null")
