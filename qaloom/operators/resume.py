"""Resuming a run: what is done, what failed, what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import as_double, blank


def _status() -> Column:
    return F.lower(F.trim("status"))


def completed(responses: DataFrame, log: DataFrame) -> DataFrame:
    """(qid): logged as success, or never logged but answered.

    Whether a question was logged shows in the presence of its row, not in its
    status: an empty cell is a status too.
    """
    one = log.groupBy("qid").agg(F.max((_status() == "success").cast("int")).alias("ok"))
    both = responses.select("qid", "answer").join(one, "qid", "full_outer")
    done = (F.coalesce(F.col("ok"), F.lit(-1)) == 1) | (F.col("ok").isNull() & ~blank(F.col("answer")))
    return both.where(done).select("qid").distinct()


def pending(requests: DataFrame, responses: DataFrame, log: DataFrame) -> DataFrame:
    """Requests still to be answered."""
    return requests.join(completed(responses, log), "qid", "left_anti")


def failed(log: DataFrame) -> DataFrame:
    return log.where(_status() == "failed").select("qid", "error_type", "latency")


def not_successful(log: DataFrame) -> DataFrame:
    return log.where(_status() != "success")


def summary(requests: DataFrame, log: DataFrame) -> DataFrame:
    """One row: successes, failures, questions without a log row, mean latency of successes with a number."""
    rows = requests.select("qid").join(log, "qid", "left")
    ok = _status() == "success"
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_success"), F.count_if(_status() == "failed").alias("n_failed"), F.count_if(F.col("status").isNull()).alias("n_unprocessed"), F.avg(F.when(ok, as_double(F.col("latency")))).alias("mean_latency_s"))


def with_defaults(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its response, '' and 0 where there is none."""
    return requests.join(responses, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("latency", F.coalesce("latency", F.lit(0.0)))


def learning_rates(losses: DataFrame, start: float, patience: int = 3, factor: float = 0.8) -> DataFrame:
    """(run, epoch, loss, improved, stale, rate): rate after each epoch.

    After ``patience`` epochs without a new best loss the rate shrinks and the
    count starts anew.  A run's epochs are few; they are folded in order.
    """
    first = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.lit(start).alias("rate"), F.array().cast("array<struct<epoch:bigint,loss:double,improved:boolean,stale:int,rate:double>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        improved = e["loss"] < acc["best"]
        stale = F.when(improved, 0).otherwise(acc["stale"] + 1)
        shrink = stale >= patience
        rate = F.when(shrink, acc["rate"] * factor).otherwise(acc["rate"])
        kept = F.when(shrink, 0).otherwise(stale)
        row = F.struct(e["epoch"].alias("epoch"), e["loss"].alias("loss"), improved.alias("improved"), kept.alias("stale"), rate.alias("rate"))
        return F.struct(F.least(acc["best"], e["loss"]).alias("best"), kept.alias("stale"), rate.alias("rate"), F.concat(acc["out"], F.array(row)).alias("out"))

    epochs = losses.groupBy("run").agg(F.sort_array(F.collect_list(F.struct(F.col("epoch").cast("bigint").alias("epoch"), "loss"))).alias("e"))
    folded = epochs.select("run", F.explode(F.aggregate("e", first, step, lambda a: a["out"])).alias("r"))
    return folded.select("run", "r.epoch", "r.loss", "r.improved", "r.stale", "r.rate")


def mean_losses(losses: DataFrame) -> DataFrame:
    """(run, phase, n, mean_loss): mean loss of each run's training and validation steps; steps without a number don't count."""
    sound = losses.where(F.col("loss").isNotNull() & ~F.isnan("loss"))
    return sound.groupBy("run", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"))
