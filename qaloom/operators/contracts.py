"""Integrity rules as queries that return violations.

Every check gives a frame of (rule, key, detail), so checks of one kind can be
united, counted and joined; ``enforce`` turns violations into an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import blank


class ContractError(ValueError):
    """Raised when rows break a rule."""


def broken(df: DataFrame, key: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """(rule, key, detail): one row for each rule (true where broken) that a row breaks; one pass over the rows."""
    found = F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))
    rows = df.select(key.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"), F.explode(found).alias("rule"))
    return rows.where("rule is not null").select("rule", "key", "detail")


def repeated_keys(df: DataFrame, key: str, rule: str = "repeated_key") -> DataFrame:
    """Keys of more than one row."""
    counts = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.select(F.lit(rule).alias("rule"), "key", F.col("n").cast("string").alias("detail"))


def missing_keys(expected: DataFrame, given: DataFrame, key: str, rule: str = "missing_key") -> DataFrame:
    """Keys that are expected but not given."""
    e = expected.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    g = given.select(F.col(key).cast("string").alias("key"))
    return e.join(g, "key", "left_anti").select(F.lit(rule).alias("rule"), "key", F.lit("").alias("detail"))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: rules ``only_left`` and ``only_right``."""
    left = a.select(F.col(key).cast("string").alias("key"), F.lit(1).alias("l")).where("key is not null").distinct()
    right = b.select(F.col(key).cast("string").alias("key"), F.lit(1).alias("r")).where("key is not null").distinct()
    both = left.join(right, "key", "full_outer")
    rule = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right")
    return both.select(rule.alias("rule"), "key", F.lit("").alias("detail")).where("rule is not null")


def lacking_keys(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, lacking): keys that some but not all of several frames have, and the names of those without, in order."""
    has = reduce(DataFrame.unionByName, (df.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("name")).where("key is not null") for name, df in frames.items()))
    found = has.groupBy("key").agg(F.collect_set("name").alias("names"))  # at most as many names as frames
    lacking = F.filter(F.array(*map(F.lit, sorted(frames))), lambda n: ~F.array_contains("names", n))
    return found.select("key", F.array_join(lacking, ",").alias("lacking")).where("lacking <> ''")


def path_collisions(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Keys with several paths: what is to be written once would be written to different places."""
    return rows.groupBy(*keys).agg(F.min(path).alias("path"), F.max(path).alias("other")).where("path <> other")


def order_difference(a: DataFrame, b: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Keys that both sides have, at different positions."""
    l, r = a.select(F.col(key).alias("key"), F.col(position).alias("l")), b.select(F.col(key).alias("key"), F.col(position).alias("r"))
    return l.join(r, "key").where("l <> r").select(F.lit("order").alias("rule"), F.col("key").cast("string").alias("key"), F.concat_ws(" ", "l", "r").alias("detail"))


def wrong_counts(df: DataFrame, group: str, expected: dict[str, int], rule: str = "wrong_count") -> DataFrame:
    """Groups whose number of rows isn't the expected one; groups that are missing or not expected."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), "key string, want long")
    have = df.groupBy(F.col(group).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("have"))
    both = want.join(have, "key", "full_outer")
    name = F.when(F.col("want").isNull(), "unexpected_group").when(F.col("have").isNull(), "missing_group").otherwise(rule)
    detail = F.concat_ws(" of ", F.coalesce(F.col("have").cast("string"), F.lit("0")), F.coalesce(F.col("want").cast("string"), F.lit("0")))
    return both.where("not (have <=> want)").select(name.alias("rule"), "key", detail.alias("detail"))


def united(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def enforce(violations: DataFrame, most: int = 20) -> None:
    """Raises with the first violations, in order of rule and key."""
    some = violations.orderBy("rule", "key").limit(most).collect()
    if some:
        raise ContractError("; ".join(f"{r['rule']}: {r['key']} {r['detail']}".strip() for r in some))


def window_rules(start: str = "start_time", end: str = "end_time", longest: float = 300.001) -> dict[str, Column]:
    s, e = F.col(start), F.col(end)
    nan = F.isnan(s) | F.isnan(e)
    return {
        "missing_window": s.isNull() | e.isNull() | nan,
        "empty_window": ~nan & (e == s),
        "reversed_window": ~nan & (e < s),
        "negative_start": ~nan & (s < 0),
        "window_too_long": ~nan & (e - s > longest),
    }


def increasing(values: Column) -> Column:
    """Whether an array rises strictly."""
    return F.forall(F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)


def sample_rules() -> dict[str, Column]:
    """Rules of a training record: images, labels, num_frames, user_text, assistant_text."""
    text = F.col("user_text")
    marks = (F.length(text) - F.length(F.replace(text, F.lit("<image>")))) / 7
    return {
        "blank_user_text": blank(text),
        "blank_assistant_text": blank(F.col("assistant_text")),
        "image_count": F.size("images") != F.col("num_frames"),
        "label_count": F.size("frame_labels") != F.col("num_frames"),
        "mark_count": marks != F.col("num_frames"),
        "labels_not_increasing": ~increasing(F.col("frame_labels")),
        "malformed_label": ~F.forall("frame_labels", lambda x: x.rlike(r"\A\d{2,}:[0-5]\d:[0-5]\d\z")),
        "repeated_image": F.size(F.array_distinct("images")) != F.size("images"),
    }


def manifest_rules(times: str = "times", most: int = 32) -> dict[str, Column]:
    """Rules of a planned manifest row: times (array<double>), start_time, end_time, candidate_count."""
    t = F.col(times)
    return {
        "no_frames": F.size(t) == 0,
        "too_many_frames": F.size(t) > most,
        "first_not_at_start": F.get(t, 0) != 0.0,
        "times_not_increasing": ~increasing(t),
        "beyond_window": F.exists(t, lambda x: x > 0) & (F.element_at(t, -1) >= F.col("end_time") - F.col("start_time")),
        "wrong_candidate_count": F.col("candidate_count") != F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("end_time") - F.col("start_time") - 1e-9).cast("bigint")),
    }


def missing_files(paths: DataFrame, path: str, files: DataFrame, file: str = "path", length: str = "length") -> DataFrame:
    """Paths that no non-empty file has; also what a cache still has to make."""
    present = files.where(F.col(length) > 0).select(F.col(file).alias("key"))
    return paths.select(F.col(path).alias("key")).where("key is not null").distinct().join(present, "key", "left_anti").select(F.lit("missing_file").alias("rule"), "key", F.lit("").alias("detail"))


def adapter_rules(required: list[str], uses: str = "weight_decomposed", targets: str = "target_modules") -> dict[str, Column]:
    """Rules of an adapter's configuration: the method is on, and all required modules are targets."""
    lacking = F.array_except(F.array(*map(F.lit, required)), F.coalesce(targets, F.array().cast("array<string>")))
    return {"method_off": ~F.coalesce(F.col(uses), F.lit(False)), "target_missing": F.size(lacking) > 0}


def required_files(present: DataFrame, required: list[str], name: str = "name", length: str = "length") -> DataFrame:
    """Files that a model's folder must hold and doesn't, or holds empty."""
    wanted = present.sparkSession.createDataFrame([(r,) for r in required], "name string")
    return missing_files(wanted, "name", present, name, length)
