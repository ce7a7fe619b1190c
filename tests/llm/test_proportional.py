from pyspark.sql import functions as F

from qaloom.llm import proportional as p

TARGETS = [("Big one", 60, 5, 10), ("small", 20, 30, 10), ("tiny", 5, 8, 10), ("absent", 15, 1, 10)]


def data(spark):
    rows = [(f"b{i}", [" big ONE", "BIG_one", "big-one"][i % 3], "q") for i in range(900)]
    rows += [(f"s{i}", "small", "q") for i in range(80)] + [(f"t{i}", "Tiny ", "q") for i in range(5)] + [(f"u{i}", "other", "q") for i in range(15)]
    rows += rows[:40] + [("n1", None, "q"), ("n2", "  ", "q"), (None, "small", "q")]
    return p.categorised(spark.createDataFrame(rows, "id string, cat string, available string").repartition(5), "id", "cat")


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "label string, target_pct int, min_rows int, sample_pct int")


def test_plan(spark):
    plan = {r["category"]: (r["available"], r["wanted"], r["met"]) for r in p.sampling_plan(data(spark), targets(spark)).collect()}
    assert plan == {"big_one": (900, 60, True), "small": (80, 30, True), "tiny": (5, 8, False), "absent": (0, 15, False)}


def drawn(spark, df, **kw):
    return {(r["id"], r["category"], r["how"]) for r in p.proportional_sample(df, targets(spark), **kw).collect()}


def test_counts_and_layouts(spark):
    got = drawn(spark, data(spark))
    by = lambda c: [x for x in got if x[1] == c]
    assert len(by("big_one")) == 60 and len(by("small")) == 30 and len(by("tiny")) == 5 and not by("other")
    assert len([x for x in by("small") if x[2] == "floor"]) == 10
    # neither the layout nor the size of the buckets matters
    assert got == drawn(spark, data(spark).repartition(1), bucket_rows=7) == drawn(spark, data(spark), bucket_rows=100)
    assert got != drawn(spark, data(spark), seed=2)
    assert len({x[0] for x in got}) == len(got)


def test_every_record_has_its_chance(spark):
    hits = {}
    for seed in range(12):
        for r in drawn(spark, data(spark), seed=seed):
            hits[r[0]] = hits.get(r[0], 0) + 1
    assert len([k for k in hits if k[0] == "b"]) > 400


def test_empty(spark):
    none = data(spark).where(F.lit(False))
    assert p.proportional_sample(none, targets(spark)).count() == 0
    assert p.sampling_plan(none, targets(spark)).where("met").count() == 0
    assert p.proportional_sample(data(spark), targets(spark, [])).count() == 0
