from pyspark.sql import functions as F

from qaloom.llm import stable_sample as s


def ids(n, start=0):
    return [(f"abc_{i + start:07d}", 1) for i in range(n)]


def sample(spark, rows, keep=None, rate=0.2, parts=3):
    df = spark.createDataFrame(rows, "qid string, left int").repartition(parts)
    k = spark.createDataFrame(keep, "qid string, pos int") if keep is not None else None
    return {r["qid"]: r["origin"] for r in s.stable_sample(df, "qid", rate, keep=k).collect()}


def test_permutation_has_no_collisions(spark):
    more = [(f"{p}{'_' if p else ''}{n:0{d}d}", 1) for p in ("", "b", "abd", "heico2", "a_b-c", "zzzzzzzzzzz") for d in (1, 6, 8, 12, 18) for n in (0, 1, 7)]
    rows = spark.createDataFrame(ids(5000) + more, "qid string, x int")
    out = s.with_permuted(rows, "qid", "1")
    assert out.where("left is null").count() == 0
    assert out.select("left", "right").distinct().count() == 5000 + len(more)
    bad = out.where((F.col("left") < 0) | (F.col("left") >= s.LEFT) | (F.col("right") < 0) | (F.col("right") >= s.RIGHT))
    assert bad.count() == 0


def test_same_for_any_layout_and_grows_with_data(spark):
    a = sample(spark, ids(3000), parts=1)
    assert a == sample(spark, ids(3000) + ids(100), parts=7)
    b = sample(spark, ids(3000) + ids(2000, 50_000))
    assert set(a) <= set(b) and len(b) > len(a)
    assert 0.15 * 3000 < len(a) < 0.25 * 3000


def test_kept_ids_and_dirt(spark):
    rows = [*ids(50), (" ABC_0000003 ", 1), (None, 1), ("  ", 1), ("no number", 1)]
    got = sample(spark, rows, [(" abc_0000001", 1), ("ABC_0000002\t", 2), (None, 3), ("gone_0000001", 4), ("abc_0000001", 5)], rate=0.0)
    assert got == {"abc_0000001": "kept", "abc_0000002": "kept"}


def test_rates_and_empty_table(spark):
    assert sample(spark, ids(40), rate=0.0) == {}
    assert len(sample(spark, [*ids(40), ("no number", 1)], rate=1.0)) == 41
    assert sample(spark, []) == {}


def test_the_domain_has_an_end_and_says_so(spark):
    odd = [("abcdefghijkl_1", 1), ("a_1234567890123456789", 1), ("é_1", 1), ("_1", 1), ("a_", 1)]
    assert sample(spark, [*odd, ("a_1", 1), ("12", 1)], rate=1.0) == {**{k: "hashed" for k, _ in odd}, "a_1": "drawn", "12": "drawn"}


def test_numbers_fill_the_domain_without_a_gap(spark):
    digits = spark.createDataFrame([(x,) for x in ("0", "9", "00", "99", "000", "9" * 18)], "d string")
    got = [r[0] for r in digits.select(s.halves(F.col("d"))[1]).collect()]
    assert got == [0, 9, 10, 109, 110, s.RIGHT - 1]
    top = spark.createDataFrame([("-" * s.LETTERS + "_1",)], "d string").select(s.halves(F.col("d"))[0]).first()[0]
    assert top == s.LEFT - 1 and s.LEFT < 2**60 and s.RIGHT < 2**60
