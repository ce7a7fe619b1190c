import pytest
from pyspark.sql import functions as F

from qaloom.operators import contracts, evaluation, lookup, providers, resume
from qaloom.operators.lineage import cut, ensure_checkpoint_dir


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_key_checks(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(contracts.repeated_keys(a.where("k is not null"), "k")) == [("repeated_key", "x", "2")]
    assert rows(contracts.missing_keys(a, b, "k"), "key") == [("x",)]
    assert rows(contracts.key_difference(a, b, "k"), "rule", "key") == [("only_left", "x"), ("only_right", "z")]
    p, q = spark.createDataFrame([("x", 0), ("y", 1)], "k string, pos int"), spark.createDataFrame([("x", 1), ("y", 1)], "k string, pos int")
    assert rows(contracts.order_difference(p, q, "k"), "key") == [("x",)]
    assert rows(contracts.wrong_counts(b, "k", {"y": 1, "z": 2, "w": 1}), "rule", "key") == [("missing_group", "w"), ("wrong_count", "z")]


def test_enforce(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, 400.0), ("c", None, 1.0), ("d", float("nan"), 1.0), ("e", 0.0, 1.0), ("f", -1.0, 1.0)], "k string, start_time double, end_time double")
    found = contracts.broken(df, F.col("k"), contracts.window_rules())
    assert rows(found, "key", "rule") == [("a", "reversed_window"), ("b", "window_too_long"), ("c", "missing_window"), ("d", "missing_window"), ("f", "negative_start")]
    with pytest.raises(contracts.ContractError, match="missing_window: c"):
        contracts.enforce(found)
    contracts.enforce(found.where(F.lit(False)))


def test_sample_rules(spark):
    ok = (["a", "b"], ["00:00:01", "00:00:02"], 2, "<image><image> q", "yes")
    bad = (["a", "a"], ["00:00:02", "0-1"], 3, "<image>", " \t")
    df = spark.createDataFrame([("ok", *ok), ("bad", *bad)], "k string, images array<string>, frame_labels array<string>, num_frames int, user_text string, assistant_text string")
    got = rows(contracts.broken(df, F.col("k"), contracts.sample_rules()), "key", "rule")
    assert got == [("bad", r) for r in sorted(["blank_assistant_text", "image_count", "label_count", "mark_count", "labels_not_increasing", "malformed_label", "repeated_image"])]


def test_resolve(spark):
    names = spark.createDataFrame([("0001 - A.mp4",), ("0001 - a.MP4",), ("0002 - other.mp4",), ("0003 - x.mp4",), ("0009 - x.mp4",), (None,)], "n string")
    files = spark.createDataFrame([("0001 - A.mp4",), ("0001 - A.mp4",), ("0002 - b.avi",), ("0003 - c.avi",), ("0003 - d.avi",)], "f string")
    got = {r["n"]: (r["file"], r["how"]) for r in lookup.resolve(names, "n", files, "f").collect()}
    assert got == {"0001 - A.mp4": ("0001 - A.mp4", "exact"), "0001 - a.MP4": ("0001 - A.mp4", "case"), "0002 - other.mp4": ("0002 - b.avi", "prefix"), "0003 - x.mp4": (None, "ambiguous"), "0009 - x.mp4": (None, "missing"), None: (None, "missing")}


def test_first_groups_and_chunks(spark):
    df = spark.createDataFrame([("d", f"g{i % 5}", i) for i in range(20)] + [("e", None, 1)], "d string, g string, i int")
    assert {r["g"] for r in lookup.first_groups(df, ["d"], "g", 2).collect()} == {"g0", "g1"}
    sizes = rows(lookup.chunked(df.where("d = 'd'"), "d", ["i"], 6).groupBy("chunk").count())
    assert sizes == [(0, 6), (1, 6), (2, 6), (3, 2)]


def test_scores(spark):
    df = spark.createDataFrame([("a", True, True), ("a", False, True), (None, True, False), ("b", None, None)], "g string, correctness boolean, ood boolean")
    assert rows(evaluation.scored(df.where("g is not null"), ["g"])) == [("a", 1, 2, 0.5), ("b", 0, 1, 0.0)]
    assert evaluation.scored(df, ["g"]).where("g is null").count() == 1
    b = {r["bucket_name"]: r["count"] for r in evaluation.buckets(df, "g").collect()}
    assert b == {"ood_a": 2, "id_none": 1, "id_b": 1}
    assert [r["g"] for r in evaluation.in_given_order(df.where("g is not null"), "g", ["b", "a"]).collect()] == ["b", "a", "a"]
    assert rows(evaluation.scored_sets(df, {"one": ["g"], "two": ["g", "ood"]}).where("report = 'two'"), "key", "count") == [("a|true", 2), ("b|", 1), ("|false", 1)]


def test_resume(spark):
    requests = spark.createDataFrame([(q,) for q in "abcdef"], "qid string")
    responses = spark.createDataFrame([("a", "x"), ("b", " "), ("c", "x"), ("d", "x")], "qid string, answer string")
    log = spark.createDataFrame([("b", "Success ", "1.5"), ("c", "failed", "nan"), ("d", "", ""), ("e", "success", "")], "qid string, status string, latency string").withColumn("error_type", F.lit(""))
    assert rows(resume.pending(requests, responses, log)) == [("c",), ("d",), ("f",)]
    s = resume.summary(requests, log).first()
    assert (s["n"], s["n_success"], s["n_failed"], s["n_unprocessed"], s["mean_latency_s"]) == (6, 2, 1, 2, 1.5)
    assert rows(resume.failed(log), "qid") == [("c",)]


def test_learning_rates(spark):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate([5.0, 4.0, 4.0, 4.5, 4.1, 3.0, 3.0, 3.0, 3.0])], "run string, epoch int, loss double")
    got = [(r["improved"], r["stale"], round(r["rate"], 6)) for r in sorted(resume.learning_rates(df, 1.0).collect(), key=lambda r: r["epoch"])]
    assert got == [(True, 0, 1.0), (True, 0, 1.0), (False, 1, 1.0), (False, 2, 1.0), (False, 0, 0.8), (True, 0, 0.8), (False, 1, 0.8), (False, 2, 0.8), (False, 0, 0.64)]


def test_failures_stay_with_their_rows(spark):
    class Picky:
        def load(self):
            self.ready = True

        def answer(self, row):
            if row["question"] is None:
                raise ValueError("no question")
            return row["question"].upper() if self.ready else "not loaded"

        def unload(self):
            self.ready = False

    df = spark.createDataFrame([("a", "x"), ("b", None)], "qid string, question string")
    got = {r["qid"]: (r["answer"], r["status"], r["error_type"], r["error_message"]) for r in providers.answered(df, ["question"], Picky).collect()}
    assert got == {"a": ("X", "success", "", ""), "b": ("", "failed", "ValueError", "no question")}
    assert {r["answer"] for r in providers.answered(df, ["question"]).collect()} == {""}


def test_decoding_by_batches(spark):
    jobs = spark.createDataFrame([("v", 0, 3), ("v", 0, 1), ("v", 0, 3), ("v", 1, 9)], "video string, batch int, source_index long")
    got = rows(providers.decoded(jobs, lambda v, i: [f"{v}{k}".encode() for k in i]).select("source_index", F.col("image").cast("string")))
    assert got == [(1, "v1"), (3, "v3"), (9, "v9")]


def test_checkpoint_folder_of_the_session(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    before = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert cut(spark.range(5)).count() == 5
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == before


def test_manifest_rules(spark):
    good = ("a", 10.0, 12.5, [0.0, 1.0, 2.0], 3)
    bad = [("b", 0.0, 5.0, [1.0, 1.0], 5), ("c", 0.0, 1.0, [0.0, 1.0], 1), ("d", 0.0, 2.0, [0.0], 7), ("e", 0.0, 2.0, [], 2)]
    df = spark.createDataFrame([good, *bad], "k string, start_time double, end_time double, times array<double>, candidate_count long")
    got = rows(contracts.broken(df, F.col("k"), contracts.manifest_rules(most=2)), "key", "rule")
    assert got == [("a", "too_many_frames"), ("b", "first_not_at_start"), ("b", "times_not_increasing"), ("c", "beyond_window"), ("d", "wrong_candidate_count"), ("e", "no_frames")]


def test_missing_files_and_adapters(spark):
    paths = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "p string")
    files = spark.createDataFrame([("a", 5), ("b", 0)], "path string, length long")
    assert rows(contracts.missing_files(paths, "p", files), "key") == [("b",), ("c",)]
    conf = spark.createDataFrame([("x", True, ["q", "v", "o"]), ("y", False, ["q"]), ("z", None, None)], "k string, weight_decomposed boolean, target_modules array<string>")
    assert rows(contracts.broken(conf, F.col("k"), contracts.adapter_rules(["q", "v"])), "key", "rule") == [("y", "method_off"), ("y", "target_missing"), ("z", "method_off"), ("z", "target_missing")]


def test_inspection_keeps_failures(spark):
    def inspect(name):
        if name == "bad":
            raise OSError("unreadable")
        return (25.0, 50) if name == "ok" else (0.0, 1)

    df = spark.createDataFrame([("ok",), ("ok",), ("bad",), ("zero",), (None,)], "video string")
    got = {r["video"]: (r["duration_s"], r["error"].split(":")[0]) for r in providers.inspected(df, inspect).collect()}
    assert got == {"ok": (2.0, ""), "bad": (None, "OSError"), "zero": (None, "ValueError")}


def test_seeded_orders(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    order = lambda d, s, e: [r["k"] for r in d.orderBy(lookup.seeded_order("k", s, e), "k").collect()]
    assert order(df, 50, 0) == order(df.repartition(7), 50, 0) != order(df, 50, 1) == order(df, 51, 0)
