import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from qaloom.functions import capabilities, text
from qaloom.operators import contracts, evaluation, lookup, providers, tokens
from qaloom.sources import readers

ERRORS = (PySparkException, Py4JJavaError)


def test_numbers_of_hot_parts_nulls_and_no_part(spark):
    rows = [("hot" if i % 3 else None, f"k{i:04d}", i) for i in range(900)] + [("cold", "z", 0)]
    df = spark.createDataFrame(rows, "part string, k string, number int").repartition(7)
    got = lookup.numbered(df, ["part"], ["k"], "place").collect()
    for part in ("hot", None, "cold"):
        own = sorted((r["k"], r["place"]) for r in got if r["part"] == part)
        assert [p for _, p in own] == list(range(len(own)))
    assert sorted((r["k"], r["place"]) for r in lookup.numbered(df, [], ["k"], "place").collect()) == [(k, i) for i, k in enumerate(sorted(r[1] for r in rows))]
    assert lookup.numbered(df.limit(0), ["part"], ["k"]).count() == 0
    assert sorted(r["number"] for r in lookup.every(df.where("part = 'hot'"), ["part"], ["k"], 250).collect()) == [250, 500]


def test_missing_rows_of_a_list(spark):
    ids, rows = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, qid string"), spark.createDataFrame([("a", 5)], "qid string, x int")
    of = lambda m: sorted((r["pos"], r["x"]) for r in lookup.in_order(ids, rows, "qid", missing=m).collect())
    assert of("drop") == [(0, 5)] and of("null") == [(0, 5), (1, None)]
    with pytest.raises(ERRORS, match="no row for b"):
        of("fail")


def test_unknown_groups(spark):
    df = spark.createDataFrame([("Object-Recognition",), (None,), (" ",), ("what",)], "g string")
    assert [r[0] for r in df.select(capabilities.group(F.col("g"))).collect()] == ["object_recognition", None, None, None]
    assert df.where("g is null or g <> 'what'").select(capabilities.group(F.col("g"), strict=True)).count() == 3
    with pytest.raises(ERRORS, match="unknown capability group: what"):
        df.select(capabilities.group(F.col("g"), strict=True)).collect()


def test_alternation_and_paths(spark):
    assert text.alternation(["bag", "specimen bag", "specimen", "a.b"]) == r"specimen bag|specimen|a\.b|bag"
    row = spark.createDataFrame([("q", None)], "a string, b string").select(text.file_for("/x/", F.col("a"), ".png"), text.file_for("/x", F.col("b"), "png"), text.utc_now()).first()
    assert row[0] == "/x/q.png" and row[1] is None and row[2].endswith("Z") and len(row[2]) == 20


def test_labels_are_the_answer_and_its_mark():
    encoding = tokens.tokenizer(tokens.VOCABULARY, tokens.MARKS)
    ids, labels = tokens.tokenised(encoding, "one\n<img><IMG_CONTEXT></img> two?", "Ünd so.\n", "be brief")
    assert encoding.decode(ids.tolist()) == "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\none\n<img><IMG_CONTEXT></img> two?<|im_end|>\n<|im_start|>assistant\nÜnd so.\n<|im_end|>\n"
    kept = np.flatnonzero(labels != tokens.IGNORED)
    assert encoding.decode(labels[kept].tolist()) == "Ünd so.\n<|im_end|>" and (labels[kept] == ids[kept]).all() and kept.tolist() == list(range(kept[0], len(ids) - 1))


def test_token_frames(spark):
    df = spark.createDataFrame([("a", "x", "y", 1), ("b", None, None, 2)], "sample_id string, user_text string, assistant_text string, ids int")
    out = {r["sample_id"]: (len(r["ids"]), len(r["labels"])) for r in tokens.sft_tokens(df).collect()}
    assert all(a == b > 5 for a, b in out.values())
    assert {r["sample_id"]: r["text"] for r in tokens.supervised_text(tokens.sft_tokens(df)).collect()} == {"a": "y<|im_end|>", "b": "<|im_end|>"}
    assert tokens.sft_tokens(df.limit(0)).count() == 0
    with pytest.raises(ERRORS, match="5 allowed"):
        tokens.sft_tokens(df, longest=5).collect()


def test_bootstrap(spark):
    s = spark.createDataFrame([("a", 50, 100), ("b", 0, 10), ("c", 10, 10), ("d", 0, 0)], "k string, correct long, count long")
    got = {r["k"]: r for r in evaluation.bootstrap(s, "k").collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["high"] == 0.0 and got["c"]["low"] == 1.0
    assert 0.38 <= got["a"]["low"] <= 0.43 and 0.57 <= got["a"]["high"] <= 0.62
    assert got["a"] == {r["k"]: r for r in evaluation.bootstrap(s.repartition(3), "k").collect()}["a"]


def test_consistency(spark):
    rows = spark.createDataFrame([("x", False, True), ("x", False, False), ("y", False, True), ("y", False, True)], "capability_group string, ood boolean, correctness boolean")
    assert tuple(evaluation.consistency(rows, evaluation.buckets(rows)).first()) == (2, True, True)
    uneven = rows.union(rows.limit(1))
    assert evaluation.consistency(uneven, evaluation.buckets(uneven)).first()["agree"]  # sizes differ, so the means may


def test_images_through_slots(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff1")
    (tmp_path / "b.jpeg").write_bytes(b"\xff\xd8\xff")
    images = readers.jpeg_files(spark, str(tmp_path)).withColumn("label", F.lit("00:00:01"))

    def draw(content, row):
        if len(content) == 3:
            raise ValueError("empty")
        return content + row["label"].encode()

    out = {r["path"][-6:]: r for r in providers.prepared(images, draw, ["label"]).collect()}
    assert bytes(out["/a.jpg"]["image"]) == b"\xff\xd8\xff100:00:01" and out["b.jpeg"]["image"] is None and out["b.jpeg"]["error"] == "ValueError: empty"
    (tmp_path / "out").mkdir()

    def store(path, content):
        import os

        target = str(tmp_path / "out" / path.rsplit("/", 1)[1])
        if os.path.exists(target):
            return False
        with open(target, "wb") as f:
            f.write(content)
        return True

    ready = providers.prepared(images, lambda c, r: c, [])
    assert tuple(providers.stored(ready, store).first()) == (2, 0, 7) and tuple(providers.stored(ready, store).first()) == (0, 2, 7)
    (tmp_path / "c.jpg").write_bytes(b"no")
    with pytest.raises(ERRORS, match="not a JPEG"):
        readers.jpeg_files(spark, str(tmp_path)).collect()


class Echo:
    made = ""

    def load(self):
        self.made = "base"

    def answer(self, row):
        return self.made

    def unload(self):
        self.made = ""


def test_attached_provider_and_judge(spark):
    p = providers.AttachedProvider(Echo(), lambda base: setattr(base, "made", base.made + "+adapter"))
    p.load()
    assert p.answer({}) == "base+adapter"
    rows = spark.createDataFrame([("f", "A ", "a"), ("f", "b", None), ("g", None, None)], "k string, reference_answer string, candidate_answer string")
    assert sorted(tuple(r) for r in providers.judged(rows, ["k"]).collect()) == [("f", 2, 0.5), ("g", 1, 0.0)]


def test_required_files_and_lacking_keys(spark):
    there = spark.createDataFrame([("config.json", 5), ("weights", 0)], "name string, length int")
    assert sorted(r["key"] for r in contracts.required_files(there, ["config.json", "weights", "vocab"]).collect()) == ["vocab", "weights"]
    of = lambda *k: spark.createDataFrame([(x,) for x in k], "q string")
    got = contracts.lacking_keys({"b": of("1", "2", None), "a": of("1", "1"), "c": of("1", "3")}, "q")
    assert sorted(tuple(r) for r in got.collect()) == [("2", "a,c"), ("3", "a,b")]
    rows = spark.createDataFrame([("v", "p"), ("v", "q"), ("w", "p"), ("w", "p")], "v string, p string")
    assert [tuple(r) for r in contracts.path_collisions(rows, ["v"], "p").collect()] == [("v", "p", "q")]
