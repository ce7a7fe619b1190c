import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from qaloom.operators.contracts import ContractError
from qaloom.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_requests_of_whole_and_broken_numbers(spark, tmp_path):
    p = write(tmp_path / "r.json", json.dumps([{"qID": "a_1", "videoID": "v", "start_time": 1, "end_time": 2.5, "procedure_type": "p", "question": "“q”"}]))
    assert tuple(readers.requests(spark, p).first()) == ("a_1", "v", 1.0, 2.5, "p", "“q”")
    b = write(tmp_path / "b.json", json.dumps({"qIDs": ["a", "b"], "batch_size": 2, "layout": {"x": "y"}}))
    assert readers.batch(spark, b).first()["qIDs"] == ["a", "b"]
    q = write(tmp_path / "s.json", json.dumps([{"qID": "a", "content": "c", "latency": 1}]))
    assert readers.responses(spark, q).first()["latency"] == 1.0
    bad = write(tmp_path / "bad.json", '[{"qID": ')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.requests(spark, bad).collect()


def test_json_lines(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"sample_id": "x", "num_frames": 2}\n\n   \n{"sample_id": "y"}\n')
    assert [r["sample_id"] for r in readers.json_lines(spark, p, readers.SFT).collect()] == ["x", "y"]
    for bad in ('[{"sample_id": "x"}]', "3", '{"sample_id": '):
        q = write(tmp_path / "bad.jsonl", bad + "\n")
        with pytest.raises((PySparkException, Py4JJavaError)):
            readers.json_lines(spark, q, readers.SFT).collect()


@pytest.mark.parametrize("text, want", [('"a\\nb"', "a\nb"), ("", ""), ("null", ""), (" null ", "")])
def test_scalar_documents(spark, tmp_path, text, want):
    rows = readers.scalar_text(spark, write(tmp_path / "d.json", text)).collect()
    assert [r["text"] for r in rows] in ([want], [] if text == "" else [want])


def test_scalar_document_that_is_none(spark, tmp_path):
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.scalar_text(spark, write(tmp_path / "d.json", '{"a": 1}')).collect()


def test_csv_log(spark, tmp_path):
    p = write(tmp_path / "l.csv", 'qid,status,latency,error_type,extra\na,success,1.5,,x\n"b","fai""led",,"two\nlines",y\n,success,1,,z\n')
    assert [tuple(r) for r in readers.csv_log(spark, p).orderBy("qid").collect()] == [("a", "success", "1.5", ""), ("b", 'fai"led', "", "two\nlines")]
    with pytest.raises(ContractError, match="error_type"):
        readers.csv_log(spark, write(tmp_path / "m.csv", "qid,status,latency\na,b,c\n"))


def test_id_list(spark, tmp_path):
    p = write(tmp_path / "i.json", '["b", "a"]')
    assert [tuple(r) for r in readers.id_list(spark, p, 2).orderBy("pos").collect()] == [(0, "b"), (1, "a")]
    for text, n in (('["a", "a"]', None), ('["a", " "]', None), ('["a"]', 2)):
        with pytest.raises(ContractError):
            readers.id_list(spark, write(tmp_path / "j.json", text), n)


def test_listing_and_png(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "b.png").write_bytes(b"no")
    assert sorted(r["name"] for r in readers.listing(spark, str(tmp_path)).collect()) == ["a.png", "b.png"]
    assert sorted((r["length"], r["is_png"]) for r in readers.png_files(spark, str(tmp_path)).collect()) == [(2, False), (11, True)]


def test_paths():
    d = readers.Paths("a", "b")
    assert readers.resolve_paths(d, {}) == d
    assert readers.resolve_paths(d, {"QALOOM_INPUT": "x", "QALOOM_OUTPUT": "y"}) == readers.Paths("x", "y")
    with pytest.raises(ContractError):
        readers.resolve_paths(d, {"QALOOM_INPUT": "x"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", "train", 1, ["a", "ü"]), ("d2", "val", 2, [])], "dataset string, split string, n int, l array<string>")
    assert sinks.json_lines(df, str(tmp_path / "j"), 2) == 2
    with pytest.raises(ContractError):
        sinks.json_lines(df, str(tmp_path / "j"), 3)
    sinks.manifests(df, str(tmp_path / "m"))
    assert readers.json_lines(spark, str(tmp_path / "m" / "dataset=d1"), "n int").count() == 1
    sinks.csv(df, str(tmp_path / "c"), ["n"])
    cells = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert [r["l"] for r in cells.orderBy("n").collect()] == ['["a","ü"]', "[]"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        sinks.new_only(df, str(tmp_path / "j"))
    sinks.checkpoint(df, df, df.limit(0), str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k/responses")).count() == 2
    sinks.json_document(df.select("n").orderBy("n"), str(tmp_path / "doc"), files=1)
    (part,) = (tmp_path / "doc").glob("part-*")
    assert json.loads(part.read_text()) == [{"n": 1}, {"n": 2}]
    sinks.json_document(df.limit(0), str(tmp_path / "none"), files=1)
    assert readers.json_array(spark, str(tmp_path / "none"), "n int").count() == 0
    spaced = spark.createDataFrame([(" a ", "x\ny"), ("b", '"')], "k string, v string")
    sinks.csv(spaced, str(tmp_path / "s"), ["k"], files=1)
    assert len(list((tmp_path / "s").glob("part-*"))) == 1
    back = readers.csv_log(spark, str(tmp_path / "s"), ("k", "v"))
    assert sorted(tuple(r) for r in back.collect()) == [(" a ", "x\ny"), ("b", '"')]


def test_documents_of_several_lines(spark, tmp_path):
    assert [tuple(r) for r in readers.id_list(spark, write(tmp_path / "i.json", '[\n  "b",\n  "a"\n]\n'), 2).collect()] == [(0, "b"), (1, "a")]
    assert readers.scalar_text(spark, write(tmp_path / "t.json", '\n"one\\ntwo"\n')).first()["text"] == "one\ntwo"


def test_bad_lines_have_a_number(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", '{"n": 1}\n\n[1]\n{"n": 2}\nnull\n{"n":\n')
    assert sorted((r["line"], r["text"]) for r in readers.bad_json_lines(spark, path).collect()) == [(3, "[1]"), (5, "null"), (6, '{"n":')]
    with pytest.raises(ContractError, match="line 3"):
        readers.checked_json_lines(spark, path, "n int")
    good = write(tmp_path / "y.jsonl", '{"n": 1}\n\n{"n": 2}\n')
    assert readers.bad_json_lines(spark, good).count() == 0 and readers.checked_json_lines(spark, good, "n int").count() == 2


def test_repeated_keys_of_a_log_are_an_error(spark, tmp_path):
    path = write(tmp_path / "l.csv", "qid,status,latency,error_type\na,success,1,\n,x,,\na,failed,2,\n")
    with pytest.raises(ContractError, match="a 2"):
        readers.csv_log(spark, path)
    assert readers.csv_log(spark, path, unique=False).count() == 2


def test_name_index(spark):
    names = spark.createDataFrame([("A.mp4",), ("a.mp4",), ("b.mp4",), ("b.mp4",), (None,)], "name string")
    got = sorted(tuple(r) for r in readers.name_index(names).collect())
    assert got == [("A.mp4", "exact", "A.mp4", 1), ("a.mp4", "exact", "a.mp4", 1), ("a.mp4", "lower", "A.mp4", 2), ("b.mp4", "exact", "b.mp4", 1), ("b.mp4", "lower", "b.mp4", 1)]


def test_split_manifests(spark, tmp_path):
    df = spark.createDataFrame([("d2", "val", 1), ("d1", "val", 2), ("d1", "train", 3), ("d1", "test", 4), (None, "val", 5)], "dataset string, split string, n int")
    assert sinks.split_manifests(df, str(tmp_path)) == ["train", "val_d1", "val_d2", "val_all"]
    assert sorted(r["n"] for r in spark.read.json(str(tmp_path / "val_all")).collect()) == [1, 2]


def test_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([("d1", "train", 1), ("d2", "val", 2)], "dataset string, split string, n int")
    df.write.partitionBy("dataset", "split").parquet(str(tmp_path / "t"))
    one = readers.annotated(spark, str(tmp_path / "t"), "d1", "train")
    assert one.count() == 1 and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_ordered_responses(spark):
    requests = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "pos int, qid string")
    responses = spark.createDataFrame([("a", "x", 1.0), ("b", None, None)], "qid string, answer string, latency double")
    of = lambda m: [tuple(r) for r in sinks.ordered_responses(requests, responses, m).collect()]
    assert of("default") == [(0, "b", "", 0.0), (1, "a", "x", 1.0), (2, "c", "", 0.0)]
    assert of("drop") == [(0, "b", "", 0.0), (1, "a", "x", 1.0)]
    with pytest.raises((PySparkException, Py4JJavaError)):
        of("fail")


def test_log_cells(spark):
    df = spark.createDataFrame([(1.5, None, "x"), (None, 3, None)], "a double, b int, c string")
    assert [tuple(r) for r in sinks.prediction_log(df).collect()] == [("1.500000", "", "x"), ("", "3", "")]
    assert sinks.flat(df).columns == ["a", "b", "c"] and F is not None
