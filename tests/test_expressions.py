"""Scalar expressions and routers, case by case."""

import pytest
from pyspark.sql import functions as F

from qaloom.functions import answers, capabilities, prompts, text, tiles, timecode
from qaloom.operators.intents import with_procedure_intent, with_segment_intent


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("s, want", [(0.0, "00:00:00"), (59.999, "00:00:59"), (371109.0, "103:05:09"), (-1.0, None), (float("nan"), None), (None, None)])
def test_clock(spark, s, want):
    assert one(spark, timecode.hhmmss(F.lit(s).cast("double"))) == want


@pytest.mark.parametrize("t, strict, lenient", [("01:02:03", 3723.0, 3723.0), ("1:2:3", None, 3723.0), ("00:60:00", None, None), ("99:00:00", 356400.0, 356400.0), ("01:02", None, None), ("a:b:c", None, None), ("01:02:03\n", None, 3723.0)])
def test_seconds(spark, t, strict, lenient):
    assert one(spark, timecode.strict_seconds(F.lit(t))) == strict
    assert one(spark, timecode.lenient_seconds(F.lit(t))) == lenient


ANSWERS = [
    ("Yes.", "yes"), ("nO!", "no"), ("7.", "7"), ("3.50;", "3.50"), ("40 %.", "40%"), ("12 .", "12 "), ("yes .", "yes ."), ("01:10:00.", "01:10:00"), ("01:10:00 ,01:10:00", "01:10:00, 01:10:00"), ("99:00:00", "99:00:00"), ("00:60:00", "00:60:00"),
    ("specimen bag.", "Specimen Bag"), ("clip,NEEDLE, Clip", "Clip, Needle"), ("None!", "none"), ("none, Clip", "none, Clip"), ("Clip, closed.", "Clip, closed."), ("  left of it.  ", "left of it."), (" \t ", ""), (",", ","),
]


@pytest.mark.parametrize("raw, want", ANSWERS)
def test_answers(spark, raw, want):
    assert one(spark, answers.normalise(F.lit(raw), answers.class_names())) == want


def test_headings(spark):
    doc = "Title\n=====\n\nClip\n----\ntext\n\nMesh\n---\nClip\n-----\nShort\n--\n"
    assert one(spark, answers.headings(F.lit(doc))) == ["Clip", "Mesh"]
    assert one(spark, answers.headings(F.lit(doc), 1)) == ["Clip", "Mesh", "Short"]
    assert one(spark, answers.headings(F.lit(""))) == []
    assert one(spark, answers.resolved_names(F.lit("no heading"), F.array(F.lit("a")))) == ["a"]


@pytest.mark.parametrize("names, want", [(["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c"), ([], None)])
def test_listing(spark, names, want):
    assert one(spark, text.listing(F.array(*map(F.lit, names)).cast("array<string>"))) == want


@pytest.mark.parametrize("s, want", [("12.0", 12), ("-3.7", -3), (" ", None), ("nan", None), ("x", None), (None, None)])
def test_cells(spark, s, want):
    assert one(spark, text.as_whole(F.lit(s).cast("string"))) == want


def test_names(spark):
    assert one(spark, text.token(F.lit(" Event & Procedural-Understanding! "))) == "event_procedural_understanding"
    assert one(spark, text.slug(F.lit("0012 - Lap Chole.mp4"))) == "0012_-_Lap_Chole.mp4" and one(spark, text.slug(F.lit("..//--"))) == "video"
    assert one(spark, text.stem(F.lit("a.b.mp4"))) == "a.b" and one(spark, text.stem(F.lit(".hidden"))) == ".hidden"
    assert one(spark, text.vkey(F.lit("\t A  b.MP4 "))) == "a b.mp4" and one(spark, text.vkey(F.lit(" "))) is None
    assert one(spark, text.question_key(F.lit("  What\n IS  it? "))) == "what is it?"
    assert one(spark, text.intent_text(F.lit("Re-appear at Time–point 01:02:03"))) == "reappear at time point <time>"


def test_capabilities(spark):
    assert one(spark, capabilities.code(F.lit(""), F.lit("event_aggregation"))) == "3b" and one(spark, capabilities.code(F.lit("9z"), F.lit("x"))) == "9z" and one(spark, capabilities.code(F.lit(None).cast("string"), F.lit("odd"))) == "odd"
    for given, want in [("Temporal Grounding", "temporal_grounding"), ("object aggregation", "aggregation"), ("Event and Procedural Understanding", "event_understanding"), ("aggregations", None), ("x", None)]:
        assert one(spark, capabilities.group(F.lit(given))) == want


@pytest.mark.parametrize("x, want", [(119.0, "119"), (0.5, "0.5"), (1.25, "1.25"), (1234.5678, "1234.57"), (99.99999, "100"), (0.125, "0.125"), (300.0, "300")])
def test_short_numbers(spark, x, want):
    assert one(spark, prompts.short_number(F.lit(x))) == want


def test_prompts(spark):
    assert one(spark, prompts.request_prompt(F.lit(None).cast("string"), F.lit(" Why? "))) == "Current request:\nProcedure type: Unknown\nQuestion: Why?\nAnswer:"
    assert one(spark, prompts.request_prompt(F.lit("x"), F.lit("  "))) is None
    assert one(spark, prompts.placeholders(F.lit("<image>a<image>"))) == 2
    assert one(spark, prompts.expanded(F.lit("<image>"), 2)) == "<img><IMG_CONTEXT><IMG_CONTEXT></img>"
    assert one(spark, prompts.filled(F.lit("a {x} b"), "{x}", F.lit("1"))) == "a 1 b" and one(spark, prompts.filled(F.lit("{x}{x}"), "{x}", F.lit("1"))) is None
    assert one(spark, prompts.image_prefix(prompts.absolute_labels(F.lit(59.5), F.array(F.lit(0.0), F.lit(1.0))))) == "00:00:59: <image>\n00:01:00: <image>\n"
    assert one(spark, prompts.anchors_text(F.array().cast("array<double>"))) == "none"


@pytest.mark.parametrize("w, h, most, grid, patches", [(640, 360, 1, (1, 1), 1), (720, 576, 1, (1, 1), 1), (640, 360, 4, (2, 1), 3), (800, 800, 4, (2, 2), 5), (300, 300, 4, (1, 1), 1), (300, 1200, 4, (1, 4), 5)])
def test_tiles(spark, w, h, most, grid, patches):
    g = tiles.best_grid(F.lit(w), F.lit(h), most)
    assert tuple(one(spark, g)) == grid
    assert one(spark, tiles.patch_count(g)) == patches
    boxes = one(spark, tiles.tile_boxes(g))
    assert len(boxes) == grid[0] * grid[1] and tuple(boxes[-1])[2:] == (grid[0] * 448, grid[1] * 448)


@pytest.mark.parametrize("w, h, want", [(1920, 1080, (1024, 576)), (720, 577, (718, 576)), (5, 3, (4, 2)), (7, 1, (14, 2))])
def test_platform_size(spark, w, h, want):
    assert tuple(one(spark, tiles.platform_size(F.lit(w), F.lit(h)))) == want


SEGMENT = [
    ("What types of foreign objects are seen between 00:02:00 and  00:02:30? please provide the class name(s) or answer none.", 100.0, 200.0, "INTERVAL"),
    ("What types of foreign objects are seen between 00:02:00 and 00:02:00? Please provide the class name(s) or answer none.", 100.0, 200.0, "GLOBAL"),
    ("What types of foreign objects are seen between 00:01:00 and 00:02:30? Please provide the class name(s) or answer none.", 100.0, 200.0, "GLOBAL"),
    ("There is one odd/new thing-2 in the frame at 00:02:00. When is it retrieved from the surgical site? Please provide the answer in hh:mm:ss.", 100.0, 200.0, "FORWARD"),
    ("There is one Mesh in the frame at 00:03:20. When is it retrieved from the surgical site? Please provide the answer in hh:mm:ss.", 100.0, 200.0, "GLOBAL"),
    ("Does the Mesh, last visible just before 00:01:40, re-appear later in the video? Please answer with yes or no.", 100.0, 200.0, "FORWARD"),
    ("Does the Mesh, last visible just before 00:01:40, re-appear later in the video? Please answer with yes or no", 100.0, 200.0, "GLOBAL"),
    ("Does the Mesh, last visible just before 00:01:40, re-appear later in the video? Please answer with yes or no.", 200.0, 100.0, "GLOBAL"),
    ("Does the Mesh, last visible just before 00:01:40, re-appear later in the video? Please answer with yes or no.", float("nan"), 200.0, "GLOBAL"),
    ("", 0.0, 1.0, "GLOBAL"), (None, 0.0, 1.0, "GLOBAL"),
]


def test_segment_router(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(SEGMENT)], "question string, start_time double, end_time double, want string, i int")
    for r in with_segment_intent(df).collect():
        assert r["mode"] == r["want"], r
        assert (r["anchor_s"] is not None) == (r["mode"] == "FORWARD") and (r["t1_s"] is not None) == (r["mode"] == "INTERVAL")


PROCEDURE = [
    ("Which objects show up between 00:11:00 and 01:00:01?", "INTERVAL"), ("Seen from 00:11:00 through to 00:12:00?", "INTERVAL"), ("From 00:11:00–00:12:00, what?", "INTERVAL"),
    ("Is the Clip at 00:13:07 the one at 00:10:58?", "TWO_ANCHOR"), ("between 00:10:00 and 00:10:00", "INTERVAL"),
    ("Does a retrieval of the thing at 04:46:31 exist?", "FORWARD_SEARCH"), ("Does the loop before 04:47:38 re appear subsequently?", "FORWARD_SEARCH"),
    ("When was the Clip seen in the frame at 00:35:20 first inserted?", "BACKWARD_SEARCH"), ("By frame 00:49:00, how many are left?", "PREFIX_STATE"), ("How many at time-point 04:02:00, considering all  prior ones?", "PREFIX_STATE"),
    ("At timepoint 02:13:00 where is it?", "LOCAL_ANCHOR"), ("What is in frame 02:13:00?", "LOCAL_ANCHOR"), ("What was there before 02:13:00 at 02:13:00?", "GLOBAL"), ("Where, when it first occurs, at time point 02:13:00?", "LOCAL_ANCHOR"),
    ("At what time was the first one seen?", "GLOBAL"), ("What follows 02:13:00?", "GLOBAL"), ("At 02:73:00?", None), ("  ", None), (None, None),
]


def test_procedure_router(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(PROCEDURE)], "question string, want string, i int")
    for r in with_procedure_intent(df).collect():
        assert r["intent"] == r["want"], r


FORMATS = [
    ("Yes.", "yesno", True), ("maybe", "yesno", False), ("12", "count", True), ("12%", "count", False), ("12 %", "percent", True), ("12", "percent", False), ("00:01:02", "time", True), ("0:1:2", "time", False), ("Clip", "cls", True), ("Clip, Mesh", "cls", False), ("none", "cls", True),
    ("Clip, Mesh", "clslist", True), ("Clip, thing", "clslist", False), ("1. Clip: top/left 2. Mesh: bottom/right", "layout", True), ("Clip top", "layout", False), ("anything", "open", True), ("  ", "open", False), ("x", None, True), (None, "open", False),
]


@pytest.mark.parametrize("answer, form, want", FORMATS)
def test_formats(spark, answer, form, want):
    got = one(spark, answers.format_valid(F.lit(answer).cast("string"), F.lit(form).cast("string"), answers.class_names()))
    assert bool(got) == want
