"""Frame selection against an independent NumPy version."""

import random

import numpy as np
from pyspark.sql import functions as F

from qaloom.operators import frames as f


def np_cap(a, k):
    a = np.asarray(a)
    if len(a) <= k:
        return a
    if k <= 0:
        return a[:0]
    return a[np.rint(np.linspace(0, len(a) - 1, k)).astype(int)]


def np_nearest(t, fps, total):
    return int(np.clip(np.rint(t * fps), 0, total - 1))


def np_region(a, b, fps, total, rate):
    last = (total - 1) / fps
    a, b = np.clip(a, 0, last), np.clip(b, 0, last)
    a, b = min(a, b), max(a, b)
    if np.isclose(a, b):
        return np.array([np_nearest(a, fps, total)])
    step = 1 / rate
    t = a + np.arange(int(np.floor((b - a) / step)) + 1) * step
    if t[-1] < b - 1e-9:
        t = np.append(t, b)
    return np.unique(np.clip(np.rint(t * fps), 0, total - 1).astype(int))


def np_around(t, fps, total, radius, rate, k):
    last = (total - 1) / fps
    t = float(np.clip(t, 0, last))
    i = np_nearest(t, fps, total)
    a = np.union1d(np_region(max(0, t - radius), min(last, t + radius), fps, total, rate), [i])
    if len(a) <= k:
        return a
    if k == 1:
        return np.array([i])
    return np.union1d([i], np_cap(a[a != i], k - 1))


def np_procedure(intent, anchors, start, fps, total, most, radius=1.0, local=2.0):
    last = (total - 1) / fps
    tol = max(1 / fps, 0.25)
    rel = [min(max(a - start, 0.0), last) for a in anchors if -tol <= a - start <= last + tol]
    if not rel or (intent == "INTERVAL" and len(rel) < 2):
        intent = "GLOBAL"
    if intent == "GLOBAL":
        return intent, np_cap(np_region(0, last, fps, total, 1.0), most)
    if intent == "INTERVAL":
        a, b = sorted(rel[:2])
        return intent, np_cap(np_region(a, b, fps, total, 1.0), most)
    k = min(5, most)
    if intent == "TWO_ANCHOR":
        return intent, np_cap(np.unique(np.concatenate([np_around(a, fps, total, radius, local, k) for a in rel])), most)
    near = np_around(rel[0], fps, total, radius, local, k)
    if intent == "LOCAL_ANCHOR":
        return intent, near
    a, b = (rel[0], last) if intent == "FORWARD_SEARCH" else (0.0, rel[0])
    pool = np_region(a, b, fps, total, 1.0)
    some = np.union1d(near, np_cap(pool, max(1, most - len(near))))
    if len(some) >= most:
        return intent, np_cap(some, most)
    return intent, np.union1d(some, np_cap(pool[~np.isin(pool, some)], most - len(some))).astype(int)


def np_segment(mode, anchor, t1, t2, start, fps, total, most):
    last = (total - 1) / fps
    grid = np.unique(np.clip(np.rint(np.arange(int(np.floor(last)) + 1) * fps), 0, total - 1).astype(int))
    times = grid / fps
    if mode == "INTERVAL":
        g = grid[(start + times >= t1) & (start + times <= t2)]
        if len(g):
            return "INTERVAL", np_cap(g, most)
    if mode == "FORWARD" and times[0] <= anchor - start <= times[-1]:
        rel = anchor - start
        local = sorted({int(grid[np.argmin(np.abs(times - t))]) for t in (rel - 1, rel, rel + 1, rel + 2) if times[0] <= t <= times[-1]})
        pool = grid[times > rel + 2]
        sel = np.union1d(np.array(local, int), np_cap(pool, most - len(local))).astype(int)
        return "FORWARD", np_cap(sel, most)
    return "GLOBAL", np_cap(grid, most)


def test_even_spacing(spark):
    rows = [(n, k) for n in [0, 1, 2, 3, 5, 31, 32, 33, 47, 48, 100, 999, 5403] for k in [0, 1, 2, 3, 31, 32, 47, 52]]
    df = spark.createDataFrame(rows, "n int, k int").withColumn("a", f.span(F.col("n"))).withColumn("c", f.cap(F.col("a"), F.col("k")))
    for r in df.collect():
        assert r["c"] == np_cap(np.arange(r["n"]), r["k"]).tolist(), (r["n"], r["k"])


def test_candidate_times(spark):
    rows = [(d,) for d in (0.2, 1.0, 1.0000000001, 1.5, 10.0, 299.999, 300.0)]
    got = [len(r[0]) for r in spark.createDataFrame(rows, "d double").select(f.candidate_times(F.col("d"))).collect()]
    assert got == [1, 1, 1, 2, 10, 300, 300]


def test_frame_plan_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0.1, 2.1, 25.0, 1000), (119.5, 121.0, 29.97, 100), (3599.0, 3601.0, 25.0, 10**6)], "start_time double, end_time double, fps double, total_frames long")
    got = [[(x["source_index"], x["timestamp"], x["file"]) for x in r["frames"]] for r in f.frame_plan(df).collect()]
    assert [x[0] for x in got[0]] == [2, 28]  # 2.5 and 27.500000000000004
    assert [x[0] for x in got[1]] == [99, 99]
    assert got[2] == [(89975, "00:59:59", "frame_000089975_00-59-59.jpg"), (90000, "01:00:00", "frame_000090000_01-00-00.jpg")]


def test_segments_against_numpy(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        fps = rng.choice([5.0, 25.0, 29.97, 30.0])
        total = rng.randrange(1, 9000)
        start = rng.choice([0.0, 100.5, 1234.25])
        mode = rng.choice(["INTERVAL", "FORWARD", "GLOBAL"])
        a = start + rng.choice([rng.randrange(-3, int(total / fps) + 4), rng.random() * total / fps])
        b = a + rng.choice([0.3, 5, 60])
        rows.append((i, mode, float(a), float(a), float(b), start, fps, total))
    df = spark.createDataFrame(rows, "i int, mode string, anchor_s double, t1_s double, t2_s double, start_time double, fps double, total_frames int")
    for most in (32, 4, 1):
        for r in f.with_segment_frames(df, most=most).collect():
            mode, want = np_segment(r["mode"], r["anchor_s"], r["t1_s"], r["t2_s"], r["start_time"], r["fps"], r["total_frames"], most)
            assert (r["used_mode"], r["selected"]) == (mode, want.tolist()), r


def test_procedures_against_numpy(spark):
    rng = random.Random(2)
    intents = ["GLOBAL", "INTERVAL", "TWO_ANCHOR", "LOCAL_ANCHOR", "FORWARD_SEARCH", "BACKWARD_SEARCH", "PREFIX_STATE"]
    rows = []
    for i in range(700):
        fps = rng.choice([25.0, 29.97, 30.0, 1.0, 0.7, 1.3])
        total = rng.randrange(1, 100_000 if fps > 2 else 3000)
        start = rng.choice([0.0, 77.5])
        anchors = [float(start + rng.choice([rng.randrange(-2, int(total / fps) + 3), 0, (total - 1) / fps])) for _ in range(rng.randrange(0, 13) if i % 9 == 0 else rng.randrange(0, 4))]
        rows.append((i, intents[i % 7], anchors, start, fps, total))
    df = spark.createDataFrame(rows, "i int, intent string, anchors array<double>, start_time double, fps double, total_frames int")
    for most in (52, 6, 3):
        out = f.with_procedure_frames(df, most=most)
        for r in out.collect():
            intent, want = np_procedure(r["intent"], r["anchors"], r["start_time"], r["fps"], r["total_frames"], most)
            assert (r["used_intent"], r["selected"]) == (intent, want.tolist()), r
            assert r["description"].startswith(f"{len(want)} chronologically")
        assert f.clip_violations(out, "i", most).count() == 0


def test_violations(spark):
    df = spark.createDataFrame([("a", [1, 1], 5), ("b", [], 5), ("c", [9], 5), ("d", [0, 1, 2, 3], 5), ("e", [0, 4], 5)], "k string, selected array<bigint>, total_frames int")
    assert sorted(map(tuple, f.clip_violations(df, "k", 3).collect())) == [("a", "not_increasing"), ("b", "empty"), ("c", "out_of_range"), ("d", "too_many")]
