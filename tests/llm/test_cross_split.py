import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.llm import bitmaps
from qaloom.llm import cross_split as c

SCHEMA = "sample_id string, split string, user_text string, assistant_text string, class int, words string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_against_full():
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 25))]
        b = [x for x in a if rng.random() > 0.15] if rng.random() < 0.7 else [rng.randrange(1, 5) for _ in range(rng.randrange(0, 25))]
        if b and rng.random() < 0.5:
            b.insert(rng.randrange(len(b)), 9)
        pairs.append((a, b))
    limit = np.array([rng.randrange(0, 6) for _ in pairs])
    got = c.within_edits([np.array(a, dtype=np.uint64) for a, _ in pairs], [np.array(b, dtype=np.uint64) for _, b in pairs], limit)
    want = [d if (d := distance(a, b)) <= k else -1 for (a, b), k in zip(pairs, limit)]
    assert got.tolist() == want


@pytest.mark.parametrize("n", [*range(0, 60), 90, 101, 250])
def test_enough_segments_fit(n):
    k, g = c.most_edits(n), c.segment_length(n)
    assert all(c.edits_allowed(n, m) <= k for m in range(0, 2 * n + 3) if abs(n - m) <= c.edits_allowed(n, m))
    if k:
        assert g >= 1 and n // g >= k + 1
        starts = np.flatnonzero(c.rarest_segments(np.arange(n - g + 1)[None, :], g, k + 1)[0]).tolist()
        assert len(starts) == k + 1 and all(y - x >= g for x, y in zip(starts, starts[1:]))


def test_choice_is_the_cheapest():
    from itertools import combinations

    rng = np.random.default_rng(3)
    costs = rng.integers(0, 20, (30, 13))
    mask = c.rarest_segments(costs, 3, 4)
    for row, m in zip(costs, mask):
        best = min(sum(row[list(x)]) for x in combinations(range(13), 4) if all(b - a >= 3 for a, b in zip(x, x[1:])))
        assert m.sum() == 4 and row[m].sum() == best and (np.diff(np.flatnonzero(m)) >= 3).all()


@pytest.mark.parametrize("n", [1999, 2004, 2005, 2010, 7777, 100_000])
def test_long_texts_are_cut_into_stretches(n):
    k, g = c.most_edits(n), c.segment_length(n)
    starts = np.flatnonzero(c.rarest_segments(np.random.default_rng(1).integers(0, 9, (1, n - g + 1)), g, k + 1)[0])
    assert len(starts) == k + 1 and (np.diff(starts) >= g).all() and starts[-1] + g <= n


def rows_with_edits(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so that segments are hot
    rows = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 20, 35, 60]))]
        answer = rng.choice(["yes", "Yes.", "no", "a b c"])
        rows.append((f"t{i}", "train", " ".join(text), answer))
        for e in range(rng.randrange(0, 3)):
            other = list(text)
            for _ in range(rng.randrange(0, max(1, len(text) // 9) + 1)):
                p = rng.randrange(len(other))
                rng.choice([lambda o, p: o.__setitem__(p, "zz"), lambda o, p: o.pop(p), lambda o, p: o.insert(p, "yy")])(other, p)
            rows.append((f"e{i}_{e}", rng.choice(["val", " TEST ", "Val"]), ", ".join(other).upper(), rng.choice([answer, answer, "else"])))
    return rows


def expected(rows):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, s, u, a in rows:
        for j, t, v, b in rows:
            if s and t and s.strip().lower() == "train" and t.strip().lower() in ("val", "test") and words(a) == words(b):
                x, y = words(u), words(v)
                if distance(x, y) <= max(len(x), len(y)) // 10:
                    out.add((i, j))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_all_pairs_against_brute_force(spark):
    rows = rows_with_edits()
    rows += [rows[0], rows[1], ("n1", None, "w1 w2", "yes"), ("n2", "train", None, None), ("n3", "val", None, None), ("n4", "other", "w1", "yes"), (None, "val", "w1", "yes"), ("n5", "val", "", "...")]
    got = {(r[0], r[1]) for r in c.cross_split_overlaps(frame(spark, rows)).select("train_id", "eval_id").collect()}
    want = {p for p in expected(rows) if p[1] is not None}
    assert got == want and len(want) > 20


def test_small_counters_and_bitmaps_lose_nothing(spark, monkeypatch):
    rows = rows_with_edits(9, 40)
    monkeypatch.setattr(c, "COUNTERS", 8)
    monkeypatch.setattr(c, "MOST_BITS", 1 << 6)
    got = {(r[0], r[1]) for r in c.cross_split_overlaps(frame(spark, rows)).select("train_id", "eval_id").collect()}
    assert got == expected(rows)


@pytest.fixture
def fetched(monkeypatch):
    """Rows that the driver's Python has fetched so far."""
    from pyspark.sql.classic.dataframe import DataFrame

    numbers = []
    for name in ("collect", "toPandas"):
        whole = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, whole=whole: (lambda rows: numbers.append(len(rows)) or rows)(whole(self)))
    return numbers


def test_bitmap_comes_to_the_driver_packed(spark, fetched, monkeypatch):
    monkeypatch.setattr(bitmaps, "PIECE", 1 << 19, raising=False)
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    hashes = rows.toArrow()["h"].to_numpy()
    for bits in (1 << 6, 1 << 21, 1 << 27):
        fetched.clear()
        got = bitmaps.bitmap(rows, "h", bits)
        bits = min(bits, 1 << 22)  # 16 a row
        want = np.zeros(bits, dtype=bool)
        want[(hashes.view(np.uint64) >> np.uint64(20)) & np.uint64(bits - 1)] = True
        assert got.dtype == np.uint32 and (np.unpackbits(got.view(np.uint8), bitorder="little") == want).all()
        assert 0 < sum(fetched) <= 8 and bitmaps.marked_in(got, hashes).all()
    assert not bitmaps.bitmap(rows.limit(0), "h").any()


def test_counters_come_to_the_driver_packed(spark, fetched):
    texts = [" ".join(f"{i}w{j}" for j in range(200)) for i in range(200)] * 2
    train = spark.createDataFrame([(i, bytearray(b"answer_k"), t) for i, t in enumerate(texts)], "class long, answer_key binary, words string").repartition(5)
    got = c.substring_counts(train, 10)
    want = np.zeros(c.COUNTERS, dtype=np.int64)
    numbers = c._Words()
    for t in texts:
        for size in c.partner_segment_lengths(200):
            np.add.at(want, c.gram_hashes(numbers.numbers(t), size, c._salt(b"answer_k")) & (c.COUNTERS - 1), 1)
    assert (got == want).all() and want.sum() > 70_000 and 0 < sum(fetched) <= c.COUNTERS // 4096


def test_classes_and_members_hold_all_pairs(spark):
    rows = rows_with_edits(7, 30)
    rows += [(f"copy{i}", s, u, a) for i, (_, s, u, a) in enumerate(rows)]
    links, members = c.linked_classes(frame(spark, rows))
    of = {}
    for r in members.collect():
        of.setdefault((r["side"], r["class"]), set()).add(r["id"])
    got = {(i, j) for r in links.collect() for i in of[0, r["class_train"]] for j in of[1, r["class_eval"]]}
    assert got == expected(rows)


def test_empty_and_one_sided(spark):
    assert c.cross_split_overlaps(frame(spark, [])).count() == 0
    assert c.cross_split_overlaps(frame(spark, [("a", "train", "x y", "z"), ("b", "train", "x y", "z")])).count() == 0


def test_copies_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(f"t{i}", "train", text, "yes") for i in range(30)] + [("e1", "val", text.replace("w7", "v7"), "Yes"), ("e2", "test", text, "no")]
    got = c.cross_split_overlaps(frame(spark, rows))
    assert got.count() == 30 and got.where(F.col("edits") == 1).count() == 30


def test_very_long_text(spark):
    text = [f"w{i % 97}" for i in range(6000)]
    other = list(text)
    for p in range(0, 6000, 20):
        other[p] = "changed"
    rows = [("t", "train", " ".join(text), "yes"), ("e", "val", " ".join(other), "yes")]
    assert c.cross_split_overlaps(frame(spark, rows)).collect()[0]["edits"] == 300
