import random

import numpy as np

from qaloom.llm import leakage as k

SCHEMA_D = "doc_id long, text string, item_id int"
SCHEMA_I = "item_id long, text string, doc_id string"


def data(seed=8):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eins zwei très niño 12 7".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 30, 50])))) for i in range(12)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(items)[1].split()
            n = rng.randrange(8, 20)
            s = rng.randrange(len(t))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[s : s + n]
        docs.append((i, rng.choice([", ", "\n> ", " “", "-"]).join(w).title()))
    return docs, items


def brute(docs, items, size=12):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in items:
        x = words(t)
        windows = {tuple(x[j : j + size]) for j in range(len(x) - size + 1)}
        for d, u in docs:
            y = words(u)
            if any(tuple(y[j : j + size]) in windows for j in range(len(y) - size + 1)):
                out.add((d, i))
    return out


def test_both_ways_against_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, 1) for x in [*docs, docs[0], (500, None), (501, ""), (None, items[3][1])]], SCHEMA_D)
    i = spark.createDataFrame([(*x, "x") for x in [*items, items[0], (50, None), (None, "a b")]], SCHEMA_I)
    want = brute(docs, items)
    for bound in (k.SEEDS_IN_MEMORY, 0):
        rows = k.leaks(d, i, seeds_in_memory=bound).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want) > 10
        assert all(r["longest"] >= 12 and r["matched_words"] >= r["longest"] and 0 < r["coverage"] <= 1 for r in rows)


def test_tiling_finds_reordered_passages():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate((item[20:], np.full(5, 99, np.uint64), item[:20]))
    tiles = k.tile(doc, item, 12)
    assert sorted(tiles) == [(0, 20, 20), (25, 0, 20)]
    assert k.tile(np.concatenate((item, item)), item, 12) == [(0, 0, 40)]
    assert k.tile(item[:11], item, 12) == []


def test_tiles_never_overlap():
    rng = random.Random(1)
    for _ in range(40):
        a = np.array([rng.randrange(3) for _ in range(60)], dtype=np.uint64)
        b = np.array([rng.randrange(3) for _ in range(60)], dtype=np.uint64)
        tiles = k.tile(a, b, 4)
        used_a = [p for i, _, n in tiles for p in range(i, i + n)]
        used_b = [p for _, j, n in tiles for p in range(j, j + n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in tiles)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], SCHEMA_D), spark.createDataFrame([], SCHEMA_I)
    one = spark.createDataFrame([(1, "a b c d e f g h i j k l m", 1)], SCHEMA_D)
    for bound in (k.SEEDS_IN_MEMORY, 0):
        assert k.leaks(d, i, seeds_in_memory=bound).count() == 0 and k.leaks(one, i, seeds_in_memory=bound).count() == 0


def test_first_tile_is_the_longest_passage():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [rng.randrange(3) for _ in range(50)], [rng.randrange(3) for _ in range(40)]
        want = max((n for i in range(50) for j in range(40) for n in range(1, 41) if a[i : i + n] == b[j : j + n] and i + n <= 50 and j + n <= 40), default=0)
        tiles = k.tile(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 4)
        assert (tiles[0][2] if tiles else 0) == (want if want >= 4 else 0)
        assert [n for _, _, n in tiles] == sorted((n for _, _, n in tiles), reverse=True)
        # nothing that could still be tiled is left
        left_a, left_b = list(a), [x + 10 for x in b]
        for i, j, n in tiles:
            left_a[i : i + n], left_b[j : j + n] = range(100, 100 + n), range(200, 200 + n)
        assert not any([x + 10 for x in left_a[i : i + 4]] == left_b[j : j + 4] for i in range(47) for j in range(37))


def test_repetitive_texts(spark):
    """A text of one word a hundred thousand times, and one of a phrase repeated, against items like them."""
    import time

    d = spark.createDataFrame([(1, "na " * 100_000, 1), (2, "one two three four five " * 20_000, 1)], SCHEMA_D)
    i = spark.createDataFrame([(1, "na " * 300, "x"), (2, "two three four five one " * 60, "x"), (3, "na " * 11, "x")], SCHEMA_I)
    began = time.perf_counter()
    rows = {(r["doc_id"], r["item_id"]): (r["longest"], r["coverage"]) for r in k.leaks(d, i).collect()}
    assert rows == {(1, 1): (300, 1.0), (2, 2): (300, 1.0)} and time.perf_counter() - began < 60


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    docs, items = data(5)
    monkeypatch.setattr(k, "bitmap", lambda rows, h: np.full(2, 0xFFFFFFFF, dtype=np.uint32))
    d, i = spark.createDataFrame([(*x, 1) for x in docs], SCHEMA_D), spark.createDataFrame([(*x, "x") for x in items], SCHEMA_I)
    assert {(r["doc_id"], r["item_id"]) for r in k.leaks(d, i, seeds_in_memory=0).collect()} == brute(docs, items)
