import random

import numpy as np
from pyspark.sql import functions as F

from qaloom.llm import group_splits as g

SCHEMA = "record string, entity string, label string, component int"


def union_find(rows):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    by = {}
    for r, e in rows:
        if r is not None and e is not None:
            root(e)
            by.setdefault(r, []).append(e)
    for es in by.values():
        for e in es[1:]:
            up[root(e)] = root(es[0])
    low = {}
    for e in up:
        low[root(e)] = min(e, low.get(root(e), e))
    return {e: low[root(e)] for e in up}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", f"e{rng.randrange(80):02d}") for i in range(60) for _ in range(rng.choice([1, 1, 2, 3]))]
    rows += [(f"c{i}", f"chain{i:03d}") for i in range(40)] + [(f"c{i}", f"chain{i + 1:03d}") for i in range(40)]  # a long path
    rows += rows[:10] + [(None, "e00"), ("r0", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record string, entity string, component int")
    assert {r["entity"]: r["component"] for r in g.components(df).collect()} == union_find(rows)
    assert g.components(df.limit(0)).count() == 0


def records(n=2000):
    rng = random.Random(6)
    rows = [(f"r{i}", "hot" if rng.random() < 0.34 else f"v{rng.randrange(200)}", rng.choice(["a", "a", "b", None])) for i in range(n)]
    return rows + rows[:50] + [("lone", None, "a"), ("two", "v1", "a"), ("two", "v2", "a"), (None, "v3", "a")]


def test_groups_stay_together_and_shares_are_met(spark):
    rows = records()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    out = {r["record"]: r["new_split"] for r in g.group_splits(df, {"train": 70, "val": 10, "test": 20}).collect()}
    assert set(out) == {r for r, _, _ in rows if r is not None}
    of = {}
    for r, e, _ in rows:
        if r is not None and e is not None:
            of.setdefault(e, set()).add(out[r])
    assert all(len(s) == 1 for s in of.values()) and of["v1"] == of["v2"]
    share = {s: sum(x == s for x in out.values()) / len(out) for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["val"] - 0.1) < 0.02
    again = {r["record"]: r["new_split"] for r in g.group_splits(df.repartition(7), {"test": 20, "train": 70, "val": 10}).collect()}
    assert again == out


def test_assignment_balances_labels():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(0, 20, 400), rng.integers(0, 5, 400)], axis=1).astype(float)
    got = g.assign(sizes, np.array([0.7, 0.1, 0.2]))
    for label in range(2):
        shares = np.bincount(got, weights=sizes[:, label], minlength=3) / sizes[:, label].sum()
        assert np.allclose(shares, [0.7, 0.1, 0.2], atol=0.02)


def test_torn_entities(spark):
    rows = [("1", "v", "train"), ("2", "v", "test"), ("3", "w", "train"), ("4", "w", None), ("5", None, "val"), ("6", "w", "train"), ("6", "x", "train"), ("7", "x", "val")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record string, entity string, split string, component int")
    # w lies in train only, but a record links it to x
    assert sorted(tuple(r) for r in g.torn(df, "record", "entity", "split").collect()) == [("v", "v", 2), ("w", "w", 1), ("w", "x", 2)]
    assert g.torn(df.where(F.lit(False)), "record", "entity", "split").count() == 0


def test_torn_entities_of_null_records(spark):
    rows = [(None, "v", "train"), (None, "v", "test"), ("1", "w", "train"), (None, "w", "test"), (None, "x", "val"), (None, "x", "val"), (None, None, "test")]
    df = spark.createDataFrame(rows, "record string, entity string, split string")
    assert sorted(tuple(r) for r in g.torn(df, "record", "entity", "split").collect()) == [("v", "v", 2), ("w", "w", 2)]


def test_empty_table(spark):
    assert g.group_splits(spark.createDataFrame([], SCHEMA), {"a": 1.0}).count() == 0


def test_many_components_and_labels(spark):
    """Beyond the bounds small components go in lumps and rare labels in groups, but nothing is torn and shares hold."""
    rows = [(f"r{i}", f"v{i % 700}" if i % 3 else "hot", f"l{i % 40}", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["record"]: (r["component"], r["new_split"]) for r in g.group_splits(df, {"train": 70, "test": 30}, heavy=20, units=64, max_labels=5).collect()}
    assert len(out) == 4000 and len({x for x in out.values()}) == len({c for c, _ in out.values()})
    assert abs(sum(s == "train" for _, s in out.values()) / 4000 - 0.7) < 0.05
