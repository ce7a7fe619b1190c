import numpy as np
from pyspark.sql import functions as F

from qaloom.llm import mixing as m


def docs(spark):
    rows = [(i, f"text number {i} with a few words " * (1 + i % 7), [" Big", "big ", "BIG"][i % 3], "x") for i in range(300)]
    rows += [(1000 + i, "short text here", "small", "x") for i in range(20)] + [(2000, None, "small", "x"), (2001, "", "small", "x"), (2002, "lost", None, "x"), (2003, "lost", " ", "x"), (2004, "other text", "unlisted", "x")]
    return spark.createDataFrame(rows + rows[:30], "doc_id long, text string, source string, n_tokens string").repartition(4)


def targets(spark):
    return spark.createDataFrame([("big", 70, 1, 50), ("small", 20, 3, 50), ("absent", 10, 2, 50)], "source string, target_pct int, max_repeats int, budget_pct int")


def test_permutations_hit_every_index_once():
    for size in (1, 2, 3, 17, 64, 1000):
        for key in (1, 99):
            got = m.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(got.tolist()) == list(range(size))
    assert m.permuted(np.arange(100), np.full(100, 100), np.full(100, 1)).tolist() != list(range(100))


def test_counts_are_whole_and_distinct(spark):
    counts = m.token_counts(docs(spark))
    assert counts.count() == 325
    want = len(m.tokenizer(m.VOCABULARY).encode_ordinary("short text here"))
    assert counts.where("doc_id = 1000").first()["n_tokens"] == want and counts.where("doc_id = 2000").first()["n_tokens"] == 0


def test_blocks_hold_each_token_once(spark):
    """The blocks' ids, read back from each document's place, are the document."""
    d = docs(spark)
    counts = m.token_counts(d)
    texts = {(r["doc_id"], r["source"]): r["text"] for r in d.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").collect()}
    sizes = {(r["doc_id"], r["source"]): r["n_tokens"] for r in counts.collect()}
    for lane in (50, 1_000_000):
        places, blocks = m.pack(counts, 32, lane)
        n = {(r["source"], r["block"]): r["n_tokens"] for r in blocks.collect()}
        tokens = {(r["source"], r["block"]): r["tokens"] for r in m.block_tokens(d, places, 32).collect()}
        assert {k: len(v) for k, v in tokens.items()} == n and max(n.values()) == 32 and min(n.values()) > 0
        seen = 0
        for r in places.collect():
            key, at = (r["doc_id"], r["source"]), r["first_token"]
            ids = [tokens[r["source"], i // 32][i % 32] for i in range(at, at + sizes[key])]
            assert m.tokenizer(m.VOCABULARY).decode(ids) == texts[key]
            seen += len(ids)
        assert seen == sum(n.values()) == sum(v for k, v in sizes.items() if k[1])
        for s in {k[0] for k in n}:
            assert sorted(b for x, b in n if x == s) == list(range(sum(x == s for x, _ in n)))


def mixed_of(counts, t, **kw):
    return m.mixture(counts, t, m.pack(counts, 32)[1], block=32, **kw)


def test_mixture_keeps_to_caps_and_shares(spark):
    counts, t = m.token_counts(docs(spark)), targets(spark)
    mixed = mixed_of(counts, t, shard_blocks=10)
    used = {r["source"]: (r["n"], r["most"]) for r in mixed.groupBy("source", "block").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    assert used["big"][1] == 1 and used["small"][1] <= 3 and set(used) == {"big", "small"}
    assert mixed.select("shard", "source", "slot").distinct().count() == mixed.count()
    assert mixed.groupBy("shard").count().agg(F.max("count")).first()[0] <= 10 and mixed.select("shard").distinct().count() > 4
    report = {r["source"]: r for r in m.mixture_report(counts, mixed, t).collect()}
    assert report["absent"]["short"] and report["absent"]["mixed_tokens"] == 0 and not report["big"]["short"]
    total = report["big"]["mixed_tokens"] + report["small"]["mixed_tokens"]
    assert abs(report["big"]["actual_pct"] - 100 * report["big"]["mixed_tokens"] / total) < 1e-9
    key = lambda d: sorted((r["shard"], r["source"], r["slot"], r["block"]) for r in d.collect())
    assert key(mixed) == key(mixed_of(counts.repartition(9), t, shard_blocks=10))
    whole = m.filled(mixed, m.block_tokens(docs(spark), m.pack(counts, 32)[0], 32))
    assert whole.count() == mixed.count() and whole.where("size(tokens) <> n_tokens").count() == 0


def test_shard_counts_are_multinomial(spark, monkeypatch):
    plan = spark.createDataFrame([(f"s{i}", 0.018 if i < 50 else 0.0) for i in range(60)], "source string, p double")
    for most in (10_000, 7):  # targets drawn together, and in groups
        monkeypatch.setattr(m, "TARGETS_A_DRAW", most)
        got = m.drawn_counts(plan, 100_050, 1000, 3).toPandas()
        per = got.groupby("shard")["n"].sum()
        assert len(per) == 101 and 850 < per.min() and per.max() <= 1000  # a tenth is for no source
        of = got.groupby("source")["n"].sum()
        assert len(of) == 50 and of.min() > 1500 and of.max() < 2100
        one = got[got["source"] == "s1"].set_index("shard")["n"].reindex(range(101), fill_value=0)
        assert 8 < one.var() < 32  # a fixed share would not vary


def test_empty(spark):
    none = m.token_counts(docs(spark).where(F.lit(False)))
    assert mixed_of(none, targets(spark)).count() == 0
    assert m.mixing_plan(none, targets(spark)).count() == 3
    assert mixed_of(m.token_counts(docs(spark)), targets(spark).where(F.lit(False))).count() == 0
