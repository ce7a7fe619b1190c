"""Mixing sources to target weights.

Documents are tokenised with a public tokenizer and packed, source by source,
into blocks of ``block`` token ids.  The mixture has slots for its budget, dealt
evenly to output shards; a multinomial draw for each shard says how many of its
slots hold which source.  A source's slots are numbered across shards, and a
pseudo-random permutation of its block indices (another one for each repeat)
says which block a slot holds.  Slots and blocks are joined by index, so no
source is repeated more often than allowed.

Scale: packing is planned on token counts alone, as a running sum over each
source.  A source is dealt into lanes of about ``lane_tokens`` by hash of the
document, so a source of any size is packed in parallel; the last block of a
lane may be short.  Texts are exchanged once to meet their places, their pieces
once to meet in blocks.  Shards, draws and slots are rows of DataFrames; with
more than ``TARGETS_A_DRAW`` targets, groups of targets are drawn first and the
targets within each group after, which is the same distribution.

Defined results: sources are compared trimmed and in lower case; a null or blank
source is none; null text has no tokens; repeated rows count once.  A source
without a target is left out; a target without documents is reported with none.
Of several targets of one source the largest share counts in the mixture.  A
source that can't reach its share is drawn with what it can reach, and the slots
that it lacks stay unfilled.  Extra columns are ignored; empty tables give an
empty mixture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import trimmed_lower
from qaloom.operators.lineage import cut
from qaloom.operators.tokens import VOCABULARY, send_vocabulary, tokenizer

TARGETS_A_DRAW = 10_000
SHARDS_A_TASK = 1000


def _texts(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), trimmed_lower(F.col(source)).alias("source"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("t"))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, text_hash, n_tokens): each document once, whole texts."""
    name = send_vocabulary(docs.sparkSession, vocabulary)

    def work(batches):
        encode = tokenizer(name).encode_ordinary
        for batch in batches:
            yield batch.drop(columns="t").assign(n_tokens=[0 if t is None else len(encode(t)) for t in batch["t"]])

    kind = docs.schema[doc_id].dataType.simpleString()
    return _texts(docs, doc_id, source, text).mapInPandas(work, f"doc_id {kind}, source string, text_hash long, n_tokens long").distinct()


def mixing_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_pct, max_repeats, budget_pct, tokens, all_tokens, wanted, reachable, short): one row per target.

    ``short``: even with all repeats the source has fewer tokens than its share.
    """
    t = targets.select(trimmed_lower(F.col("source")).alias("source"), "target_pct", "max_repeats", "budget_pct").where("source is not null").distinct()
    per = cut(counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))  # a row a source, read twice
    everything = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    plan = t.join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).crossJoin(F.broadcast(everything))  # one row
    plan = plan.withColumn("wanted", F.col("target_pct") * F.col("budget_pct") * F.col("all_tokens") / 10000).withColumn("reachable", F.col("max_repeats") * F.col("tokens"))
    return plan.withColumn("short", F.col("reachable") < F.col("wanted"))


def pack(counts: DataFrame, block: int = 512, lane_tokens: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """The plan of packing: places (doc_id, source, text_hash, first_token) and blocks (source, block, n_tokens).

    ``first_token`` is where a document's tokens begin, block ``b`` of a source
    being its places ``b * block`` up to ``(b + 1) * block``.  Blocks of a source
    are numbered from 0 without holes; the last of a lane may end early.
    """
    rows = counts.select("doc_id", "source", "text_hash", "n_tokens").where("source is not null and n_tokens > 0")
    lanes = rows.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_tokens") / lane_tokens)).cast("bigint").alias("n_lanes"))
    # sources are as many as the data has, so Catalyst picks the join by their size
    dealt = rows.join(lanes, "source").withColumn("order", F.xxhash64("doc_id")).withColumn("lane", F.pmod("order", "n_lanes"))
    sizes = dealt.groupBy("source", "lane").agg(F.sum("n_tokens").alias("lane_size"), F.ceil(F.sum("n_tokens") / block).cast("bigint").alias("n"))
    first = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "lane", "lane_size", "n", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    along = Window.partitionBy("source", "lane").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("n_tokens").over(along), F.lit(0))).join(sizes.select("source", "lane", "base"), ["source", "lane"])
    places = placed.select("doc_id", "source", "text_hash", (F.col("base") * block + F.col("start")).alias("first_token"))
    blocks = sizes.select("source", "base", "lane_size", F.explode(F.expr("sequence(0, n - 1)")).alias("b"))  # a lane has few blocks
    return places, blocks.select("source", (F.col("base") + F.col("b")).alias("block"), F.least(F.lit(block), F.col("lane_size") - F.col("b") * block).cast("bigint").alias("n_tokens"))


def block_tokens(docs: DataFrame, places: DataFrame, block: int = 512, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, block, tokens): the token ids of each block."""
    name = send_vocabulary(docs.sparkSession, vocabulary)
    key = ["doc_id", "source", "text_hash"]
    once = _texts(docs, doc_id, source, text).where("t is not null and source is not null").groupBy(*key).agg(F.first("t").alias("t"))  # repeated rows, in the join's exchange

    def work(batches):
        encode = tokenizer(name).encode_ordinary
        for batch in batches:
            out: list[tuple[str, int, int, np.ndarray]] = []
            for s, t, first in zip(batch["source"], batch["t"], batch["first_token"]):
                ids, at = np.array(encode(t), dtype=np.int32), 0
                while at < len(ids):
                    size = block - (first + at) % block
                    out.append((s, (first + at) // block, (first + at) % block, ids[at : at + size]))
                    at += size
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["source", "block", "at", "ids"])
                    out = []
            yield pd.DataFrame(out, columns=["source", "block", "at", "ids"])

    pieces = once.join(places, key).select("source", "t", "first_token").mapInPandas(work, "source string, block long, at int, ids array<int>")
    whole = pieces.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))  # at most `block` pieces
    return whole.select("source", "block", F.flatten(F.col("p.ids")).alias("tokens"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each index under a pseudo-random permutation of ``range(size)`` chosen by the key.

    A Feistel network on the least even number of bits that covers ``size``;
    values that fall outside walk on until they fall inside.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            mixed = (right + key[todo].astype(np.uint64) + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def drawn_counts(plan: DataFrame, slots: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, source, n): how many slots of each shard hold which source.  plan: (source, p), the p summing up to at most 1."""
    spark = plan.sparkSession
    shards = max(1, -(-slots // shard_blocks))
    groups = max(1, -(-plan.count() // TARGETS_A_DRAW))
    plan = plan.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(groups)))
    weights = {r["group"]: float(r["p"]) for r in plan.groupBy("group").agg(F.sum("p").alias("p")).collect()}  # a row for TARGETS_A_DRAW targets
    at = sorted(g for g in weights if weights[g] > 0)
    p = np.array([weights[g] for g in at])
    p = np.append(p, max(0.0, 1.0 - p.sum())) / max(1.0, p.sum())

    def of_groups(batches):
        for b in batches:
            rows = []
            for i in b["id"]:
                n = np.random.Generator(np.random.PCG64([seed, int(i)])).multinomial(slots // shards + (i < slots % shards), p)
                rows += [(i, g, k) for g, k in zip(at, n.tolist()) if k]
            yield pd.DataFrame(rows, columns=["shard", "group", "n"])

    by_group = spark.range(shards).mapInPandas(of_groups, "shard long, group long, n long").withColumn("part", F.expr(f"shard div {SHARDS_A_TASK}"))
    dealt = plan.where("p > 0").select("group", "source", "p", F.explode(F.expr(f"sequence(0L, {(shards - 1) // SHARDS_A_TASK}L)")).alias("part"))

    def of_sources(n: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame([], columns=["shard", "source", "n"])
        t = t.sort_values("source")
        names, own = t["source"].to_numpy(), t["p"].to_numpy(dtype=float)
        rows = []
        for i, g, k in zip(n["shard"], n["group"], n["n"]):
            got = np.random.Generator(np.random.PCG64([seed, int(i), int(g) + 1])).multinomial(k, own / own.sum())
            rows += [(i, names[j], int(got[j])) for j in np.flatnonzero(got)]
        return pd.DataFrame(rows, columns=["shard", "source", "n"])

    return by_group.groupBy("group", "part").cogroup(dealt.groupBy("group", "part")).applyInPandas(of_sources, "shard long, source string, n long")


def mixture(counts: DataFrame, targets: DataFrame, blocks: DataFrame, block: int = 512, shard_blocks: int = 4096, seed: int = 1, slots_a_row: int = 100_000) -> DataFrame:
    """(shard, slot, source, repeat, block, n_tokens): which block each slot holds.  blocks: those of ``pack``."""
    n_blocks = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"))
    plan = mixing_plan(counts, targets).groupBy("source").agg(F.max(F.struct("target_pct", "max_repeats", "budget_pct")).alias("t"), F.max("all_tokens").alias("all_tokens"))
    plan = plan.select("source", F.greatest("t.target_pct", F.lit(0)).alias("pct"), F.coalesce(F.greatest("t.max_repeats", F.lit(0)), F.lit(0)).alias("repeats"), (F.col("t.budget_pct") / 100 * F.col("all_tokens")).alias("budget"))
    plan = cut(plan.join(n_blocks, "source", "left").withColumn("cap", F.col("repeats") * F.coalesce("n_blocks", F.lit(0))))  # a row for each target
    whole = plan.agg(F.max("budget").alias("budget"), F.sum("pct").alias("pct")).first()
    slots = int(np.ceil((whole["budget"] or 0.0) / block))
    total = max(100.0, float(whole["pct"] or 0.0))
    chance = F.least(F.col("pct") / total, F.col("cap") / max(slots, 1))  # a short source is spread over all shards
    drawn = drawn_counts(plan.select("source", F.coalesce(chance, F.lit(0.0)).alias("p")), slots, shard_blocks, seed)
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan.select("source", "cap", "n_blocks"), "source")
    ranges = ranges.withColumn("last", F.least(F.col("first") + F.col("n"), F.col("cap"))).where("last > first")
    ranges = ranges.select("shard", "source", "n_blocks", "last", F.explode(F.expr(f"sequence(first, last - 1, {slots_a_row}L)")).alias("first"))
    slot = ranges.select("shard", "source", "n_blocks", F.explode(F.expr(f"sequence(first, least(first + {slots_a_row}, last) - 1)")).alias("slot"))

    def place(batches):
        for b in batches:
            repeat = b["slot"].to_numpy() // b["n_blocks"].to_numpy()
            keys = {s: xxhash.xxh64_intdigest(f"{seed}:{s}") >> 1 for s in b["source"].unique()}
            key = b["source"].map(keys).to_numpy(dtype=np.int64, na_value=0) if len(b) else np.zeros(0, np.int64)
            key = key ^ (repeat * 1_000_003)
            yield b.assign(repeat=repeat, block=permuted(b["slot"].to_numpy() % b["n_blocks"].to_numpy(), b["n_blocks"].to_numpy(), key))[["shard", "slot", "source", "repeat", "block"]]

    placed = slot.mapInPandas(place, "shard long, slot long, source string, repeat long, block long")
    return placed.join(blocks, ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "n_tokens")


def filled(mixed: DataFrame, tokens: DataFrame) -> DataFrame:
    """(shard, slot, source, repeat, block, n_tokens, tokens): the mixture with the token ids of its blocks."""
    return mixed.join(tokens, ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "n_tokens", "tokens")


def mixture_report(counts: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_pct, tokens, all_tokens, mixed_tokens, actual_pct, most_repeats, short): actual shares of the mixture."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    all_ = got.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0)).alias("all_mixed"))
    report = mixing_plan(counts, targets).join(got, "source", "left").crossJoin(F.broadcast(all_))  # one row
    actual = F.coalesce(F.try_divide(F.col("mixed_tokens") * 100.0, F.col("all_mixed")), F.lit(0.0))
    return report.select("source", "target_pct", "tokens", "all_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), actual.alias("actual_pct"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "short")


def short_sources(counts: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source): sources whose blocks in the mixture hold fewer tokens than their share and that are ``short``.

    Whole blocks can leave a sufficient source a little below its share; the exact
    check tells it from one that lacks tokens.  Where a source has several
    targets, its blocks are not told apart and the exact check alone decides.
    """
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    plan = mixing_plan(counts, targets).withColumn("n_targets", F.count(F.lit(1)).over(Window.partitionBy("source")))
    return plan.join(got, "source", "left").where("short and (coalesce(mixed_tokens, 0) < wanted or n_targets > 1)").select("source").distinct()
