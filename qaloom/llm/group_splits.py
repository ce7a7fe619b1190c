"""Splits that keep related records together.

Records and the entities they share (author, source, video ...) form a
bipartite graph; its components, found by propagating minimum labels, are what
may not be torn apart.  Components are then given to splits so that the sizes
meet the wanted shares and every label is spread over the splits alike.

Scale: a record with one entity can't join components, so labels run only over
records with several; of these, records with the same entities are one node, so
a hot entity costs one node per distinct neighbourhood.  Labels jump to their
label's label each round, so chains need few rounds.  Each round is
written to the checkpoint folder, and the round before it released.

Assignment is greedy over units.  Up to ``heavy + units`` components are a unit
each.  Beyond that, each component that holds more than a ``1 / heavy`` part of
all records is a unit (there are fewer than ``heavy``), all others are hashed
into ``units`` units.  Labels beyond the ``max_labels`` most frequent are hashed
into as many groups, each balanced on its own.  So the driver handles at most
``heavy + units`` units times ``2 * max_labels`` labels, whatever the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.operators.lineage import cut, release


def components(edges: DataFrame, record: str = "record", entity: str = "entity") -> DataFrame:
    """(entity, component): the least entity that each entity is linked to through records.

    Null records and entities are no edge; repeated edges count once; extra
    columns are ignored; an empty table gives no rows.
    """
    e = edges.select(F.col(record).alias("record"), F.col(entity).alias("entity")).where("record is not null and entity is not null")
    entities = e.select("entity").distinct()
    shape = e.distinct().groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("entity")).alias("x"), F.sum(F.xxhash64("entity").cast("decimal(38,0)")).alias("s"), F.min("entity").alias("low"), F.max("entity").alias("high")).where("n > 1")
    node = F.xxhash64("n", "x", "s", "low", "high").alias("node")
    links = e.join(shape.select("record", node), "record").select("node", "entity").distinct()
    if links.isEmpty():
        return entities.select("entity", F.col("entity").alias("component"))
    links = cut(links)
    held = labels = cut(links.select("entity").distinct().withColumn("component", F.col("entity")))
    while True:
        of_node = links.join(labels, "entity").groupBy("node").agg(F.min("component").alias("c"))
        near = links.join(of_node, "node").groupBy("entity").agg(F.min("c").alias("c"))
        jump = labels.select(F.col("entity").alias("c"), F.col("component").alias("jumped"))
        new = labels.join(near, "entity").join(jump, "c").select("entity", F.least("component", "c", "jumped").alias("component"), (F.least("component", "c", "jumped") != F.col("component")).alias("changed"))
        new = cut(new)
        moved = not new.where("changed").isEmpty()
        release(held)
        held, labels = new, new.select("entity", "component")
        if not moved:
            break
    return entities.join(labels, "entity", "left").select("entity", F.coalesce("component", "entity").alias("component"))


def torn(records: DataFrame, record: str, entity: str, split: str) -> DataFrame:
    """(component, entity, n_splits): the entities of components that lie in more than one split today.

    ``n_splits`` counts the splits of the entity's own records: linked records
    can tear a component none of whose entities is torn itself.  Null entities
    and splits make no case.  Rows with a null record link no entities, but
    their splits count; an entity that has only such rows is its own component.
    """
    records = cut(records.select(record, entity, split))  # read by the graph and by the counts
    pairs = records.where(F.col(entity).isNotNull() & F.col(split).isNotNull()).select(F.col(entity).alias("entity"), F.col(split).alias("split")).distinct()
    own = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n_splits"), F.min("split").alias("a"), F.max("split").alias("b"))
    known = own.join(components(records, record, entity), "entity", "left").withColumn("component", F.coalesce("component", "entity"))
    several = known.groupBy("component").agg(F.min("a").alias("least"), F.max("b").alias("most")).where("least <> most").select("component")
    return known.join(several, "component", "left_semi").select("component", "entity", "n_splits")


def assign(sizes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split of each unit.  sizes: units x labels; shares: of the splits.

    Largest first, each unit goes where the squared distance of the
    split-by-label counts from their targets, weighted by label size, grows least.
    """
    total = sizes.sum(0)
    target = shares[:, None] * total[None, :]
    weight = 1.0 / np.maximum(total, 1.0)
    have = np.zeros_like(target)
    whole = sizes.sum()
    size_target, size_have = shares * whole, np.zeros(len(shares))
    out = np.zeros(len(sizes), dtype=np.int64)
    for u in np.lexsort((np.arange(len(sizes)), -sizes.sum(1))):
        gap, x = target - have, sizes[u]
        cost = ((x[None, :] ** 2 - 2 * gap * x[None, :]) * weight[None, :]).sum(1)
        n = x.sum()
        cost += (n**2 - 2 * (size_target - size_have) * n) / max(whole, 1.0) * len(total)
        s = int(np.argmin(cost))
        have[s] += x
        size_have[s] += n
        out[u] = s
    return out


def group_splits(records: DataFrame, shares: dict[str, float], record: str = "record", entity: str = "entity", label: str = "label", heavy: int = 2000, units: int = 4096, max_labels: int = 200) -> DataFrame:
    """(record, component, new_split): one row per record.

    A record with several entities has the component of all of them.  A null
    entity makes the record a component of its own; a null label is a label.
    """
    if not shares:
        raise ValueError("no splits to assign to")
    spark = records.sparkSession
    rows = records.select(F.col(record).alias("record"), F.col(entity).alias("entity"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).where("record is not null").distinct()
    parts = components(rows, "record", "entity")
    linked = rows.join(parts, "entity", "left").groupBy("record").agg(F.min("component").alias("component"), F.min("label").alias("label"))
    linked = cut(linked.select("record", F.coalesce("component", F.concat(F.lit("record:"), F.col("record").cast("string"))).alias("component"), "label"))

    counts = cut(linked.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")))
    whole = counts.groupBy("component").agg(F.sum("n").alias("size"))
    sums = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    own = F.concat(F.lit("c:"), F.col("component"))
    if sums["n"] <= heavy + units:
        unit = own
    else:
        large = [r["component"] for r in whole.where(F.col("size") * heavy > sums["size"]).collect()]  # fewer than `heavy` by their size
        lump = F.concat(F.lit("u:"), F.pmod(F.xxhash64("component"), F.lit(units)).cast("string"))
        unit = F.when(F.col("component").isin(large), own).otherwise(lump) if large else lump
    top = [r["label"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels).collect()]
    rest = F.concat(F.lit("h:"), F.pmod(F.xxhash64("label"), F.lit(max_labels)).cast("string"))
    kept = F.when(F.col("label").isin(top), F.concat(F.lit("l:"), F.col("label"))).otherwise(rest) if top else rest
    table = counts.groupBy(unit.alias("unit"), kept.alias("label")).agg(F.sum("n").alias("n")).collect()  # bounded, see above
    names, kinds = sorted({r["unit"] for r in table}), sorted({r["label"] for r in table})
    labels = {x: i for i, x in enumerate(kinds)}
    sizes = np.zeros((len(names), max(len(labels), 1)))
    at = {u: i for i, u in enumerate(names)}
    for r in table:
        sizes[at[r["unit"]], labels[r["label"]]] += r["n"]
    splits = sorted(shares)
    wanted = np.array([shares[s] for s in splits], dtype=float)
    chosen = assign(sizes, wanted / wanted.sum())
    mapping = spark.createDataFrame([(u, splits[chosen[i]]) for u, i in at.items()], "unit string, new_split string")
    return linked.withColumn("unit", unit).join(F.broadcast(mapping), "unit").select("record", "component", "new_split")
