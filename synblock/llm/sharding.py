"""Sharding by K-d tree partitioning, with DataFrame operations only.

The law is ``bytes``: shards hold nearly equal sizes. The tree splits its nodes, all of a level at
once, at a weighted median (weighted by size, in the proportion of the leaves on either side)
along the widest dimension of each node, until every leaf has the target bytes. The dimensions
are metadata: the length of the text (logarithm), its source and its language, the latter two as exact ranks
of their values, whatever these have in common. Medians are exact
and distributed: ``weighted_cuts`` narrows them down by histograms, the driver seeing at most
1024 numbers a node and pass.

Rows with equal texts form a group and lie at one point of the tree (that of the group's least
source and language), so a group stays in one shard, unless its bytes straddle a cut and weigh
more than ``tolerance`` of a shard: then it is cut too, by a hash of the ids, so that a group of
any size leaves the shards even. Slots are numbered without gathering a shard in a task.

A null text has no bytes (size 8, CRC of the empty string); null sources and languages are values
of their own, last in order. Rows repeated keep slots of their own, and are told apart by a number where a cut goes
through them. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from synblock import scratch
from synblock.operators.distinct import copies, places
from synblock.operators.quantile import weighted_cuts

SHARDS = 24
OVERHEAD = 8
TOLERANCE = 0.002
RUN = 2000
FEW = 50_000
_UNIT = (1 << 30) - 1


def _placed(slim: DataFrame, name: str) -> DataFrame:
    """Column ``name`` turned from values into places in [0, 2**30): their ranks, spread evenly."""
    table = scratch.materialize(places(slim, name), "places")
    last = max(1, (table.agg(F.max("place")).first()[0] or 0))
    ranked = table.select(F.col("value").alias("_v"), F.floor(F.col("place") * (_UNIT / last)).cast("long").alias("_p"))
    ranked = F.broadcast(ranked) if last < FEW else ranked
    return slim.join(ranked, F.col(name).eqNullSafe(F.col("_v")), "left").withColumn(name, F.col("_p")).drop("_v", "_p")


def points(docs: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...]) -> DataFrame:
    """A slim row per document: size, CRC, one order key per dimension and one that tells rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.octet_length(text).cast("string"), F.crc32(text.cast("binary")).cast("string"), F.xxhash64(text).cast("string")))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), one.alias("one"),
        *(F.col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dims)),
    )
    slim = scratch.materialize(slim.withColumn("row", F.monotonically_increasing_id()), "points")
    number = scratch.materialize(copies(slim, "one", "row").where("copy > 0"), "copies")
    for i in range(len(dims)):
        slim = _placed(slim, f"d{i}")
    slim = scratch.materialize(slim.drop("one"), "placed")
    by = ["h", "size", "text_crc32"]
    # only groups with two texts or more are looked up; written, so that either side of the join has its exchange
    least = slim.groupBy(*by).agg(F.count("*").alias("_n"), *(F.min(f"d{i}").alias(f"m{i}") for i in range(len(dims)))).where("_n > 1").drop("_n")
    least = scratch.materialize(least, "groups")
    tail = F.pmod("h", F.lit(1 << 32)).cast("long")
    length = F.floor(F.log2("size") / 40.0 * _UNIT).cast("long")
    keys = [(F.shiftleft(x, 32) + tail).alias(f"k{i}") for i, x in enumerate([length, *(F.coalesce(f"m{i}", f"d{i}") for i in range(len(dims)))])]
    salt = F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.coalesce("copy", F.lit(0).cast("long"))), 2).alias("salt")
    return slim.join(least, by, "left").join(number, "row", "left").select("doc_id", "size", "text_crc32", *keys, salt)


def _leaves(shards: int) -> list[dict]:
    """Levels of a tree with ``shards`` leaves: of each node, its leaves on the left and on the right."""
    levels, now = [], {0: shards}
    while any(n > 1 for n in now.values()):
        levels.append({k: (n // 2, n - n // 2) if n > 1 else (n, 0) for k, n in now.items()})
        now = {2 * k + side: m for k, halves in levels[-1].items() for side, m in enumerate(halves) if m}
    return levels


def kd_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    at, path = scratch.written(points(docs, id_col, text_col, dims).withColumn("node", F.lit(0)), "kd")
    n = len(dims) + 1
    for level in _leaves(shards):
        split = [k for k, (_, right) in level.items() if right]
        stats = at.groupBy("node").agg(F.sum("size").alias("w"), *(f(f"k{i}").alias(f"{name}{i}") for i in range(n) for name, f in (("lo", F.min), ("hi", F.max)))).collect()  # a row a node
        stats = {r["node"]: r for r in stats if r["node"] in split}
        width = {k: [r[f"hi{i}"] - r[f"lo{i}"] for i in range(n)] for k, r in stats.items()}
        widest = {k: max(range(n), key=lambda i, k=k: (width[k][i], -i)) for k in stats}
        goal = {k: r["w"] * level[k][0] / sum(level[k]) for k, r in stats.items()}
        slack = {k: r["w"] / sum(level[k]) * tolerance for k, r in stats.items()}
        size = max(level) + 1
        pick = F.element_at(F.array(*(F.lit(widest.get(k, 0)) for k in range(size))), F.col("node") + 1)
        keyed = at.withColumn("key", F.element_at(F.array(*(F.col(f"k{i}") for i in range(n))), pick + 1))
        cuts = weighted_cuts(keyed.where(F.col("node").isin(split)), "node", "key", "size", goal)
        every = {k: cuts.get(k, 1 << 62) for k in range(size)}
        cut = F.element_at(F.array(*(F.lit(every[k]).cast("long") for k in range(size))), F.col("node") + 1)
        # what the whole keys leave over: a group that straddles the cut is cut by its salt
        sums = keyed.where(F.col("node").isin(split)).groupBy("node").agg(
            F.sum(F.when(F.col("key") < cut, F.col("size")).otherwise(0)).alias("left"),
            F.max(F.when(F.col("key") < cut, F.col("key"))).alias("last"),
            F.min(F.when(F.col("key") >= cut, F.col("key"))).alias("next"),
        )
        torn = {}
        for r in sums.collect():
            over = r["left"] - goal[r["node"]]
            if abs(over) > slack[r["node"]]:
                torn[r["node"]] = r["last"] if over > 0 else r["next"]
        salt_cut = {}
        if torn := {k: v for k, v in torn.items() if v is not None}:
            key_of = F.element_at(F.array(*(F.lit(torn.get(k, -1)).cast("long") for k in range(size))), F.col("node") + 1)
            group = keyed.where(F.col("node").isin(list(torn)) & (F.col("key") == key_of))
            below = {r["node"]: r["b"] or 0 for r in keyed.where(F.col("node").isin(list(torn))).groupBy("node").agg(F.sum(F.when(F.col("key") < key_of, F.col("size"))).alias("b")).collect()}
            salt_cut = weighted_cuts(group, "node", "salt", "size", {k: goal[k] - below[k] for k in torn})
        key_at = F.element_at(F.array(*(F.lit(torn.get(k, every[k])).cast("long") for k in range(size))), F.col("node") + 1)
        salt_at = F.element_at(F.array(*(F.lit(salt_cut.get(k, 0)).cast("long") for k in range(size))), F.col("node") + 1)
        right = ((F.col("key") > key_at) | ((F.col("key") == key_at) & (F.col("salt") >= salt_at))).cast("int")
        at, new = scratch.written(keyed.withColumn("node", F.col("node") * 2 + right).drop("key"), "kd")
        scratch.delete(docs.sparkSession, path)
        path = new
    leaf = at.groupBy("node").count().collect()  # a row a shard
    rows = {r["node"]: r["count"] for r in leaf}
    names = {k: i for i, k in enumerate(sorted(2 * k + side for k, halves in level.items() for side, m in enumerate(halves) if m))} if shards > 1 else {0: 0}
    size = max(names) + 1
    shard = F.element_at(F.array(*(F.lit(names.get(k, -1)) for k in range(size))), F.col("node") + 1)
    runs = F.element_at(F.array(*(F.lit(math.ceil(max(rows.get(k, 1), 1) / RUN)) for k in range(size))), F.col("node") + 1)
    out = at.select("doc_id", "size", "text_crc32", "salt", shard.cast("int").alias("shard"), F.pmod("salt", runs).cast("long").alias("run"))
    counts = out.groupBy("shard", "run").count()
    starts = counts.select("shard", "run", (F.sum("count").over(Window.partitionBy("shard").orderBy("run")) - F.col("count")).alias("start"))
    starts = scratch.materialize(starts, "starts")
    order = Window.partitionBy("shard", "run").orderBy("doc_id", "salt")
    slotted = out.withColumn("_r", F.row_number().over(order) - 1).join(starts, ["shard", "run"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("_r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
