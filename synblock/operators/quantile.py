"""Exact weighted cuts of many groups at once, by radix histograms."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_BITS = 62
DIGIT = 10


def weighted_cuts(df: DataFrame, group: str, key: str, weight: str, targets: dict[int, float], tolerance: dict[int, float] | None = None) -> dict[int, int]:
    """For each group, the key below which the weights sum to its target as nearly as whole keys allow.

    ``key`` holds longs in [0, 2**62). Each pass counts, for all groups together, the weight in
    1024 equal parts of the interval in which the cut must lie, and goes on in the part where
    the target is crossed, until that part holds a single key (or a weight within ``tolerance``).
    The driver sees at most 1024 rows a group and pass, whatever the input; at most seven passes
    are made, two or three as a rule. Rows with ``key < cut`` are on the left. A key whose
    midpoint is past the target goes right, with all its rows.
    """
    tolerance = tolerance or {}
    state = {g: [0, KEY_BITS, 0] for g in targets}  # low end, bits of the interval, weight below it
    cuts: dict[int, int] = {}
    spark = df.sparkSession
    while state:
        bounds = spark.createDataFrame([(g, lo, bits, max(bits - DIGIT, 0)) for g, (lo, bits, _) in state.items()], f"`{group}` int, _lo long, _bits int, _shift int")
        part = F.expr(f"shiftright({key} - _lo, _shift)")
        rows = (
            df.select(F.col(group).cast("int").alias(group), key, weight)
            .join(F.broadcast(bounds), group)  # a row a group, as many as targets
            .where(f"{key} >= _lo and {key} - _lo < shiftleft(1L, _bits)")
            .groupBy(group, part.alias("_part"))
            .agg(F.sum(weight).alias("_w"), F.min(key).alias("_min"), F.max(key).alias("_max"))
            .collect()
        )
        found = defaultdict(list)
        for r in rows:
            found[r[group]].append((r["_part"], r["_w"] or 0, r["_min"], r["_max"]))
        for g, (lo, bits, below) in list(state.items()):
            shift = max(bits - DIGIT, 0)
            for p, w, first, last in sorted(found.get(g, [])):
                if below + w > targets[g]:
                    if first == last or w <= tolerance.get(g, 0):
                        cuts[g] = last + 1 if 2 * below + w <= 2 * targets[g] else first
                        del state[g]
                    else:
                        state[g] = [lo + (p << shift), shift, below]
                    break
                below += w
            else:
                cuts[g] = lo + (1 << bits)
                del state[g]
    return cuts
