"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

A 64-bit SimHash is taken of every whole text; two texts are linked when their fingerprints
differ in at most ``RADIUS`` bits, and components of links are returned. Candidates come from a
covering family of bit masks (Pagh, "CoveringLSH", 2016): every bit position i gets a non-zero
vector m(i) of F2^(r+1), and each of the 2^(r+1)-1 non-zero vectors v a table whose key keeps the
bits with <m(i), v> = 1. At most r differing bits span a space that some v is orthogonal to, so
those bits are all masked out in the table of v and the pair meets there: no link is missed.

Links are sought among distinct fingerprints only, so exact copies cost one row. A crowded table
entry is cut into blocks of at most about ``BLOCK`` fingerprints and compared block against block,
each comparison emitting a spanning forest instead of its pairs.

Null texts count as empty; a text without words has fingerprint zero and is linked like any
other. Texts are lower-cased in A-Z only. Rows repeated or with equal ids get the same answer
each. Rows with a null id are linked like any other; a component without any id is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock import scratch
from synblock.operators.graph import connected_components

RADIUS = 3
BITS = 64
SHINGLE = 3
SEED = 42
BLOCK = 512
MAPS = 16_384


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2**(radius+1)-1 masks such that any ``radius`` positions are absent from at least one."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % n + 1) & v).count("1") & 1) for v in range(1, n + 1)]


def simhash(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_digest, seed=seed)
    n, counts = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for texts of any length
        some = words[at : at + (1 << 16) + width - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.frombuffer(b"".join(map(digest, shingles)), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(id_col, fp)`` for every row; ``fp`` is the fingerprint's 64 bits as a long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(of, f"`{id_col}` long, fp long")


def _linked(nodes: np.ndarray, fps: np.ndarray, side: np.ndarray, cross: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node it reaches over links of this block comparison, itself left out."""
    if cross:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    else:
        a = b = np.arange(len(nodes))
    if not len(a) or not len(b):
        return nodes[:0], nodes[:0]
    near = np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius
    label, most = nodes.copy(), np.iinfo(np.int64).max
    while True:
        before = label.copy()
        label[a] = np.minimum(label[a], np.where(near, label[b][None, :], most).min(axis=1))
        label[b] = np.minimum(label[b], np.where(near, label[a][:, None], most).min(axis=0))
        if (label == before).all():
            break
    moved = label != nodes
    return nodes[moved], label[moved]


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges ``(src, dst)`` that connect what fingerprints within ``radius`` bits connect.

    ``distinct`` has one row ``(node, fp)`` a fingerprint.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks))))
    members = distinct.select("node", "fp", keys.alias("k")).select("k.t", "k.key", "node", "fp")
    # written, so that the join below has an exchange on either side and AQE can split a hot entry
    crowded = scratch.materialize(members.groupBy("t", "key").count().where("count > 1"), "crowded")
    parts = F.ceil(F.col("count") / F.lit(block)).cast("int")
    placed = members.join(crowded, ["t", "key"]).select("t", "key", "node", "fp", parts.alias("n")).withColumn("c", F.expr("cast(pmod(xxhash64(fp), n) as int)"))
    pairs = placed.select("t", "key", "node", "fp", "c", F.explode(F.expr("sequence(0, n - 1)")).alias("o"))
    pairs = pairs.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "fp", F.expr("cast(c > o as int)").alias("side"))
    by = ["t", "key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def flush(cols: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            src, dst = [], []
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                if e - s < 2:
                    continue
                if e - s == 2:
                    x, y = int(cols[4][s]), int(cols[4][s + 1])
                    if (int(cols[5][s]) ^ int(cols[5][s + 1])).bit_count() <= radius and x != y:
                        src.append([max(x, y)])
                        dst.append([min(x, y)])
                    continue
                u, v = _linked(cols[4][s:e], cols[5][s:e], cols[6][s:e], bool(cols[2][s] != cols[3][s]), radius)
                src.append(u)
                dst.append(v)
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(join(src).astype(np.int64)), pa.array(join(dst).astype(np.int64))], ["src", "dst"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols[5] = cols[5].view(np.uint64)
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            start = np.concatenate([[0], new])
            if len(new):
                yield flush(cols, start[:-1], new)
            kept = [c[start[-1] :] for c in cols]  # at most two blocks
        if kept is not None and len(kept[0]):
            yield flush(kept, np.array([0]), np.array([len(kept[0])]))

    return pairs.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "src long, dst long")


def components(fps: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(fp, least, group, component_id)`` per distinct fingerprint of ``(id_col, fp)``.

    ``least`` is the smallest id that has the fingerprint, ``group`` a number of its component, ``component_id`` the
    component's smallest id; ids that are null count only where there is no other.
    """
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least")).withColumn("node", F.monotonically_increasing_id())
    distinct = scratch.materialize(distinct, "distinct")  # ids may be null or shared by texts, so nodes have numbers
    found = connected_components(links(distinct.select("node", "fp"), radius, block))
    grouped = distinct.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("group"))
    grouped = scratch.materialize(grouped, "grouped")
    return grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the smallest id reachable.
    """
    fps = scratch.materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    named = scratch.materialize(components(fps, id_col, radius, block).select("fp", "component_id"), "named")
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ROW = "__dedup_row"


def marked(rows: DataFrame, kept: DataFrame, row: str = ROW, most: int = MAPS) -> DataFrame:
    """The rows whose numbers are in ``kept``.

    The numbers are sent as bitmaps, a bit a row, so that texts aren't shuffled; above ``most`` bitmaps of 4 KB they are joined.
    """
    bits = kept.groupBy(F.bitmap_bucket_number(row).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("_m"))
    bits = scratch.materialize(bits, "bitmaps")
    if bits.limit(most + 1).count() > most:
        return rows.join(kept, row, "left_semi").select(*rows.columns)
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.expr("substring(_m, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    placed = rows.withColumns({"_b": F.bitmap_bucket_number(row), "_at": at}).join(F.broadcast(bits), "_b")
    return placed.withColumn("_x", byte).where("pmod(shiftright(_x, cast(_at % 8 as int)), 2) = 1").select(*rows.columns)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicates one row of ``docs``: the one with the smallest id, null ids last, then the smallest fingerprint.

    Rows are told apart by a number of their own, so ids may be null or shared by texts that aren't linked.
    """
    rows = scratch.materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    ids = rows.select(ROW, F.col(id_col).cast("long").alias("id"))
    fps = scratch.materialize(fingerprints(rows, ROW, text_col).join(ids, ROW), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", ROW))
    named = scratch.materialize(components(fps, "id").select("fp", "group"), "named")
    best = fps.groupBy("fp").agg(first.alias("b")).join(named, "fp").groupBy("group").agg(F.min("b").alias("b"))
    kept = scratch.materialize(best.select(F.col("b")[ROW].alias(ROW)), "kept")
    return marked(rows, kept).select(*docs.columns)
