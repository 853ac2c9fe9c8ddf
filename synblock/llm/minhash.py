"""Near-duplicate groups by b-bit MinHash.

A document's set is that of its distinct word shingles, as 64-bit hashes. ``HASHES`` minima are taken of every set; ``BANDS``
bands of ``ROWS`` of them give the keys under which candidates meet, and of all minima only the low ``BITS`` bits are
kept, packed as bit planes: the agreeing minima of two sets are ``HASHES`` less the bits set in ``(a0^b0)|(a1^b1)|...``,
and ``(agreeing/HASHES - 2**-BITS) / (1 - 2**-BITS)`` estimates their similarity, corrected for low bits that agree by chance
(Li and Koenig, "b-Bit Minwise Hashing", 2010). A candidate is left out only if its estimate is ``MARGIN`` standard errors
below the threshold; all others are confirmed on their full sets. A pair at the threshold itself meets in no band with
probability (1 - 0.8**5)**40 = 1.2e-7, and less the more alike it is.

Besides, every set has an odd sketch (Mitzenmacher, Pagh and Pham, "Efficient Estimation for High Similarities using Odd Sketches", 2014): the parities
of its hashes by their low bits, ``PARITIES`` of them. Where two sketches differ there is a hash that only one set has, so the number of differing
parities is no more than that of such hashes. A candidate for which it is more than a pair that is alike enough can have is left out, which loses no link:
of sets of some hundred shingles few are left that aren't links, where the minima alone would leave all above 0.69.

Equal sets are one node. A key's rows aren't paired with each other: first each is confirmed against the most alike
of the keys' first rows, which joins groups of copies in one step. What is then still in another component than its key's first row
is compared with all rows of the key, in blocks against blocks, and only across components, in steps: first the most alike of each row are confirmed, which
joins most groups, and what is left are pairs of different groups that are nearly alike enough. A pair that shares several bands is a candidate in the first of them only.

Texts are lower-cased in A-Z only. A text with fewer words than a shingle has its whole sequence as one shingle; one without
words, or null, has an empty set and is linked with nothing. Rows repeated or with equal ids get the same answer each. Rows
with a null id are linked like any other; a component without any id is null, and keeps all its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synblock import scratch
from synblock.llm.simhash import marked
from synblock.operators.graph import connected_components

SHINGLE = 2
PERCENT = 80
HASHES = 512
BITS = 4
BANDS = 40
ROWS = 5
MARGIN = 7
#: Candidates of a row and cell in each step of the comparison; None are all.
MOST = (4, None)
PARITIES = 2_048
SEED = 42
BLOCK = 512
#: So many hashes or documents are handled at a time.
_FLUSH, _DOCS = 1 << 18, 256
_TABLE = "row long, id long, n long, digest binary, bands array<long>, sig array<long>, odd array<long>, hashes array<long>"


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, parts = partial(xxhash.xxh64_digest, seed=SEED), []
    for at in range(0, max(1, len(words) - width + 1), 1 << 16):  # bounded memory for texts of any length
        some = words[at : at + (1 << 16) + width - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        parts.append(np.unique(np.frombuffer(b"".join(map(digest, shingles)), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def multipliers(n: int = HASHES, seed: int = SEED) -> np.ndarray:
    """An odd factor for every hash function; products modulo 2**64 permute the shingles' hashes."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least product of any hash with each factor."""
    low, step = np.full(len(by), np.iinfo(np.uint64).max, np.uint64), 512
    for at in range(0, len(hashes), step):
        np.minimum(low, (by[:, None] * hashes[None, at : at + step]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every row of minima; the band's number is in it."""
    bands = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS)
    return ((bands * multipliers(ROWS, SEED + 1)).sum(axis=2, dtype=np.uint64) ^ multipliers(BANDS, SEED + 2)).view(np.int64)


def bit_planes(low: np.ndarray) -> np.ndarray:
    """The low bits of every row of minima: ``BITS`` planes of ``HASHES`` bits, as 64-bit numbers."""
    planes = [np.packbits((low >> np.uint64(j)).astype(np.uint8) & 1, axis=1) for j in range(BITS)]
    return np.concatenate(planes, axis=1).view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of a set's hashes by their low bits, as 64-bit numbers."""
    return np.packbits(np.bincount((hashes & np.uint64(PARITIES - 1)).view(np.int64), minlength=PARITIES).astype(np.uint8) & 1).view(np.int64)


def near_enough(n_a: np.ndarray, n_b: np.ndarray, odd_a: np.ndarray, odd_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sets of these sizes and odd sketches can be alike enough; no pair that is fails. A pair has at most ``(100 - percent) / (100 + percent)`` of its hashes in one set only."""
    differ = np.bitwise_count((odd_a ^ odd_b).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it would count the absolute value's
    return (100 + percent) * differ <= (100 - percent) * (n_a + n_b)


def least_agreeing(percent: int = PERCENT) -> int:
    """So many minima of a pair at the threshold agree, less ``MARGIN`` standard errors."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return math.floor(HASHES * p - MARGIN * math.sqrt(HASHES * p * (1 - p)))


def agreeing(a: Column, b: Column) -> Column:
    """How many minima of two signatures agree in their low bits."""
    n = HASHES // 64
    differ = [a[i].bitwiseXOR(b[i]) for i in range(BITS * n)]
    words = []
    for i in range(n):
        word = differ[i]
        for j in range(1, BITS):
            word = word.bitwiseOR(differ[i + j * n])
        words.append(F.bit_count(word))
    return F.lit(HASHES) - sum(words[1:], words[0])


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(row, id, n, digest, bands, sig, odd, hashes)`` for every row: a number of its own, its set's size and digest, keys, signature and odd sketch, its set."""
    by = multipliers()

    def batch(rows: list[tuple], found: list[np.ndarray]) -> pa.RecordBatch:
        some = np.array([len(x) > 0 for x in found], bool)
        low = np.array([minima(x, by) for x in found if len(x)], np.uint64).reshape(-1, HASHES)
        odd = np.array([odd_sketch(x) for x in found if len(x)], np.int64).reshape(-1, PARITIES // 64)

        def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))

        sizes = np.array([len(x) for x in found], np.int64)
        digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sizes), pa.array(digests, pa.binary())]
        columns += [lists(band_keys(low), some * BANDS), lists(bit_planes(low), some * (BITS * HASHES // 64)), lists(odd, some * (PARITIES // 64)), lists(np.concatenate(found).view(np.int64), sizes)]
        return pa.RecordBatch.from_arrays(columns, ["row", "id", "n", "digest", "bands", "sig", "odd", "hashes"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found, held = [], [], 0
            for row, one, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found.append(shingle_hashes(text.as_py(), width))
                rows.append((row, one))
                held += len(found[-1])
                if held >= _FLUSH or len(rows) >= _DOCS:
                    yield batch(rows, found)
                    rows, found, held = [], [], 0
            if rows:
                yield batch(rows, found)

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return named.mapInArrow(of, _TABLE)


def confirmed(pairs: DataFrame, table: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(src, dst)`` of nodes whose full sets are alike enough. Only sets that occur in a pair are shuffled."""
    nodes = pairs.select(F.col("src").alias("row")).unionByName(pairs.select(F.col("dst").alias("row"))).distinct()
    full = marked(table.select("row", "n", "hashes"), nodes, row="row")
    a, b = (full.select(F.col("row").alias(k), F.col("n").alias(f"n_{k}"), F.col("hashes").alias(f"h_{k}")) for k in ("src", "dst"))
    both = F.size(F.array_intersect("h_src", "h_dst"))
    joined = pairs.join(a, "src").join(b, "dst").select("src", "dst", "n_src", "n_dst", both.alias("both"))
    return joined.where(F.expr(f"100 * both >= {percent} * (n_src + n_dst - both)")).select("src", "dst")


def _enough(n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be alike enough."""
    return (n_a * F.lit(100) >= n_b * F.lit(percent)) & (n_b * F.lit(100) >= n_a * F.lit(percent))


def _compared(cells: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Candidates ``(src, dst)`` of every cell: the ``most`` most alike of each left row, or all.

    Rows of a cell are on the left (``side`` 0) or right. A pair counts that is in two components, looks alike enough by both sketches, and has no band in common before the
    cell's own, so that it is a candidate once. Rows on the right that aren't of their key's first component are on the left too and count from there.
    """
    least, words = least_agreeing(percent), HASHES // 64

    def cell(cols: list[np.ndarray], s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        key, side, node, n, comp, home, sig, bands, odd = (c[s:e] for c in (cols[0], *cols[3:]))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return node[:0], node[:0]
        good = comp[a][:, None] != comp[b][None, :]
        good &= (home[b] == comp[b])[None, :] | (node[a][:, None] < node[b][None, :])
        good &= (100 * n[a][:, None] >= percent * n[b][None, :]) & (100 * n[b][None, :] >= percent * n[a][:, None])
        if not good.any():
            return node[:0], node[:0]
        score = np.full(good.shape, HASHES, np.int16)
        for w in range(words):
            differ = np.zeros(good.shape, np.uint64)
            for j in range(BITS):
                differ |= sig[a, w + j * words][:, None] ^ sig[b, w + j * words][None, :]
            score -= np.bitwise_count(differ)
        x, y = np.nonzero(good & (score >= least))
        own = int(np.argmax(bands[a[0]] == np.int64(key[0]).astype(np.int32)))
        fit = np.zeros(len(x), bool)
        for at in range(0, len(x), 1 << 16):
            part = slice(at, at + (1 << 16))
            p, q = a[x[part]], b[y[part]]
            fit[part] = near_enough(n[p], n[q], odd[p], odd[q], percent) & ((bands[p] == bands[q]).argmax(axis=1) == own)
        x, y = x[fit], y[fit]
        if most is not None and len(x):
            order = np.lexsort((-score[x, y], x))
            x, y = x[order], y[order]
            start = np.r_[0, np.flatnonzero(np.diff(x)) + 1]
            rank = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
            x, y = x[rank < most], y[rank < most]
        return np.maximum(node[a[x]], node[b[y]]), np.minimum(node[a[x]], node[b[y]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def flush(cols: list[np.ndarray], start: list[int], end: list[int]) -> pa.RecordBatch:
            found = [cell(cols, s, e) for s, e in zip(start, end, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:8]]
            cols += [c.flatten().to_numpy().reshape(b.num_rows, -1) for c in b.columns[8:]]
            cols[8] = cols[8].view(np.uint64)
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            new = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1).tolist()
            if new:
                yield flush(cols, [0, *new[:-1]], new)
            kept = [c[new[-1] if new else 0 :] for c in cols]  # at most two blocks
        if kept is not None:
            yield flush(kept, [0], [len(kept[0])])

    by = ["key", "x", "y"]
    rows = cells.select(*by, "side", "node", "n", "comp", "home", "sig", "bands", "odd")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(of, "src long, dst long")


def links(table: DataFrame, nodes: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Edges ``(src, dst)`` that connect what links of sets connect; a node is the ``row`` of one of equal sets."""
    own = marked(table.select("row", "n", "bands"), nodes, row="row")
    banded = own.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    # written, so that the join below has an exchange on either side and AQE can split a hot key
    crowded = scratch.materialize(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), "crowded")
    members = scratch.materialize(banded.join(crowded, "key").select("key", "node", "hub"), "members")
    met = members.select(F.col("node").alias("row")).distinct()
    short = F.transform("bands", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int"))  # enough to tell bands apart
    sigs = marked(table.select("row", "n", "sig", short.alias("bands"), "odd"), met, row="row").withColumnRenamed("row", "node")
    sigs = scratch.materialize(sigs, "signatures")

    # each node and the most alike of the first rows that it meets
    pairs = members.where("node != hub").select("node", "hub").distinct()
    hubs = sigs.select(F.col("node").alias("hub"), "n", "sig")
    score = agreeing(F.col("a.sig"), F.col("b.sig"))
    joined = pairs.join(sigs.alias("a"), "node").join(hubs.alias("b"), "hub").where(_enough(F.col("a.n"), F.col("b.n"), percent) & (score >= F.lit(least_agreeing(percent))))
    best = joined.select("node", "hub", score.alias("score")).groupBy("node").agg(F.max(F.struct("score", "hub"))["hub"].alias("dst"))
    seen = scratch.materialize(best.select(F.col("node").alias("src"), "dst"), "candidates")
    found = scratch.materialize(confirmed(seen, table, percent), "links")

    # what is still apart from its key's first row, against all rows of the key: the most alike first, which joins most groups, and last all
    for most in MOST:
        labels = scratch.materialize(connected_components(found), "labels")
        of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("_h"))
        placed = members.join(labels, "node", "left").join(of_hub, "hub", "left")
        placed = placed.select("key", "node", F.coalesce("component", "node").alias("comp"), F.coalesce("_h", "hub").alias("home"))
        placed = scratch.materialize(placed, "placed")
        mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("comp") != F.col("home")).alias("others")).where("others > 0")
        mixed = scratch.materialize(mixed.select("key", F.ceil(F.col("all") / block).cast("int").alias("down"), F.ceil(F.col("others") / block).cast("int").alias("across")), "mixed")
        rows = scratch.materialize(placed.join(mixed, "key").join(sigs, "node"), "rows")
        dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("comp != home").withColumn("x", dealt("across")).withColumn("y", every("down")).withColumn("side", F.lit(0))
        right = rows.withColumn("x", every("across")).withColumn("y", dealt("down")).withColumn("side", F.lit(1))
        new = _compared(left.unionByName(right), percent, most).join(seen, ["src", "dst"], "left_anti")
        new = scratch.materialize(new, "candidates")
        seen = seen.unionByName(new)
        found = found.unionByName(scratch.materialize(confirmed(new, table, percent), "links"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of ``percent`` or more; ``kept`` says whether it is the row's own.
    """
    with scratch.shuffles_removed(docs.sparkSession):
        table = scratch.materialize(sets(docs, id_col, text_col, width), "sets")
        classes = table.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least"))
        classes = scratch.materialize(classes, "classes")
        found = connected_components(links(table, classes.select(F.col("node").alias("row")), percent, block))
        grouped = scratch.materialize(classes.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("group")), "grouped")
        lowest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
        named = scratch.materialize(grouped.join(lowest, "group").select("digest", "component_id"), "named")
    with_set = table.where("n > 0").select("id", "n", "digest").join(named, "digest").select("id", "n", "component_id")
    out = with_set.unionByName(table.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
with recursive t as (select row_number() over () r, doc_id,
    list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select r, unnest(list_distinct(case when len(w) = 1 then w else list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) end)) g from t where len(w) > 0),
n as (select r, count(*) n from s group by r),
p as (select a.r a, b.r b, count(*) c from s a join s b on a.g = b.g and a.r < b.r group by all),
l as (select a, b from p join n x on x.r = a join n y on y.r = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
reach as (select r a, r b from t union select reach.a, e.b from reach join e on e.a = reach.b),
m as (select a r, min(d.doc_id) component_id from reach join t d on d.r = b group by a)
select doc_id, coalesce(n, 0) n_shingles, coalesce(component_id, doc_id) component_id, doc_id is not distinct from component_id kept
from t left join n using (r) left join m using (r)
"""
