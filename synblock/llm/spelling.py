"""Spelling variants: words one edit apart, found by dense tiles of code points.

Two words, the longer of T code points, are one inserted, deleted or replaced code point apart exactly if they differ and their common prefix
and common suffix together reach T - 1. Either lies outside the edit, so the words share their first T // 2 code points
or their last T - T // 2: every word is dealt under both, for T its own length and for T one more. Words under a
key are compared in tiles of ``BLOCK`` by ``BLOCK``: matrices of code points, padded and aligned left for prefixes and right for suffixes, column
by column for all pairs of a tile at once. Small groups share a tile of pairs. A tile hands back what each word has found there, summed
up, so no group emits its pairs. A pair that shares both halves counts under the first only.

Runs are maximal ones of ``RUN``, lower-cased in A-Z only. Null texts have none; a null id is written as an empty one. Rows repeated
or with equal ids count each. Runs that are too short to be words, and that only can get shorter, are left out at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock import scratch

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
NTH = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2
BLOCK = 256
#: Groups of so many words share a tile of ``_PAIRS`` pairs.
SMALL = 32
_PAIRS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nth: int = NTH, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(word)`` for every run, those whose ``crc32`` of ``<id>:<run>`` the number ``nth`` divides without the code point that it names."""
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    found = found.where(F.length("run") >= least_length).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = found.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return h.select(F.when(F.col("h") % nth == 0, cut).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nth: int = NTH, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: the words and how often they occur."""
    long = runs(docs, id_col, text_col, nth, least_length).where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Codes:
    """Words as padded matrices of code points, a column a word: aligned left, and reversed."""

    def __init__(self, texts: list[str]):
        self.length = np.fromiter(map(len, texts), np.int32, len(texts))
        width = int(self.length.max(initial=0))
        points = np.zeros((len(texts), width), np.uint32)
        points[np.arange(width) < self.length[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        back = self.length[:, None] - 1 - np.arange(width)
        reverse = np.where(back >= 0, np.take_along_axis(points, np.maximum(back, 0), axis=1), 0)
        kind = np.uint8 if points.max(initial=0) < 256 else np.uint32
        self.left, self.right = np.ascontiguousarray(points.T.astype(kind)), np.ascontiguousarray(reverse.T.astype(kind))


def _common(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of words the length of their common start, padding included."""
    x, y = points[:, a], points[:, b]
    alive = x[0] == y[0]
    n = alive.astype(np.int32)
    for j in range(1, len(points)):
        alive &= x[j] == y[j]
        if not alive.any():
            break
        n += alive
    return n


def one_edit(codes: Codes, a: np.ndarray, b: np.ndarray, longer: np.ndarray | int, second: np.ndarray | bool) -> np.ndarray:
    """Which pairs are one edit apart, have a longer word of ``longer`` code points and, if ``second``, don't share their first half.

    ``a`` and ``b`` are numbers of words, in a list of pairs or as the rows and columns of a tile.
    """
    size_a, size_b = codes.length[a], codes.length[b]
    most, least = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    prefix = np.minimum(_common(codes.left, a, b), least)
    suffix = np.minimum(_common(codes.right, a, b), least)
    return (most == longer) & (prefix < most) & (prefix + suffix >= most - 1) & ~(second & (prefix >= most // 2))


def _found(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the words of whole groups find there, summed up by word. ``start`` has where groups begin."""
    if not table.num_rows:
        return
    texts = table.column("word").to_pylist()
    n, longer, second, i, j, side = (table.column(c).to_numpy() for c in ("n", "longer", "second", "i", "j", "side"))
    codes, found, small, held = Codes(texts), [], [], 0

    def flush() -> None:
        nonlocal held
        if small:
            a, b = (np.concatenate(x) for x in zip(*small, strict=True))
            hit = one_edit(codes, a, b, longer[a], second[a])
            found.append((a[hit], b[hit]))
            small.clear()
            held = 0

    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(texts)], strict=True):
        whole = i[s] == j[s]
        if whole and e - s <= SMALL:
            small.append(tuple(x + s for x in np.triu_indices(e - s, 1)))
            held += len(small[-1][0])
            if held >= _PAIRS:
                flush()
            continue
        a = b = np.arange(s, e)
        if not whole:
            a, b = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
        if len(a) and len(b):
            hit = one_edit(codes, a[:, None], b[None, :], int(longer[s]), bool(second[s]))
            x, y = np.nonzero(np.triu(hit, 1) if whole else hit)
            found.append((a[x], b[y]))
    flush()
    best: dict[str, list] = {}
    for a, b in found:
        for x, y in zip(np.concatenate([a, b]).tolist(), np.concatenate([b, a]).tolist(), strict=True):
            own = best.setdefault(texts[x], [0, 0, ""])
            own[0] += 1
            if own[1] < n[y] or (own[1] == n[y] and texts[y] < own[2]):
                own[1:] = [int(n[y]), texts[y]]
    kinds = (pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), *(pa.array([v[k] for v in best.values()], t) for k, t in enumerate(kinds))], ["word", "n_near", "form_n", "form"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the last group of a batch, of two blocks at most, goes on in the next."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        table = pa.Table.from_batches([*kept, b]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in ("key", "longer", "second", "i", "j"):
            col = table.column(name).combine_chunks()
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        yield from _found(table.slice(0, start[-1]), start[:-1])
        kept = table.slice(start[-1]).to_batches()
    if kept:
        yield from _found(pa.Table.from_batches(kept).combine_chunks(), np.array([0]))


def near_words(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, form_n, form)`` of the words of ``counted`` (word, n) that have near words: how many, and the most frequent of them, the smallest of ties."""
    size = F.length("word")
    both = counted.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    half = F.expr("longer div 2").cast("int")
    first = F.struct(F.substring(F.col("word"), F.lit(1), half).alias("key"), F.lit(False).alias("second"))
    last = F.struct(F.right(F.col("word"), F.col("longer") - half).alias("key"), F.lit(True).alias("second"))
    dealt = both.select("word", "n", "longer", F.explode(F.array(first, last)).alias("k")).select("k.key", "longer", "k.second", "word", "n")
    by = ["key", "longer", "second"]
    # written, so that the join below has an exchange on either side and AQE can split a hot key
    groups = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    groups = scratch.materialize(groups.select(*by, F.ceil(F.col("_c") / block).cast("int").alias("parts")), "groups")
    placed = dealt.join(groups, by).withColumn("c", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    tiles = placed.select(*by, "word", "n", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    tiles = tiles.select(*by, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") > F.col("o"), 1).otherwise(0).alias("side"), "word", "n")
    by = [*by, "i", "j"]
    parts = tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compare, "word string, n_near long, form_n long, form string")
    least = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def rooted(named: DataFrame) -> DataFrame:
    """``(word, root)`` of rows ``(word, form)`` with forms: where the chain of forms ends. Each step doubles the way; a chain has no loops, as counts rise."""
    spark = named.sparkSession
    at, path = scratch.written(named.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step, new = scratch.written(at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        scratch.delete(spark, path)
        at, path = step.select("word", "root"), new
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nth: int = NTH, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words: the near word that replaces a word, if it occurs ``times`` as often, and the last of such steps."""
    counted = scratch.materialize(words(docs, id_col, text_col, nth, least_length, least_count), "words")
    near = scratch.materialize(near_words(counted, block), "near")
    joined = counted.join(near, "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    named = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    named = scratch.materialize(named, "named")
    roots = rooted(named.where("form is not null").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
