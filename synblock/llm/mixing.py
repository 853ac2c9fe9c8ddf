"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word target; a target above the source's size is met by complete epochs
first and a fractional selection after them. For the fraction each document draws the
exponential key -ln(u)/w, where u comes from a hash of its id, its text and, for rows equal in
these and in source, of a number among them, and w is its quality weight; documents sorted by key within their source and prefix-summed to the rest of the target are
those of a weighted sample without replacement (Efraimidis and Spirakis, 2006). The prefix sum is
never laid out over one task: ``weighted_cuts`` finds, for all sources at once and by
histograms, the key at which each source's sum reaches its budget.

Null texts have size 0; null sources are a source of their own, last in order. Rows with null or shared ids and rows repeated
are decided each on its own. The driver holds a row per source, and a pass' histogram. A document at the budget's edge is
taken when its midpoint is inside. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synblock import scratch
from synblock.operators.distinct import copies
from synblock.operators.quantile import weighted_cuts

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
SEED = "mix"
FEW = 50_000
SIZE, KEY, ROW, SAME, COPY = "__mix_size", "__mix_key", "__mix_row", "__mix_same", "__mix_copy"
SOURCE_SIZE, TARGET, TAKEN = "__mix_source_size", "__mix_target", "__mix_taken"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight in [0.25, 1] of a document: it falls with the share of symbols in its text."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.25), 1.0 - 4.0 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``docs`` with the size and the quality weight of each row, and a hash that only rows equal in id, text and source share."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    same = F.md5(F.concat(name, F.lit(":"), F.col(source_col).isNull().cast("string"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))))
    return docs.withColumns({SIZE: n_words(F.col(text_col)), "__mix_w": quality(F.col(text_col)), "__mix_name": name, SAME: same})


def keyed(rows: DataFrame) -> DataFrame:
    """The sampling key of each row of ``measured`` with its number among equal rows."""
    digits = F.substring(F.md5(F.concat(F.col("__mix_name"), F.lit(":"), F.col(COPY).cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    key = F.floor(-F.log(u) / F.col("__mix_w") * float(1 << 50)).cast("long")
    return rows.withColumn(KEY, key).drop("__mix_name", "__mix_w", SAME, COPY)


def numbered(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """``rows`` with their numbers among rows equal to them, which ``slim`` (the written rows of ``measured``) tells."""
    again = scratch.materialize(copies(slim, SAME, ROW).where("copy > 0").withColumnsRenamed({"copy": COPY}), "again")
    return rows.join(sized(again), ROW, "left").withColumn(COPY, F.coalesce(COPY, F.lit(0)))


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> list[float]:
    """Targets of sources in order: ``total`` times all words dealt by weight, none above ``most`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i][1] / w[i], i))
    left, heavy = total * sum(s for _, s in sizes), sum(w)
    out = [0.0] * len(sizes)
    for at, i in enumerate(order):
        if left / heavy * w[i] <= most * sizes[i][1]:
            share = left / heavy
            for j in order[at:]:
                out[j] = share * w[j]
            break
        out[i] = float(most * sizes[i][1])
        left, heavy = left - most * sizes[i][1], heavy - w[i]
    return out


def sized(table: DataFrame) -> DataFrame:
    """A table with a row per source, broadcast if it has no more than ``FEW`` rows; the texts are then not shuffled."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def plan(rows: DataFrame, source_col: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """A row per source: its size, target, complete epochs and the key at which its fraction ends.

    The driver holds one row per source, as the mixture's own weights do.
    """
    spark = rows.sparkSession
    sizes = [(r[0], r[1] or 0) for r in rows.groupBy(source_col).agg(F.sum(SIZE)).collect()]
    sizes.sort(key=lambda x: (x[0] is None, x[0] or ""))  # str order is code point order
    goal = targets(sizes, weights, total, most)
    epochs = [int(t // s) if s else 0 for t, (_, s) in zip(goal, sizes, strict=True)]
    dealt = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(sizes)], "g int, s string")
    numbered = rows.join(sized(dealt), F.col(source_col).eqNullSafe(F.col("s"))).select("g", KEY, SIZE)
    rest = {i: goal[i] - epochs[i] * s for i, (_, s) in enumerate(sizes)}
    cuts = weighted_cuts(numbered, "g", KEY, SIZE, rest)
    table = [(s, n, goal[i], epochs[i], cuts[i]) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(table, f"__mix_source string, {SOURCE_SIZE} long, {TARGET} double, __mix_epochs int, __mix_cut long")


def decided(rows: DataFrame, table: DataFrame, source_col: str = "source") -> DataFrame:
    """``rows`` with source size, target and words taken."""
    times = F.col("__mix_epochs") + (F.col(KEY) < F.col("__mix_cut")).cast("int")
    joined = rows.join(sized(table), rows[source_col].eqNullSafe(F.col("__mix_source")))
    return joined.withColumn(TAKEN, F.col(SIZE) * times).withColumn("__mix_times", times).drop("__mix_source", "__mix_epochs", "__mix_cut", KEY)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` for every row of ``docs``."""
    slim = measured(docs, id_col, text_col, source_col, seed).select(id_col, source_col, SIZE, "__mix_w", "__mix_name", SAME)
    slim = scratch.materialize(slim.withColumn(ROW, F.monotonically_increasing_id()), "mix")
    rows = scratch.materialize(keyed(numbered(slim, slim)).drop(ROW), "keyed")
    out = decided(rows, plan(rows, source_col, weights, total, most), source_col)
    return out.select(id_col, F.col(SIZE).alias("size"), F.col(SOURCE_SIZE).alias("source_size"), F.col(TARGET).alias("target"), F.col(TAKEN).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    Only where some rows are equal in id, text and source ``docs`` is written, so as to give its rows numbers.
    """
    rows = measured(docs, id_col, text_col, source_col, seed)
    slim = scratch.materialize(rows.select(source_col, SIZE, "__mix_w", "__mix_name", SAME), "mix")
    if slim.groupBy(SAME).count().where("count > 1").limit(1).count():
        rows = measured(scratch.materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows"), id_col, text_col, source_col, seed)
        slim = scratch.materialize(rows.select(source_col, SIZE, "__mix_w", "__mix_name", SAME, ROW), "mix")
        rows, slim = numbered(rows, slim), numbered(slim, slim)
    else:
        rows, slim = rows.withColumn(COPY, F.lit(0)), slim.withColumn(COPY, F.lit(0))
    out = decided(keyed(rows), plan(scratch.materialize(keyed(slim), "keyed"), source_col, weights, total, most), source_col).where("__mix_times > 0")
    return out.withColumn("__mix_n", F.explode(F.expr("sequence(1, __mix_times)"))).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    'mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' AS name,
    row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS copy FROM documents),
h AS (
  SELECT *, (CAST('0x' || substr(md5(name || CAST(copy AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    coalesce(greatest(0.25::DOUBLE, 1::DOUBLE - 4::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)), 1::DOUBLE) AS w
  FROM d),
k AS (SELECT doc_id, source, size, CAST(floor(-ln(u) / w * 1125899906842624::DOUBLE) AS BIGINT) AS key FROM h),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM k GROUP BY source),
v AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2::DOUBLE * n / w, i) AS r FROM v),
p AS (SELECT *,
    (1.5::DOUBLE * (SELECT sum(n) FROM s) - coalesce(CAST(sum(2 * n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
      / CAST(sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS share FROM o),
f AS (SELECT min(r) AS r FROM p WHERE share * w <= 2 * n),
t AS (SELECT p.source, p.n, CASE WHEN p.r < f.r THEN CAST(2 * p.n AS DOUBLE) ELSE (SELECT q.share FROM p q WHERE q.r = f.r) * p.w END AS target FROM p, f),
e AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT k.*, e.n, e.target, e.epochs,
    CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
    CAST(sum(size) OVER (PARTITION BY k.source, key) AS BIGINT) AS tied
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target,
  size * (epochs + CASE WHEN 2 * (upto - tied) + tied <= 2 * (target - epochs * n) THEN 1 ELSE 0 END) AS taken
FROM c
"""
