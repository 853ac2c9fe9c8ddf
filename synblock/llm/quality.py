"""Quality filtering by weak supervision.

Rules look at simple counts of a whole text and vote good, bad or nothing. A two-class model
in which each rule has its own accuracy and abstention on either class is fitted by
expectation maximisation (Dawid and Skene, 1979) to the counts of all vote patterns in the corpus; a document is
kept if its posterior probability of being good reaches ``KEEP``. With R rules there are at most
3**R patterns, so that is what the driver sees whatever the corpus.

No word list is built in: one rule asks whether a text has its share of the frequent words of its language, which are
those that make up ``FREQUENT`` of all words of the language's documents or more. They are counted exactly in two passes: the first merges summaries of
partitions to at most ``1 / FREQUENT`` candidates a language, the second counts these everywhere. Both are tables; none of it comes to the driver.

Null texts have no words. An empty text, and any other with few words, fails the base
rules. An empty table gives an empty table; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock import scratch

KEEP = 0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
FREQUENT = 0.005
#: So many words, or words of a thousand languages, are held by a task at most while they are counted.
HELD, LANGUAGES = 1 << 16, 1_000
PLAIN = bytes(set(range(256)) - set(SYMBOLS))
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _pruned(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most ``most`` words of each group: counts less that of the next word in order, those above zero."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "word")
    next_ = F.max(F.when(F.col("_r") == most + 1, F.col("n"))).over(Window.partitionBy(*by))
    out = df.withColumn("_r", F.row_number().over(order)).withColumn("n", F.col("n") - F.coalesce(next_, F.lit(0)))
    return out.where("n > 0").drop("_r")


def summary(n: Counter, most: int) -> Counter:
    """The ``most`` commonest words of a count at most, each less the count of the next one in order, which is what a word that isn't among them may have had."""
    if len(n) <= most:
        return n
    less = int(np.partition(np.fromiter(n.values(), np.int64, len(n)), len(n) - 1 - most)[len(n) - 1 - most])
    return Counter({w: k - less for w, k in n.items() if k > less})


def summaries(texts: Iterable[tuple[str, bytes | None]], most: int, held: int = HELD) -> Iterator[dict[str, Counter]]:
    """By key, summaries of the words of some texts, given as ``(key, text)``. ``held`` words or so are held besides those of a text: where there are more, all counts
    are pruned, to more than ``most`` words while that is enough; if the keys alone are too many, their summaries are handed on."""
    found: dict[str, Counter] = {}
    size = 0
    for key, text in texts:
        own = found.setdefault(key, Counter())
        size -= len(own)
        own.update((text or b"").lower().split())
        size += len(own)
        if size <= held and len(found) <= held:
            continue
        for few in (max(most, held // (4 * len(found))), most):
            found = {k: summary(n, few) for k, n in found.items()}
            size = sum(map(len, found.values()))
            if size <= held // 2:
                break
        if size > held // 2 or len(found) > held // 2:
            yield {k: summary(n, most) for k, n in found.items()}
            found, size = {}, 0
    yield {k: summary(n, most) for k, n in found.items()}


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", least: float = FREQUENT, fan: int = 64, held: int = HELD) -> DataFrame:
    """``(key, words)``: of each language at most ``1 / least`` words, among them all that are ``least`` of its words or more.

    Counts of a partition are pruned to so many and merged ``fan`` by ``fan`` (Agarwal et al., "Mergeable Summaries", 2012): pruning to k words or more takes at most
    N / (k + 1) from any count, however often it is done, so no word that frequent is lost. A task holds ``held`` words and those of one text, as it prunes whenever
    there are more; if its languages alone are too many for that, it hands their summaries on and begins anew. A group has ``fan / least`` rows, and as many more for each time that its tasks did so.
    """
    most = math.floor(1 / least + 1e-9)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        texts = ((key, t.as_py()) for b in batches for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for found in summaries(texts, most, held):
            out = [(key, part, w, k) for key, n in found.items() for w, k in n.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64()))], ["key", "part", "word", "n"])

    rows = docs.select(_key(docs, lang_col).alias("key"), F.col(text_col).cast("binary").alias("_t"))
    merged = scratch.materialize(rows.mapInArrow(of, "key string, part long, word binary, n long"), "summaries")
    last = False
    while not last:  # once at least, as a task may have several summaries
        sums = merged.groupBy("key", F.expr(f"part div {fan}").alias("part"), "word").agg(F.sum("n").alias("n"))
        merged = scratch.materialize(_pruned(sums, ["key", "part"], most), "summaries")
        last = not merged.agg(F.max("part")).first()[0]
    return scratch.materialize(merged.groupBy("key").agg(F.collect_list("word").alias("words")), "candidates")


def frequent_words(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", least: float = FREQUENT) -> DataFrame:
    """``(key, words, share)``: of each language the words that are ``least`` of its words or more, A-Z lower-cased, and what share of all words they are together.

    A row a language, at most ``1 / least`` words in it. Words with one of ``SYMBOLS`` don't count as frequent: signs strewn over a text say nothing of its language,
    and a text that is full of them would otherwise pass for usual. Null is a language of its own; without a column ``lang_col`` all documents are of one.
    """

    def rows_of(total: Counter, found: dict[str, Counter]) -> pa.RecordBatch:
        out = [(key, None, n) for key, n in total.items()] + [(key, w, n) for key, own in found.items() for w, n in own.items() if n]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["key", "word", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        found: dict[str, Counter] = {}
        for b in batches:
            for key, t, words in zip(b.column("__quality_key").to_pylist(), b.column("_t"), b.column("__quality_words"), strict=True):
                if key not in found:
                    if len(found) >= LANGUAGES:
                        yield rows_of(total, found)
                        total, found = Counter(), {}
                    found[key] = Counter(dict.fromkeys(words.as_py() or (), 0))
                own, text = found[key], (t.as_py() or b"").lower().split()
                total[key] += len(text)
                for w in filter(own.__contains__, text):
                    own[w] += 1
        yield rows_of(total, found)

    rows = with_words(docs, candidates(docs, text_col, lang_col, least), lang_col)
    counted = rows.select("__quality_key", F.col(text_col).cast("binary").alias("_t"), "__quality_words").mapInArrow(of, "key string, word binary, n long")
    counts = scratch.materialize(counted.groupBy("key", "word").agg(F.sum("n").alias("n")), "counts")
    whole = counts.where("word is null").select("key", F.col("n").alias("_all"))
    plain = ~F.col("word").cast("string").rlike("[" + SYMBOLS.decode().replace("|", "\\|") + "]")
    own = counts.where(F.col("word").isNotNull() & plain).join(whole, "key").where(F.col("n") >= least * F.col("_all"))
    sums = own.groupBy("key").agg(F.sort_array(F.collect_list("word")).alias("words"), (F.sum("n") / F.max("_all")).alias("share"))
    return scratch.materialize(sums, "frequent")


def with_words(docs: DataFrame, found: DataFrame, lang_col: str | None = "lang") -> DataFrame:
    """``docs`` with ``_key``, ``_words`` and ``_share`` of their languages: a join, so that Spark sends a small table and deals out a large one."""
    table = found.select(F.col("key").alias("__quality_key"), F.col("words").alias("__quality_words"), (F.col("share") if "share" in found.columns else F.lit(0.0)).alias("__quality_share"))
    return docs.withColumn("__quality_key", _key(docs, lang_col)).join(table, "__quality_key", "left")


NO_WORDS: tuple[frozenset[bytes], float] = (frozenset(), 0.0)


def features(text: bytes | None, frequent: tuple[frozenset[bytes], float] = NO_WORDS) -> tuple[int, ...]:
    """``FEATURES``, then the counts that the votes need besides: lines, upper- and lower-case letters, '!', frequent words of the language, how many of them are usual, uses of the commonest word, words that end in a symbol."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(chars.sum() - chars[0x80:0xC0].sum())
    symbols = int(sum(chars[c] for c in SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, mark = Counter(windows), bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                mark[i : i + 3] = b"\1\1\1"
        repeated = sum(mark)
    at = np.frombuffer(text + b" ", np.uint8)
    marked = int((_IS_SYMBOL[at[:-1]] & _IS_SPACE[at[1:]]).sum())
    used = sum(map(frequent[0].__contains__, text.lower().split())) if frequent[0] else 0
    most = max(Counter(words).values(), default=0)
    return (n, points - int(chars[9:14].sum() + chars[32]), symbols, len(lines) - len(set(lines)), repeated, len(lines), int(chars[65:91].sum()), int(chars[97:123].sum()), int(chars[33]), used, round(frequent[1] * n), most, marked)


#: name: (bad if, good if), over the arrays of ``features``; neither is an abstention.
RULES = {
    "symbols": (lambda x: x.symbols > 0.10 * x.words, lambda x: x.symbols < 0.02 * x.words),
    "marked words": (lambda x: x.marked > 0.10 * x.words, lambda x: x.marked < 0.02 * x.words),
    "repeats": (lambda x: x.repeats > 0.30 * x.words, lambda x: x.repeats < 0.10 * x.words),
    "one word": (lambda x: x.most > 0.25 * x.words, lambda x: x.most < 0.12 * x.words),
    "lines": (lambda x: x.dup_lines > 0.30 * x.lines, lambda x: (x.dup_lines == 0) & (x.lines > 3)),
    "shouting": (lambda x: x.upper > 0.40 * (x.upper + x.lower), lambda x: x.upper < 0.15 * (x.upper + x.lower)),
    "exclaims": (lambda x: x.exclaims > 0.10 * x.words, lambda x: x.exclaims < 0.02 * x.words),
    "frequent words": (lambda x: x.frequent < 0.15 * x.usual, lambda x: x.frequent > 0.50 * x.usual),
}


class _Counts:
    def __init__(self, a: np.ndarray):
        self.words, self.chars, self.symbols, self.dup_lines, self.repeats, self.lines, self.upper, self.lower, self.exclaims, self.frequent, self.usual, self.most, self.marked = a.T


def patterns(counts: np.ndarray) -> np.ndarray:
    """A number per row of ``features`` whose base-3 digits are the votes: 0 abstains, 1 is bad, 2 good."""
    x, out = _Counts(counts), np.zeros(len(counts), np.int32)
    for bad, good in RULES.values():
        b = bad(x)
        out = out * 3 + np.where(b, 1, np.where(good(x), 2, 0))
    return out.astype(np.int32)


def votes(pattern: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 per pattern and rule."""
    n = len(RULES)
    digits = np.stack([pattern // 3 ** (n - 1 - i) % 3 for i in range(n)], axis=1) if len(pattern) else np.zeros((0, n), int)
    return np.array([0, -1, 1])[digits]


def fit(pattern: np.ndarray, count: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Share of good documents, and by EM the probability of each vote: an array over (class, rule, vote + 1), class 1 being good.

    Starts from rules that are mostly right or silent, which fixes which class is which. Counts are
    smoothed towards that start, so a rule that never votes keeps it.
    """
    v = votes(pattern)
    start = np.stack([np.tile([0.45, 0.35, 0.20], (len(RULES), 1)), np.tile([0.02, 0.18, 0.80], (len(RULES), 1))])
    prior, table = 0.8, start
    for _ in range(rounds):
        post = posterior(v, prior, table)
        weight = np.stack([(1 - post) * count, post * count])
        cast = np.stack([[[w @ (v[:, j] == k) for k in (-1, 0, 1)] for j in range(len(RULES))] for w in weight])
        new = (cast + 2 * start) / (weight.sum(axis=1)[:, None, None] + 2)
        moved = np.abs(new - table).max()
        prior, table = float((weight[1].sum() + 8) / (count.sum() + 10)), new
        if moved < 1e-9:
            break
    return prior, table


def posterior(v: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability of being good for each row of votes."""
    rules = np.arange(len(RULES))
    bad = np.log(table[0][rules, v + 1]).sum(axis=1) + np.log(1 - prior)
    good = np.log(table[1][rules, v + 1]).sum(axis=1) + np.log(prior)
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def model(counted: DataFrame) -> dict[int, float]:
    """Posterior of every pattern that occurs, from rows ``(pattern, n)``; at most 3**rules of them."""
    rows = counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    pattern, count = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], float)
    return dict(zip(pattern.tolist(), posterior(votes(pattern), *fit(pattern, count)).tolist(), strict=True))


class _Known:
    """Frequent words by language, as they are met; a few languages are kept."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[frozenset[bytes], float]] = {}

    def counts(self, b: pa.RecordBatch, text: str = "_t") -> np.ndarray:
        """``features`` of a batch with ``_key``, ``_words`` and ``_share``."""
        rows = []
        texts = b.column(text)
        texts = texts if pa.types.is_binary(texts.type) else texts.cast(pa.binary())
        for t, key, words, share in zip(texts, b.column("__quality_key").to_pylist(), b.column("__quality_words"), b.column("__quality_share").to_pylist(), strict=True):
            if key not in self.held:
                if len(self.held) >= LANGUAGES:
                    self.held.clear()
                self.held[key] = (frozenset(words.as_py() or ()), share or 0.0)
            rows.append(features(t.as_py(), self.held[key]))
        return np.array(rows, np.int64).reshape(b.num_rows, 13)


def _key(docs: DataFrame, lang_col: str | None) -> F.Column:
    """A document's language, told from none at all."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


def measured(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts, base verdict and vote pattern of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for b in batches:
            c = known.counts(b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c[:, i]) for i in range(5)), pa.array(base_failed(c)), pa.array(patterns(c))], [id_col, *FEATURES, "base_failed", "pattern"])

    rows = with_words(docs, frequent, lang_col).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("_t"), "__quality_key", "__quality_words", "__quality_share")
    return rows.mapInArrow(of, f"`{id_col}` long, {', '.join(f'{x} long' for x in FEATURES)}, base_failed boolean, pattern int")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", keep: float = KEEP) -> DataFrame:
    """``(id_col, *FEATURES, base_failed, kept, posterior)`` for every row of ``docs``."""
    found = scratch.materialize(measured(docs, frequent_words(docs, text_col, lang_col), id_col, text_col, lang_col), "measured")
    post = model(found.groupBy("pattern").agg(F.count("*").alias("n")))
    table = found.sparkSession.createDataFrame(list(post.items()), "pattern int, posterior double")
    out = found.join(F.broadcast(table), "pattern")  # at most 3**rules rows
    return out.select(id_col, *FEATURES, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep)).alias("kept"), "posterior")


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    Texts are read again for the frequent words, the pattern counts and the filter, so as not to write them to a table.
    """
    rows = with_words(docs, frequent_words(docs, text_col, lang_col), lang_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = Counter(), _Known()
        for b in batches:
            n.update(patterns(known.counts(b)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["pattern", "n"])

    post = model(rows.select(F.col(text_col).cast("binary").alias("_t"), "__quality_key", "__quality_words", "__quality_share").mapInArrow(count, "pattern int, n long"))
    good, names = np.array(sorted(p for p, x in post.items() if x >= keep), np.int32), docs.columns

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for b in batches:
            c = known.counts(b, text_col)
            yield b.filter(pa.array(~base_failed(c) & np.isin(patterns(c), good))).select(names)

    return rows.select(*docs.columns, "__quality_key", "__quality_words", "__quality_share").mapInArrow(sift, docs.schema)
