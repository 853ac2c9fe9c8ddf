"""Scoring texts with a hidden Markov language model.

Training counts every word of the training texts, then runs Baum-Welch: each round is one pass
in which every portion of the corpus adds up its expected counts, which are then summed across portions.
All training tokens take part in each round. Scoring runs the scaled forward recursion over the
whole token sequence, so a score is the exact log probability of the text under the model.

Texts of any length are one sequence each. A long one is worked on in pieces of ``PIECE`` tokens: the vectors behind its first
piece and before its last, and the transfer matrix of each piece between (what the recursion does to any state vector) give the exact vectors at
the pieces' ends, forward and backward, after which pieces are independent of each other and memory is bounded.

The states emit every training word, each with expected counts of its own, however many there are. Texts are encoded
once, in portions with dictionaries of their own; words are numbered within buckets of a hash. The
most frequent words (about ``SYMBOLS``) are symbols whose counts are sent to all executors. Of all others a
portion gets the counts of those it holds, adds up what it expects, and buckets
sum that over portions, row by row. The encoded corpus is bucketed by portion once, so rounds shuffle counts only.
``SYMBOLS``, ``DICTIONARY`` (words of a portion) and the number of buckets decide where a count lies and no result. Between
portions and buckets expected counts are rounded to 24 bits. Words never seen are in classes by their last three
bytes; a class has in a state what the training words of that ending that occur once are expected to count there.

A null text is empty and consists of the end token alone. Words are lower-cased in A-Z. A null id counts as the empty
string in the split. Repeated rows are scored alike, and counted as often as they occur. Without training texts
every word is unknown and the base score is 0.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock import scratch

STATES = 8
ROUNDS = 5
SYMBOLS = 60_000
CLASSES = 1_024
DICTIONARY = 500_000
PORTION = 4_000_000
LEAST_BUCKETS = 64
SEED = 42
PIECE = 2_048
BATCH = 400_000
ADD = 0.1
CHUNK = 512
END = b""


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash_of, words), np.uint64, len(words))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def n_buckets(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets that a vocabulary which grows with the 0.7th power of the text leaves with some 50,000 words each."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    return max(LEAST_BUCKETS, int(size**0.7 / 26_000))


def planes(x: np.ndarray) -> bytes:
    """32-bit integers byte by byte, which compresses well."""
    return x.astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1)[::-1].T).view("<u4").ravel()


def rising(x: np.ndarray) -> bytes:
    """Rising integers by their differences, byte by byte."""
    return planes(np.diff(x, prepend=0))


def from_rising(b: bytes) -> np.ndarray:
    return from_planes(b).cumsum(dtype=np.int64)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has; those of ``words_of``, split by Arrow, which looks at ASCII alone here."""
    plain = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_binary()), b"").view(pa.large_string()))
    found = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    n = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)  # split into one empty word
    flat = found.flatten().view(pa.large_binary())
    if not empty.any():
        return flat, n
    return flat.filter(pa.array(~np.repeat(empty & (n > 0), n))), np.where(empty, 0, n)


def listed(words: pa.Array) -> list[bytes]:
    """Words as Python objects."""
    return joined(words).split(b"\n") if len(words) else []


def joined(words: pa.Array) -> bytes:
    """Words in lines."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(b"\n", words.type))[0].as_py()


def encoded(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY, tokens: int = PORTION) -> DataFrame:
    """Portions of the documents: a row per document, and a row per portion and bucket of its words.

    ``symbols`` are places in the portion's list of words, which is sorted by bucket; ``words`` has the list, ``seen``
    how often the words occur in training texts of the portion. The empty word is the end token. A portion has at most
    ``dictionary`` words and about ``tokens``, or else a single document.
    """
    schema = f"portion long, `{id_col}` long, held_out boolean, n_tokens long, symbols binary, bucket int, words binary, seen binary"
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f"c{j}" for j in range(len(types))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = (TaskContext.get().partitionId() << 24) if TaskContext.get() else 0

        def flush(ids: list, held: list, flat: pa.ChunkedArray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal portion
            coded = flat.dictionary_encode().chunks  # one dictionary for all, and no chunk without words
            known = coded[0].dictionary if coded else pa.array([], flat.type)
            if len(known) > dictionary and len(ids) > 1:
                half, at = len(ids) // 2, int(sizes[: len(ids) // 2].sum())
                yield from flush(ids[:half], held[:half], flat.slice(0, at), sizes[:half])
                yield from flush(ids[half:], held[half:], flat.slice(at), sizes[half:])
                return
            words = [*listed(known), END]
            at = _hashes(words).view(np.int64) % buckets
            order = np.argsort(at, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            ends = np.cumsum(sizes + 1)
            symbols = np.full(int(ends[-1]), rank[-1], np.int32)
            inner = np.ones(len(symbols), bool)
            inner[ends - 1] = False
            symbols[inner] = rank[np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in coded)])]
            train = np.repeat(~np.array(held, bool), sizes + 1)
            seen, some = np.bincount(symbols[train], minlength=len(words)), []
            for i, h, x, y in zip(ids, held, (ends - sizes - 1).tolist(), ends.tolist(), strict=True):
                some.append((portion, i, h, y - x, planes(symbols[x:y]), None, None, None))
                if len(some) == 256:
                    yield batch(some)
                    some = []
            found, starts = np.unique(at[order], return_index=True)
            lines = pa.concat_arrays([known, pa.array([END], flat.type)]).take(pa.array(order))
            for k, x, y in zip(found.tolist(), starts.tolist(), np.append(starts, len(words))[1:].tolist(), strict=True):
                some.append((portion, None, None, None, None, k, joined(lines[x:y]), seen[x:y].astype("<i4").tobytes()))
            yield batch(some)
            portion += 1

        ids, held, flats, sizes = [], [], [], []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids += part.column(0).to_pylist()
                held += part.column(1).to_pylist()
                flat, n = words_in(part.column(2))
                flats.append(flat)
                sizes.append(n)
                if sum(map(len, flats)) >= tokens:
                    yield from flush(ids, held, pa.chunked_array(flats), np.concatenate(sizes))
                    ids, held, flats, sizes = [], [], [], []
        if ids:
            yield from flush(ids, held, pa.chunked_array(flats), np.concatenate(sizes))

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("_h"), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(of, schema)


def _level(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c) * 16).astype(int)


@dataclass
class Lexicon:
    """The frequent words, and the totals over all training words."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    mass: np.ndarray  # count per symbol: the words, the classes (their words that occur once), an end token never seen
    level: int  # the frequent words' least, on the scale of ``_level``
    rest: np.ndarray  # the first weights of all other words, by state

    @property
    def symbols(self) -> int:
        return len(self.words)


def vocabulary(portions: DataFrame) -> DataFrame:
    """``(bucket, words, c, kinds)``: the training words with their counts and classes, a row per bucket, words in order. Holds one bucket's words at a time."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), np.int64)
            for at, n in held:
                total[at] += n
            words = list(ids)
            order = [i for i in sorted(range(len(words)), key=words.__getitem__) if total[i]]
            if order:
                words = [words[i] for i in order]
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"\n".join(words), total[order].astype("<i8").tobytes(), np.array([class_of(w) for w in words], "<u2").tobytes()))], ["bucket", "words", "c", "kinds"])

        now, ids, held = None, defaultdict(), []
        for bucket, words, seen in _rows(batches, "bucket", "words", "seen"):
            if bucket != now:
                if now is not None:
                    yield from row()
                now, ids, held = bucket, defaultdict(), []
                ids.default_factory = ids.__len__
            mine = words.split(b"\n")
            held.append((np.fromiter(map(ids.__getitem__, mine), np.int64, len(mine)), np.frombuffer(seen, "<i4")))
            if len(held) >= 64:  # bounded, however many portions there are
                total = np.zeros(len(ids), np.int64)
                for at, n in held:
                    total[at] += n
                held = [(np.arange(len(ids)), total)]
        if now is not None:
            yield from row()

    rows = portions.where("bucket is not null").select("bucket", "words", "seen").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(gather, "bucket int, words binary, c binary, kinds binary")


def lexicon(known: DataFrame, states: int = STATES, symbols: int = SYMBOLS) -> Lexicon:
    """From ``vocabulary``; what is collected is bounded by ``symbols``, a thousand levels of counts, the classes and the states."""

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, once = defaultdict(lambda: [0, 0]), np.zeros(CLASSES, np.int64)
        for words, c in _rows(batches, "words", "c"):
            c = np.frombuffer(c, "<i8")
            found, at = np.unique(_level(c), return_inverse=True)
            for level, n, total in zip(found.tolist(), np.bincount(at).tolist(), np.bincount(at, c).tolist(), strict=True):
                levels[level][0] += n
                levels[level][1] += int(total)
            for w, n in zip(words.split(b"\n"), c.tolist(), strict=True):
                once[class_of(w)] += n == 1 and w != END
        rows = [("level", k, float(n), float(total)) for k, (n, total) in levels.items()] + [("class", k, float(n), 0.0) for k, n in enumerate(once.tolist()) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.float64()))], ["what", "k", "n", "c"])

    found = known.mapInArrow(census, "what string, k int, n double, c double").groupBy("what", "k").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()
    sizes = sorted(((r["k"], int(r["n"]), int(r["c"])) for r in found if r["what"] == "level"), reverse=True)
    once = np.zeros(CLASSES)
    for r in found:
        if r["what"] == "class":
            once[r["k"]] = r["n"]
    total, distinct, top, n = sum(r[2] for r in sizes), sum(r[1] for r in sizes), -1, 0
    for level, k, _ in sizes:
        if (n := n + k) > symbols - 1:
            top = level + 1
            break

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros(states)
        for words, c in _rows(batches, "words", "c"):
            words, c = words.split(b"\n"), np.frombuffer(c, "<i8")
            often = (_level(c) >= top) | np.array([w == END for w in words])
            rest += first_weights(c[~often].astype(float), states, _hashes([w for w, o in zip(words, often.tolist(), strict=True) if not o])).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, o in zip(words, often.tolist(), strict=True) if o], pa.binary()), pa.array(c[often]), pa.nulls(int(often.sum()), pa.binary())], ["word", "c", "rest"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([rest.tobytes()], pa.binary())], ["word", "c", "rest"])

    rows = known.mapInArrow(frequent, "word binary, c long, rest binary").collect()  # the frequent words, and a row per task
    table = sorted((bytes(r["word"]), r["c"]) for r in rows if r["word"] is not None)
    c = np.array([x[1] for x in table], np.int64)
    rest = sum((np.frombuffer(r["rest"], "<f8") for r in rows if r["rest"] is not None), np.zeros(states))
    return Lexicon([x[0] for x in table], c, total, distinct, np.concatenate([c.astype(float), once, [0.0]]), top, rest)


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def noise_of(hashes: np.ndarray, states: int) -> np.ndarray:
    """Weights of a word by state: gamma(1/2) numbers that its hash alone decides, and a floor."""
    x = hashes.astype(np.uint64)[:, None] + np.arange(1, 2 * states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return -np.log(u[:, :states]) * np.cos(2 * np.pi * u[:, states:]) ** 2 + 0.05


def first_weights(mass: np.ndarray, states: int = STATES, hashes: np.ndarray | None = None) -> np.ndarray:
    """Counts under pseudo-random weights: the first emissions, not yet divided by their sum."""
    return (mass + ADD)[:, None] * noise_of(np.arange(len(mass)) if hashes is None else hashes, states)


def first_model(mass: np.ndarray, states: int = STATES, hashes: np.ndarray | None = None) -> Model:
    """Sticky states whose emissions are the words' counts under pseudo-random weights."""
    emit = first_weights(mass, states, hashes)
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


@dataclass
class Pieces:
    """Runs of tokens in ``flat``; ``entry`` is the state vector before each, ``after`` the backward vector behind it."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # whether a text begins here
    owner: np.ndarray  # which text
    entry: np.ndarray
    after: np.ndarray

    def batches(self, most: int = BATCH) -> Iterator[np.ndarray]:
        """Numbers of pieces, longest first, some ``most`` tokens at a time."""
        order = np.argsort(-self.lengths, kind="stable")
        ends = np.cumsum(self.lengths[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield order[at:to]
            at = to


def active(lengths: np.ndarray) -> list[int]:
    """Of runs in falling order of length: how many have a token at each step."""
    return np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right").tolist()


def transfers(model: Model, p: Pieces, some: np.ndarray) -> np.ndarray:
    """What is behind each piece, up to factors: of pieces that begin texts, all or none, the one vector; of others a matrix whose row i is the vector after state i before it."""
    starts, steps, kind = p.starts[some], active(p.lengths[some]), model.emit.dtype
    k, move, begins = len(model.start), model.move.astype(kind), bool(p.first[some[0]])
    rows = 1 if begins else k
    out, moved, whole = np.empty((len(some), rows, k), kind), np.empty((len(some) * rows, k), kind), np.ones(rows * k, kind)
    every = 8 if kind == np.float64 else 2  # before numbers get too small
    for t, n in enumerate(steps):
        e = model.emit.take(p.flat[starts[:n] + t], axis=0, mode="clip")[:, None, :]
        before = (model.start.astype(kind) if begins else move) if t == 0 else np.matmul(out[:n].reshape(-1, k), move, out=moved[: n * rows]).reshape(n, rows, k)
        np.multiply(before, e, out=out[:n])
        if t % every == every - 1 or t + 1 == len(steps) or steps[t + 1] < n:
            out[:n] /= (out[:n].reshape(n, -1) @ whole)[:, None, None]
    return out


def backwards(model: Model, p: Pieces, some: np.ndarray) -> np.ndarray:
    """The backward vector before each piece that ends a text, up to a factor."""
    starts, steps, kind = p.starts[some], active(p.lengths[some]), model.emit.dtype
    out, back, one = np.ones((len(some), len(model.start)), kind), model.move.T.astype(kind), np.ones(len(model.start), kind)
    for t in range(len(steps) - 1, -1, -1):
        n = steps[t]
        out[:n] = (out[:n] * model.emit.take(p.flat[starts[:n] + t], axis=0, mode="clip")) @ back
        if t % 2 == 0:
            out[:n] /= (out[:n] @ one)[:, None]
    return out


def pieces(model: Model, texts: list[np.ndarray], size: int = PIECE) -> Pieces:
    """Texts as pieces of at most ``size`` tokens with their end vectors; only pieces with others before and behind need a transfer matrix."""
    k = len(model.start)
    lengths = np.array([len(x) for x in texts], np.int64)
    many = -(-lengths // size)
    owner = np.repeat(np.arange(len(texts)), many)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    starts = (np.cumsum(lengths) - lengths)[owner] + rank * size
    p = Pieces(np.concatenate(texts), starts, np.minimum(size, lengths[owner] - rank * size), rank == 0, owner, np.zeros((len(owner), k)), np.ones((len(owner), k)))
    first, last = rank == 0, rank == many[owner] - 1
    found: dict[int, np.ndarray] = {}
    for which, what in ((first & ~last, transfers), (~first & ~last, transfers), (~first & last, backwards)):
        at = np.flatnonzero(which)
        part = Pieces(p.flat, p.starts[at], p.lengths[at], p.first[at], p.owner[at], p.entry[at], p.after[at])
        for some in part.batches():
            found.update(zip(at[some].tolist(), what(model, part, some).astype(float), strict=True))
    cut = np.flatnonzero(many[owner] > 1).tolist()
    v = None
    for i in cut:
        if first[i]:
            v = found[i][0]
        else:
            p.entry[i] = v / v.sum()
            v = None if last[i] else p.entry[i] @ found[i]
    for i in reversed(cut):
        if not first[i]:
            p.after[i - 1] = found[i] if last[i] else found[i] @ p.after[i]
            p.after[i - 1] /= p.after[i - 1].max()
    return p


def expected(model: Model, p: Pieces, some: np.ndarray, counts: np.ndarray, moves: np.ndarray, begins: np.ndarray) -> float:
    """Adds the expected counts of some pieces to the last three arrays; returns their log likelihood. Computes in the type of ``model.emit``."""
    starts, first, kind = p.starts[some], p.first[some], model.emit.dtype
    entry, after, move, one = p.entry[some].astype(kind), p.after[some].astype(kind), model.move.astype(kind), np.ones(len(model.start), kind)
    steps = active(p.lengths[some])
    ends = np.cumsum(steps).tolist()
    seen = p.flat[np.concatenate([starts[:n] + t for t, n in enumerate(steps)])].astype(np.intp)  # step by step, as all arrays below
    emits = model.emit.take(seen, axis=0, mode="clip")  # faster than by an index, and none is beyond the table
    alphas, scales, a = np.empty_like(emits), np.empty(len(seen), kind), None
    for n, end in zip(steps, ends, strict=True):
        now = alphas[end - n : end]
        if a is None:
            now[:] = np.where(first[:, None], model.start.astype(kind), entry @ move)
        else:
            np.matmul(a[:n], move, out=now)
        now *= emits[end - n : end]
        c = np.matmul(now, one, out=scales[end - n : end])
        now /= c[:, None]
        a = now
    beta, sums = np.zeros((0, len(one)), kind), np.zeros_like(moves)
    for t in range(len(steps) - 1, -1, -1):
        n, m, end = steps[t], len(beta), ends[t]
        now, ahead = alphas[end - n : end], emits[end - n : end]
        if n > m:
            last = after[m:n] / ((now[m:] * after[m:n]) @ one)[:, None]
            beta = np.concatenate([beta, last]) if m else last
        ahead *= beta
        ahead /= scales[end - n : end, None]
        before = np.where(first[:, None], 0, entry) if t == 0 else alphas[ends[t - 1] - steps[t - 1] :][:n]
        sums += before.T @ ahead
        now *= beta
        beta = ahead @ move.T
    moves += sums * model.move
    begins += alphas[: steps[0]][first].sum(axis=0, dtype=float)
    for k in range(alphas.shape[1]):
        counts[:, k] += np.bincount(seen, weights=alphas[:, k], minlength=len(counts))
    return float(np.log(scales, dtype=float).sum())


def log10_likelihoods(model: Model, texts: list[np.ndarray], size: int = 4 * PIECE) -> np.ndarray:
    """Exact log10 probability of each text by the scaled forward recursion."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    p, one = pieces(model, texts, size), np.ones(len(model.start))
    for some in p.batches():
        starts, steps = p.starts[some], active(p.lengths[some])
        alphas = model.emit.take(p.flat[np.concatenate([starts[:n] + t for t, n in enumerate(steps)])], axis=0, mode="clip")  # step by step
        scales, a, end = np.empty(len(alphas)), None, 0
        for n in steps:
            now, end = alphas[end : end + n], end + n
            now *= np.where(p.first[some][:, None], model.start, p.entry[some] @ model.move) if a is None else a[:n] @ model.move
            c = np.matmul(now, one, out=scales[end - n : end])
            now /= c[:, None]
            a = now
        owner = p.owner[some][np.concatenate([np.arange(n) for n in steps])]
        total += np.bincount(owner, weights=np.log10(scales), minlength=len(total))
    return total


def packed(n: np.ndarray) -> bytes:
    """Counts rounded to the upper 24 bits of 32-bit floats, byte by byte, which compresses well."""
    bits = np.ascontiguousarray(n, "<f4").view("<u4") + np.uint32(0x80)
    return b"".join(bits.view(np.uint8).reshape(-1, 4)[:, i].tobytes() for i in (3, 2, 1))


def unpacked(b: bytes, states: int) -> np.ndarray:
    parts = np.frombuffer(b, np.uint8).reshape(3, -1)
    out = np.zeros((parts.shape[1], 4), np.uint8)
    for i, part in zip((3, 2, 1), parts, strict=True):
        out[:, i] = part
    return out.view("<f4").reshape(-1, states)


def once_seen(lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words that occur once, and the symbols of their classes."""
    at = np.flatnonzero(lex.counts == 1)
    return at, np.array([lex.symbols + class_of(lex.words[i]) for i in at.tolist()], np.int64)


def _sums(n: np.ndarray, c: np.ndarray, k: np.ndarray) -> bytes:
    """By state, the sum over a bucket's words, and below it the sums over words that occur once, by class."""
    out = np.zeros((1 + CLASSES, n.shape[1]))
    out[0] = n.sum(axis=0)
    np.add.at(out, 1 + k[c == 1], n[c == 1])
    return out.tobytes()


def _by_bucket(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts that are alike in ``bucket`` follow each other in one partition, part by part."""
    rows = parts[0].withColumn("part", F.lit(0))
    for i, x in enumerate(parts[1:], 1):
        rows = rows.unionByName(x.withColumn("part", F.lit(i)), allowMissingColumns=True)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "part")


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def placed(portions: DataFrame, known: DataFrame, lex: Lexicon, states: int = STATES) -> DataFrame:
    """``(portion, bucket, code, at, c, n)``, a row per portion and bucket. Holds one bucket's words at a time.

    ``code`` has the symbol of each word of the portion's list, of one that has none -1 less its rank among those, by number in the bucket;
    in that order ``at`` has the numbers, ``c`` the counts and ``n`` the first weights.
    """
    sent = portions.sparkSession.sparkContext.broadcast(lex.words)
    unseen, end = lex.symbols, len(lex.mass) - 1

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = {w: i for i, w in enumerate(sent.value)}
        now, empty = None, ({}, np.zeros(0, np.int64), np.zeros(0, "<i4"), np.zeros((0, states)))
        ids, counts, codes, first = empty
        for bucket, part, portion, words, c in _rows(batches, "bucket", "part", "portion", "words", "c"):
            if bucket != now:
                now, (ids, counts, codes, first) = bucket, empty
            mine = words.split(b"\n")
            if part == 0:
                ids, counts = {w: i for i, w in enumerate(mine)}, np.frombuffer(c, "<i8")
                codes = np.fromiter(map(symbol.get, mine, repeat(-1)), "<i4", len(mine))
                first = first_weights(counts.astype(float), states, _hashes(mine))
                continue
            at = np.fromiter(map(ids.get, mine, repeat(-1)), "<i4", len(mine))
            code = np.append(codes, -1).astype("<i4")[at]
            for i in np.flatnonzero(at < 0).tolist():
                code[i] = end if mine[i] == END else unseen + class_of(mine[i])
            none = np.flatnonzero(code < 0)
            none = none[np.argsort(at[none])]
            at, code[none] = at[none], -1 - np.arange(len(none))
            yield pa.RecordBatch.from_arrays([pa.array([portion], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (code.tobytes(), rising(at), counts[at].astype("<i8").tobytes(), packed(first[at])))], ["portion", "bucket", "code", "at", "c", "n"])

    rows = _by_bucket([known.select("bucket", "words", "c"), portions.where("bucket is not null").select("bucket", "portion", "words")])
    return rows.mapInArrow(number, "portion long, bucket int, code binary, at binary, c binary, n binary")


def _written(df: DataFrame, name: str, keep=scratch.written) -> tuple[DataFrame, str]:
    """As ``scratch.written``; what the shuffles leave on the executors' disks goes at the end."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return keep(df.select("*"), name)  # a new frame, as the setting is read when one is made
    finally:
        conf.set(key, before)


@dataclass
class Rest:
    """What makes emissions of the expected counts of words without a symbol: ``(n + more * (c + ADD)) / total``."""

    more: float
    total: np.ndarray  # by state


@dataclass
class Portion:
    """A portion's texts and words, with the emissions of all that occurs in it."""

    rows: pa.Table
    texts: list[np.ndarray]
    buckets: list[int]
    at: list[bytes]
    c: np.ndarray  # of words without a symbol
    model: Model


def portion_of(own: pa.Table, counts: pa.Table, now: Model, rest: Rest, symbols: int, kind: type = np.float64) -> Portion:
    """Puts a portion together from its rows and from its words' expected counts; ``symbols`` are those of ``now``."""
    states, texts = len(now.start), own.filter(pc.is_valid(own.column("symbols")))
    lists = own.filter(pc.is_valid(own.column("code"))).select(["bucket", "code", "at", "c"]).sort_by("bucket")
    n = dict(zip(counts.column("bucket").to_pylist(), counts.column("n").to_pylist(), strict=True))
    buckets, code, at, c = (x.to_pylist() for x in lists.columns)
    place, c = np.frombuffer(b"".join(code), "<i4").copy(), np.frombuffer(b"".join(c), "<i8")
    none, sizes = place < 0, np.array([len(x) // 4 for x in at], np.int64)
    place[none] = symbols - 1 - place[none] + np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = np.concatenate([unpacked(n[b], states) for b in buckets] or [np.zeros((0, states))])
    emit = (n.astype(kind) + (rest.more * (c + ADD)).astype(kind)[:, None]) / rest.total.astype(kind)
    found = [place.take(from_planes(x)) for x in texts.column("symbols").to_pylist()]
    return Portion(texts, found, buckets, at, c, Model(now.start, now.move, np.concatenate([now.emit.astype(kind), emit])))


def fit(portions: DataFrame, spread: DataFrame, known: DataFrame, lex: Lexicon, buckets: int, states: int = STATES, rounds: int = ROUNDS, back_off: float = 20.0) -> tuple[Model, Rest, DataFrame]:
    """Baum-Welch over all training texts: the model, and ``(bucket, portion, n)``, what the portions' words without a symbol are expected to count.

    ``portions`` has the rows of ``encoded`` and ``placed`` bucketed by portion, ``spread`` those of ``placed``, ``known`` the vocabulary.
    """
    spark, mass, m = portions.sparkSession, lex.mass, len(lex.mass)
    once, chunks = once_seen(lex), -(-m // CHUNK)
    train, static = portions.where("held_out is null or not held_out"), spread.select("bucket", "portion", "at")

    def sums(of: DataFrame, column: str) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(x.as_py(), "<f8") for b in batches for x in b.column(0))
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

        parts = of.select(column).repartition(4).mapInArrow(add, "n binary").collect()
        return sum((np.frombuffer(r[0], "<f8") for r in parts), np.zeros((1 + CLASSES) * states)).reshape(-1, states)

    hashes = np.concatenate([_hashes(lex.words), np.arange(m - lex.symbols, dtype=np.uint64)])
    share = 1 / (mass[lex.symbols :].sum() + lex.total + ADD * (m + lex.distinct - lex.symbols))  # prior of a word, by its count
    model = first_model(mass, states, hashes)
    own = first_weights(mass, states, hashes)
    rest = Rest(0.0, own.sum(axis=0) + lex.rest)
    model.emit = own / rest.total
    weights, path = spread.select("bucket", "portion", "n"), None
    for _ in range(rounds if lex.total else 0):
        sent = spark.sparkContext.broadcast((model, rest))

        def gather(key: tuple, mine: pa.Table, words: pa.Table) -> pa.Table:
            now, rest = sent.value
            x = portion_of(mine, words, now, rest, m, np.float32)
            counts, moves, begins = np.zeros((states, len(x.model.emit))).T, np.zeros((states, states)), np.zeros(states)
            if x.texts:
                p = pieces(x.model, x.texts)
                for some in p.batches(2 * BATCH):
                    expected(x.model, p, some, counts, moves, begins)
            counts = counts.astype(np.float32, order="C")
            out, n = [], m
            for bucket, at in zip(x.buckets, x.at, strict=True):
                out.append((bucket, at, packed(counts[n : (n := n + len(at) // 4)])))
            out += [(buckets + j, None, packed(counts[j * CHUNK : min(j * CHUNK + CHUNK, m)])) for j in range(chunks)]
            out.append((buckets + chunks, None, np.concatenate([moves, begins[None, :]]).tobytes()))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "at", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row(bucket: int, portion: int, n: bytes) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([portion], pa.int64()), pa.array([n], pa.binary())], ["bucket", "portion", "n"])

            def whole() -> pa.RecordBatch:
                return row(now, -1, _sums(total, c, k) if now < buckets else total.tobytes())

            now = total = c = k = None
            for bucket, part, portion, at, n, mine, kinds in _rows(batches, "bucket", "part", "portion", "at", "n", "c", "kinds"):
                if bucket != now:
                    if total is not None:
                        yield whole()
                    now, total = bucket, None
                if part == 0:
                    c, k = np.frombuffer(mine, "<i8"), np.frombuffer(kinds, "<u2")
                    total = np.zeros((len(c), states))
                elif part == 1 and at is not None:
                    total[from_rising(at)] += unpacked(n, states)  # a portion has a word once
                elif part == 1:
                    x = np.frombuffer(n, "<f8").reshape(-1, states) if bucket == buckets + chunks else unpacked(n, states)
                    total = x.astype(float) if total is None else total + x
                else:
                    yield row(bucket, portion, packed(total[from_rising(at)]) if at else b"")
            if total is not None:
                yield whole()

        up = train.groupBy("portion").cogroup(weights.groupBy("portion")).applyInArrow(gather, "bucket int, at binary, n binary")
        new, new_path = _written(_by_bucket([known.select("bucket", "c", "kinds"), up, static]).mapInArrow(add, "bucket int, portion long, n binary"), "weights")
        if path:
            scratch.delete(spark, path)
        path, weights = new_path, new.where("portion >= 0")
        rows = {r[0]: np.frombuffer(r[1], "<f8").reshape(-1, states) for r in new.where(f"portion = -1 and bucket >= {buckets}").select("bucket", "n").collect()}  # one model
        others = sums(new.where(f"portion = -1 and bucket < {buckets}"), "n")
        sent.destroy()
        counts, tail = np.concatenate([rows[buckets + j] for j in range(chunks)]), rows[buckets + chunks]
        np.add.at(counts, once[1], counts[once[0]])
        counts[lex.symbols : lex.symbols + CLASSES] += others[1:]
        counts = counts + back_off * share * (mass + ADD)[:, None]
        rest = Rest(back_off * share, counts.sum(axis=0) + others[0] + back_off * share * (lex.total - lex.counts.sum() + ADD * (lex.distinct - lex.symbols)))
        moves, begins = tail[:states] + 1.0, tail[states] + 1.0
        model = Model(begins / begins.sum(), moves / moves.sum(axis=1, keepdims=True), counts / rest.total)
    return model, rest, weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, dictionary: int = DICTIONARY) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``."""
    spark, buckets = docs.sparkSession, n_buckets(docs, text_col)
    rows, path = _written(encoded(docs, buckets, id_col, text_col, dictionary), "encoded")
    known, known_path = _written(vocabulary(rows), "vocabulary")
    lex = lexicon(known, states, symbols)
    spread, spread_path = _written(placed(rows, known, lex, states), "placed")
    texts = rows.where("symbols is not null").drop("bucket", "words", "seen")
    portions, _ = _written(texts.unionByName(spread.drop("n"), allowMissingColumns=True), "portions", lambda df, name: scratch.bucketed(df, "portion", name))
    scratch.delete(spark, path)
    model, rest, weights = fit(portions, spread, known, lex, buckets, states, rounds)
    scratch.delete(spark, known_path)
    if lex.total:
        scratch.delete(spark, spread_path)
    total, distinct, m = lex.total, lex.distinct, len(lex.mass)
    sent = spark.sparkContext.broadcast((model, rest, lex.counts))
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def forward(key: tuple, mine: pa.Table, words: pa.Table) -> pa.Table:
        now, rest, own = sent.value
        x = portion_of(mine, words, now, rest, m)
        c = np.concatenate([own, np.zeros(m - len(own), np.int64), x.c])
        base, some = np.log10((c + ADD) / (total + ADD * (distinct + 1))), c > 0
        found = [[int(np.count_nonzero(some.take(s))) for s in x.texts], [total] * len(x.texts), [float(base.take(s).sum()) for s in x.texts], log10_likelihoods(x.model, x.texts)]
        return pa.table([*(x.rows.column(n) for n in names[:3]), *(pa.array(v, t) for v, t in zip(found, kinds[3:], strict=True))], names=names)

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return portions.groupBy("portion").cogroup(weights.groupBy("portion")).applyInArrow(forward, schema)
