"""Byte-level BPE encoding and decoding by merge replay over a corpus.

The distinct pre-tokens of a corpus (here the documents of an Arrow batch, so memory stays
bounded) are laid out side by side, and an inverted index leads from the rank that a token pair
merges to, to the positions where such pairs stand. Merges are replayed in rank order over all
words at once, each touching only the neighbours of its positions. Ids equal those
of encoding each pre-token alone.

Texts are cut for look-ups at single spaces between characters that aren't white space: no
match of the pre-tokenization pattern crosses such a place, so what stands between two of them
can be encoded once and remembered.

Null texts count as empty and have no tokens. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import heapq
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 300_000


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, bounded by its vocabulary; the driver reads it and sends it out."""
    return Path(path).read_bytes()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


NONE = 1 << 30
FEW = 64  # words for which laying out a corpus costs more than it saves


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that make a token: keys ``left * size + right``, sorted, and the ranks they merge to."""
    size, keys, made = max(ranks.values()) + 1, [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a * size + b)
                made.append(rank)
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(made, np.int32)[order]


def _alone(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a queue of its pairs, lowest rank and then leftmost first, for words that need that order in full."""
    parts = [word[i : i + 1] for i in range(len(word))]
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    queue = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, n = heapq.heappop(queue)
        j = right[i]
        if parts[i] is None or j < 0 or len(parts[i]) + len(parts[j]) != n:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j], right[i] = parts[i] + parts[j], None, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for p, q in ((left[i], i), (i, right[i])):
            if p >= 0 and q >= 0 and (r := ranks.get(parts[p] + parts[q])) is not None:
                heapq.heappush(queue, (r, p, len(parts[p]) + len(parts[q])))
    return [ranks[x] for x in parts if x is not None]


class Encoder:
    """Encodes texts with the ranks of a byte-level vocabulary; remembers what it has encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.keys, self.made = table or merge_table(ranks)
        self.byte = np.array([ranks.get(bytes([i]), NONE) for i in range(256)], np.int64)
        self.words: dict[str, bytes] = {}  # pre-token: its ids, packed
        self.first: dict[str, bytes] = {}  # what stands before a text's first cut
        self.later: dict[str, bytes] = {}  # what follows a cut, without the space

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word, by merges in rank order over all words.

        ``rank`` says to which rank the pair at a position merges. Ranks are taken in bands; on
        entering a band, an inverted index from rank to positions is made of what stands in it,
        and kept up as merges in the band make new pairs. Words in which a merge makes a pair of
        a lower rank than its own, or in which pairs of one rank overlap, depend on the order
        within the word; those go through a queue of their own.
        """
        if len(words) < FEW:
            return [np.array(_alone(w, self.ranks), "<u4").tobytes() for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.byte[flat].astype(np.int32)
        n = len(flat)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        right[ends[lengths > 0] - 1] = -1
        left[(ends - lengths)[lengths > 0]] = -1
        rank = np.full(n, NONE, np.int32)
        if n > 1:
            byte_pairs = self._ranks(np.repeat(self.byte, 256), np.tile(self.byte, 256)).astype(np.int32)
            inner = np.flatnonzero(right >= 0)
            rank[inner] = byte_pairs[flat[inner].astype(np.int32) * 256 + flat[inner + 1]]
        odd, chosen = np.zeros(len(words), bool), np.zeros(n, bool)
        alive = np.flatnonzero(rank < NONE).astype(np.int32)
        low = 0
        while len(alive):
            now = rank[alive]
            low = int(now.min())
            high = low + max(16, low // 8)
            here = alive[now < high]
            order = np.argsort(rank[here], kind="stable")
            here, ranks = here[order], rank[here][order]
            starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
            index = dict(zip(ranks[starts].tolist(), np.split(here, starts[1:]), strict=True))
            queue = sorted(index)
            heapq.heapify(queue)
            while queue:
                r = heapq.heappop(queue)
                at = index.pop(r)
                if isinstance(at, list):
                    at = np.sort(np.concatenate(at))
                    at = at[np.r_[True, at[1:] != at[:-1]]]
                at = at[rank[at] == r]
                if not len(at):
                    continue
                other = right[at]
                if len(at) > 1:
                    chosen[at] = True
                    twice = chosen[other]
                    chosen[at] = False
                    if twice.any():
                        odd[word[at[twice]]] = True
                after = right[other]
                ids[at] = r
                right[at] = after
                rank[other] = NONE
                rank[at] = NONE
                has = after >= 0
                left[after[has]] = at[has]
                before = left[at]
                x, y = at[has], after[has]
                p = before[before >= 0]
                x, y = np.concatenate([x, p]), np.concatenate([y, at[before >= 0]])
                new = self._ranks(ids[x], ids[y])
                rank[x] = new
                good = new < NONE
                x, new = x[good], new[good]
                if not len(x):
                    continue
                if (bad := new <= r).any():
                    odd[word[x[bad]]] = True
                    rank[x[bad]] = NONE
                    x, new = x[~bad], new[~bad]
                near = new < high
                for pos, k in zip(x[near].tolist(), new[near].tolist(), strict=True):
                    if k in index:
                        if not isinstance(index[k], list):
                            index[k] = [index[k]]
                        index[k].append(np.array([pos], np.int32))
                    else:
                        index[k] = [np.array([pos], np.int32)]
                        heapq.heappush(queue, k)
            alive = np.flatnonzero(rank < NONE).astype(np.int32)
        dead = np.ones(n, bool)
        if n:
            # a position is still a token if it starts its word or its left neighbour leads to it
            dead[(ends - lengths)[lengths > 0]] = False
            follow = right[right >= 0]
            lead = np.flatnonzero(right >= 0)
            reach = left[follow] == lead
            dead[follow[reach]] = False
        keep = ~dead
        packed = ids[keep].astype("<u4").tobytes()
        count = np.bincount(word[keep], minlength=len(words)) if n else np.zeros(len(words), np.int64)
        stops = (np.cumsum(count) * 4).tolist()
        out, start = [], 0
        for e in stops:
            out.append(packed[start:e])
            start = e
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(_alone(words[i], self.ranks), "<u4").tobytes()
        return out

    def _encode_words(self, keys: list[str], words: list[bytes], into: dict[str, bytes]) -> None:
        """Ids of whole pre-tokens, put under ``keys``."""
        rest, names, ranks = [], [], self.ranks
        for k, w in zip(keys, words, strict=True):
            if (whole := ranks.get(w)) is not None:
                into[k] = whole.to_bytes(4, "little")
            else:
                names.append(k)
                rest.append(w)
        into.update(zip(names, self.replay(rest), strict=True))

    def _learn(self, first: set[str], new: set[str]) -> None:
        find, words, later = self.find, self.words, self.later
        whole, ended, split = [], [], []
        for x in new:  # letters, or letters and a mark, need no pattern
            if x.isalpha():
                whole.append(x)
            elif x[-1:] in (".", ",") and x[:-1].isalpha():
                ended.append(x)
            else:
                split.append((later, x, find(" " + x)))
        split += [(self.first, x, find(x)) for x in first]
        whole += {y for x in ended if (y := x[:-1]) not in later and y not in new}
        self._encode_words(whole, [b" " + x.encode() for x in whole], later)
        found = {w for _, _, parts in split for w in parts if w not in words} | {w for w in (".", ",") if w not in words}
        self._encode_words(list(found), [w.encode() for w in found], words)
        marks = {m: words[m] for m in (".", ",")}
        for x in ended:
            later[x] = later[x[:-1]] + marks[x[-1]]
        for into, x, parts in split:
            into[x] = b"".join(map(words.__getitem__, parts))

    def learn(self, split: list[list[str]], forget: bool = True) -> None:
        """Encodes what of the pieces of some texts isn't known yet."""
        if forget and len(self.words) + len(self.first) + len(self.later) > REMEMBERED:
            self.words, self.first, self.later = {}, {}, {}
        first, later = {s[0] for s in split}, set()
        for s in split:
            later.update(s[1:])
        self._learn({x for x in first if x not in self.first}, {x for x in later if x not in self.later})

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        split = [pieces(t) for t in texts]
        self.learn(split)
        return [self.first[s[0]] + b"".join(map(self.later.__getitem__, s[1:])) for s in split]


_OTHER_SPACE = re.compile(r"[^\S \n]").search


def pieces(text: str) -> list[str]:
    """``text`` cut at single spaces that stand between other characters than white space."""
    parts = text.split(" ")
    if not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE(text)):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        last = out[-1]
        if last and p and not last[-1].isspace() and not p[0].isspace():
            out.append(p)
        else:
            out[-1] = f"{last} {p}"
    return out


def portions(batch: pa.RecordBatch, column: int, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``most`` bytes, or one row."""
    size, start = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            size, start = 0, i
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def give_back() -> None:
    """Hands freed memory back to the system; workers that wait for their next task would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def decoder(ranks: dict[bytes, int]):
    """A function from packed ids to the bytes that they stand for."""
    table = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        table[i] = t
    return lambda ids: b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``(id_col, n_tokens, ids)`` for every row; ``ids`` are packed little-endian unsigned 32-bit integers.

    With ``decode`` also ``decoded``, the bytes that the ids decode to, made in the same pass.
    """
    ranks = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(parse_ranks(ranks))))  # one vocabulary
    names = [id_col, "n_tokens", "ids"] + ["decoded"] * decode

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = parse_ranks(sent.value[0])
        encoder, bytes_of = Encoder(ranks, pattern, sent.value[1]), decoder(ranks)
        for batch in batches:
            for b in portions(batch, 1):
                ids = encoder.encode(t.as_py() or "" for t in b.column(1))
                out = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(map(bytes_of, ids), pa.binary())] * decode, names)
                del ids, out
        del encoder, bytes_of, ranks
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_t"))
    return rows.mapInArrow(of, f"`{id_col}` long, n_tokens long, ids binary" + ", decoded binary" * decode)


def decoded(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that the packed ids stand for."""
    data = tokens.sparkSession.sparkContext.broadcast(read_ranks(path))
    at, names = tokens.columns.index(ids_col), tokens.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = decoder(parse_ranks(data.value))
        for batch in batches:
            for b in portions(batch, at):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bytes_of(x.as_py()) for x in b.column(at)], pa.binary())], [*names, out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(of, f"{kinds}, `{out_col}` binary")
