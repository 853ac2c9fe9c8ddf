"""Token counts that follow edits.

Every document keeps a segment tree over runs of pre-tokens: a leaf has the characters and the
tokens of a run of ``LEAF`` characters or more that starts and ends at a place no pre-token
crosses, an inner node the sums of its two children. An edit descends to the leaves it touches, with
two characters of context on either side so that the outer ends of the run stay such places;
only their text is encoded anew, and sums change on the paths above them. The count of the edited
text is the root's and equals that of encoding it whole.

Null texts count as empty: their tree is one empty leaf. Edits are applied in order, each to the text that
the one before has left; positions are clipped to the text, null numbers count as 0 and a null insertion as empty.
Repeated rows keep trees of their own; without edits a document stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock.llm.bpe import Encoder, give_back, merge_table, parse_ranks, pieces, portions, read_ranks

LEAF = 256
EDITS = "array<struct<at:long,delete:long,insert:string>>"


class Counter:
    """Token counts of texts and their runs."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.letter = len(encoder.encode(["x"])[0]) // 4

    def runs(self, texts: list[str], leaf: int = LEAF, forget: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the characters and tokens of its runs; one empty run for an empty text."""
        split = [pieces(t) for t in texts]
        self.encoder.learn(split, forget)
        first, later, out = self.encoder.first, self.encoder.later, []
        for parts in split:
            n = len(parts)
            chars = np.fromiter(map(len, parts), np.int64, n)
            chars[1:] += 1  # the space before
            tokens = np.fromiter(chain((len(first[parts[0]]),), map(len, map(later.__getitem__, parts[1:]))), np.int64, n) // 4
            ends = np.cumsum(chars)
            starts = np.flatnonzero(np.r_[True, (ends[:-1] // leaf)[1:] != (ends[:-1] // leaf)[:-1], False][:n]) if n > 1 else np.zeros(1, np.int64)
            out.append((np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)))
        return out

    def runs_within(self, region: str, spaced: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Runs of a part of a text; ``spaced`` if it starts with the space of a cut."""
        if not spaced:
            return self.runs([region], leaf, False)[0]
        # a letter before the space, so that the part is cut as it is within its text
        chars, tokens = self.runs(["x" + region], leaf, False)[0]
        chars[0] -= 1
        tokens[0] -= self.letter
        return chars, tokens


class Tree:
    """Sums of characters and tokens over runs, as heap-ordered arrays."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        size = 1 << max(0, int(len(chars) - 1).bit_length())
        self.sums = np.zeros((2, 2 * size), np.int64)
        self.sums[0, size : size + len(chars)], self.sums[1, size : size + len(tokens)] = chars, tokens
        half = size // 2
        while half:
            self.sums[:, half : 2 * half] = self.sums[:, 2 * half : 4 * half : 2] + self.sums[:, 2 * half + 1 : 4 * half : 2]
            half //= 2

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        out = cls.__new__(cls)
        out.sums = np.frombuffer(data, "<i8").reshape(2, -1).copy()
        return out

    def pack(self) -> bytes:
        return self.sums.astype("<i8").tobytes()

    @property
    def size(self) -> int:
        return self.sums.shape[1] // 2

    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with character ``at`` and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[0, 2 * node])
            node *= 2
            if at - start >= left and self.sums[0, node + 1]:
                start, node = start + left, node + 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.sums[:, node] = chars, tokens
        node //= 2
        while node:
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]
            node //= 2


def apply_edit(text: str, tree: Tree, counter: Counter, at: int | None, delete: int | None, insert: str | None, leaf: int = LEAF) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many characters were encoded anew."""
    at = min(max(at or 0, 0), len(text))
    delete, insert = min(max(delete or 0, 0), len(text) - at), insert or ""
    low, start = tree.find(max(at - 2, 0))
    high, high_start = tree.find(max(min(at + delete + 1, len(text) - 1), 0))
    end = high_start + int(tree.sums[0, tree.size + high])
    region = text[start:at] + insert + text[at + delete : end]
    text = text[:start] + region + text[end:]
    chars, tokens = counter.runs_within(region, start > 0, leaf)
    if len(chars) <= high - low + 1:
        for i in range(low, high + 1):
            k = i - low
            tree.put(i, int(chars[k]) if k < len(chars) else 0, int(tokens[k]) if k < len(tokens) else 0)
    else:  # more leaves than before: the sums are laid out anew, nothing else is encoded
        old = tree.sums[:, tree.size :]
        kept = lambda row, new: np.concatenate([old[row, :low], new, old[row, high + 1 :][old[0, high + 1 :] > 0]])
        tree = Tree(kept(0, chars), kept(1, tokens))
    return text, tree, len(region)


def trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, text, tree, *keep)`` for every row of ``docs``: what counting keeps of a document."""
    sc = docs.sparkSession.sparkContext
    data = read_ranks(path)
    sent = sc.broadcast((data, merge_table(parse_ranks(data))))  # one vocabulary

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table = sent.value
        counter = Counter(Encoder(parse_ranks(ranks), pattern, table))
        for b in (part for batch in batches for part in portions(batch, 1)):
            found = counter.runs([t.as_py() or "" for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([Tree(*f).pack() for f in found], pa.binary()), *b.columns[2:]], [id_col, "text", "tree", *keep])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"), *keep)
    kinds = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(of, f"`{id_col}` long, text string, tree binary{kinds}")


def with_edits(state: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``state`` with the edits of each document, in order, as an array; ``edits`` has ``(id_col, seq, at, delete, insert)``."""
    each = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "at", "delete", "insert"))).alias("_e"))
    listed = each.select(id_col, F.transform("_e", lambda e: F.struct(e["at"].cast("long").alias("at"), e["delete"].cast("long").alias("delete"), e["insert"].alias("insert"))).alias("edits"))
    return state.join(listed, id_col, "left")


def edited(state: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, text, tree, n_tokens_before, n_tokens, n_encoded)`` after the column ``edits`` of each row of ``state``."""
    sc = state.sparkSession.sparkContext
    data = read_ranks(path)
    sent = sc.broadcast((data, merge_table(parse_ranks(data))))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table = sent.value
        counter = Counter(Encoder(parse_ranks(ranks), pattern, table))
        names = [id_col, "text", "tree", "n_tokens_before", "n_tokens", "n_encoded"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, text, tree, edits in zip(*(b.column(k) for k in range(4)), strict=True):
                t, now, anew = text.as_py() or "", Tree.unpack(tree.as_py()), 0
                before = now.n_tokens()
                for e in edits.as_py() or ():
                    t, now, n = apply_edit(t, now, counter, e["at"], e["delete"], e["insert"])
                    anew += n
                for col, v in zip(out, (i.as_py(), t, now.pack(), before, now.n_tokens(), anew), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return state.select(id_col, "text", "tree", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(of, f"`{id_col}` long, text string, tree binary, n_tokens_before long, n_tokens long, n_encoded long")


def followed(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``trees`` and ``edited`` in one pass, for documents that come with their edits: ``(id_col, n_tokens_before, n_tokens, n_encoded, tree)``."""
    sc = docs.sparkSession.sparkContext
    data = read_ranks(path)
    sent = sc.broadcast((data, merge_table(parse_ranks(data))))
    names = [id_col, "n_tokens_before", "n_tokens", "n_encoded", "tree"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table = sent.value
        counter = Counter(Encoder(parse_ranks(ranks), pattern, table))
        for b in (part for batch in batches for part in portions(batch, 1)):
            texts, out = [t.as_py() or "" for t in b.column(1)], ([], [], [], [])
            for text, runs, edits in zip(texts, counter.runs(texts), b.column(2).to_pylist(), strict=True):
                tree, anew = Tree(*runs), 0
                out[0].append(tree.n_tokens())
                for e in edits or ():
                    text, tree, n = apply_edit(text, tree, counter, e["at"], e["delete"], e["insert"])
                    anew += n
                for col, v in zip(out[1:], (tree.n_tokens(), anew, tree.pack()), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)
            del texts, out
        del counter, ranks, table
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_t"), F.col(edits_col).cast(EDITS).alias("_e"))
    return rows.mapInArrow(of, f"`{id_col}` long, n_tokens_before long, n_tokens long, n_encoded long, tree binary")


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """Three edits of a document that its id decides: an insertion, a deletion and a replacement."""
    key, n = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.length(F.coalesce(F.col(text_col), F.lit("")))
    at = lambda i: F.pmod(F.crc32(F.concat(F.lit(f"{i}:"), key).cast("binary")), n + 1).cast("long")
    edit = lambda i, d, s: F.struct(at(i).alias("at"), F.lit(d).cast("long").alias("delete"), F.lit(s).alias("insert"))
    return F.array(edit(0, 0, " an inserted passage,\nof two lines "), edit(1, 40, ""), edit(2, 7, "it's 2024"))
