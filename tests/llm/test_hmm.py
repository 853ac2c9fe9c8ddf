import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from synblock.llm import hmm
from test_tables import EMPTY, documents


def test_hmm_base_and_normalisation(spark):
    docs = documents(spark, 300, 3)
    kw = dict(states=3, rounds=3, symbols=20, dictionary=40)
    out = hmm.score(docs, **kw).toPandas()
    plain = docs.toPandas()
    assert len(out) == len(plain)
    tokens = [hmm.words_of((t or "").encode()) + [b""] for t in plain["text"]]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in plain["doc_id"]]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, h, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, h, ws in zip(plain["doc_id"], held, tokens, strict=True))
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.itertuples())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], atol=1e-5)
    assert (out["score"] <= 0).all() and np.isfinite(out["score"]).all()
    assert hmm.score(docs.limit(0)).collect() == []


def norm(a, axis):
    return a / a.sum(axis=axis, keepdims=True)


def random_model(states, symbols, seed=0):
    rng = np.random.default_rng(seed)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def slow_expected(m, texts):
    """Forward and backward, a token at a time."""
    counts, moves, begins, total = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start), 0.0
    for x in texts:
        alphas, scales, a = [], [], m.start
        for t, w in enumerate(x):
            a = (a if t == 0 else a @ m.move) * m.emit[w]
            scales.append(a.sum())
            a = a / a.sum()
            alphas.append(a)
        total += float(np.log(scales).sum())
        b = np.ones_like(m.start)
        for t in range(len(x) - 1, -1, -1):
            counts[x[t]] += alphas[t] * b
            ahead = m.emit[x[t]] * b / scales[t]
            if t == 0:
                begins += alphas[0] * b
            else:
                moves += np.outer(alphas[t - 1], ahead) * m.move
            b = m.move @ ahead
    return counts, moves, begins, total


def fast_expected(m, texts, size):
    counts, moves, begins, total = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start), 0.0
    p = hmm.pieces(m, texts, size)
    for some in p.batches(500):
        total += hmm.expected(m, p, some, counts, moves, begins)
    return counts, moves, begins, total


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_pieces_change_no_expected_count(size):
    rng, m = np.random.default_rng(2), random_model(3, 9)
    texts = [rng.integers(0, 9, n) for n in (1, 7, 8, 14, 300, 5, 64, 10_000)]
    for got, want in zip(fast_expected(m, texts, size), slow_expected(m, texts), strict=True):
        assert np.allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("size", [3, 100_000])
def test_hmm_forward_is_exact(size):
    m, rng = random_model(3, 7), np.random.default_rng(0)
    seqs = [rng.integers(0, 7, n) for n in (1, 2, 5, 40, 300)]
    for s, got in zip(seqs, hmm.log10_likelihoods(m, seqs, size), strict=True):
        a, total = m.start * m.emit[s[0]], 0.0
        for x in s[1:]:
            total += math.log10(a.sum())
            a = (a / a.sum()) @ m.move * m.emit[x]
        assert math.isclose(got, total + math.log10(a.sum()), rel_tol=1e-9)


def test_baum_welch_raises_likelihood_and_beats_unigrams():
    rng = np.random.default_rng(1)
    docs = [np.concatenate([rng.integers(0, 10, 40), rng.integers(10, 20, 40)]) if i % 2 else rng.integers(0, 10, 60) for i in range(120)]
    mass = np.bincount(np.concatenate(docs), minlength=20).astype(float)
    m, last = hmm.first_model(mass, 4), -np.inf
    for _ in range(8):
        counts, moves, begins, total = fast_expected(m, docs, 32)
        assert total >= last - 1e-6
        last = total
        assert math.isclose(counts.sum(), sum(map(len, docs)), rel_tol=1e-9)
        m = hmm.Model(norm(begins, 0), norm(moves, 1), norm(counts, 0))
    assert last > sum(np.log(mass[d] / mass.sum()).sum() for d in docs) + 100


def slow_scores(docs, states, rounds):
    """The whole operator over a small corpus in one place, with dictionaries and loops."""
    tokens = [hmm.words_of((t or "").encode()) + [hmm.END] for t in docs["text"]]
    train = [x for x, i in zip(tokens, docs["doc_id"], strict=True) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for x in train for w in x)
    words, share = sorted(c), np.zeros(hmm.CLASSES)
    place = {w: i for i, w in enumerate(words)}
    for w in words:
        if c[w] == 1 and w:
            share[hmm.class_of(w)] += 1
    mass = np.concatenate([[c[w] for w in words], share, [0.0]])
    hashes = np.concatenate([np.array([hmm.hash_of(w) for w in words], np.uint64), np.arange(hmm.CLASSES + 1, dtype=np.uint64)])
    m = hmm.first_model(mass, states, hashes)
    back = 20 / (mass.sum() + hmm.ADD * len(mass))
    number = lambda x: np.array([place.get(w, len(words) + hmm.class_of(w)) for w in x])
    for _ in range(rounds):
        counts, moves, begins, _ = slow_expected(m, [number(x) for x in train])
        for w in words:
            if c[w] == 1:
                counts[len(words) + hmm.class_of(w)] += counts[place[w]]
        counts += back * (mass + hmm.ADD)[:, None]
        m = hmm.Model(norm(begins + 1, 0), norm(moves + 1, 1), norm(counts, 0))
    return [slow_expected(m, [number(x)])[3] / math.log(10) for x in tokens]


@pytest.mark.parametrize(("symbols", "dictionary"), [(20, 40), (60_000, 400_000)])
def test_training_equals_a_slow_baum_welch(spark, symbols, dictionary):
    docs = documents(spark, 120, 5).drop("size").unionByName(spark.createDataFrame([(2000, " ".join(f"long{i * i % 311} again" for i in range(5_000)), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int"))
    got = hmm.score(docs, states=3, rounds=3, symbols=symbols, dictionary=dictionary).toPandas().sort_values(["doc_id", "score"])
    plain = docs.toPandas()
    plain["score"] = slow_scores(plain, 3, 3)
    assert np.allclose(got["score"], plain.sort_values(["doc_id", "score"])["score"], rtol=1e-4)


def test_hmm_scores_do_not_depend_on_where_counts_lie(spark):
    docs = documents(spark, 300, 3)
    few, many = (hmm.score(docs, states=3, rounds=3, symbols=s, dictionary=d).toPandas().sort_values(["doc_id", "score"]) for s, d in ((20, 40), (60_000, 400_000)))
    assert np.allclose(few["score"], many["score"], rtol=1e-5) and (few["n_known"].to_numpy() == many["n_known"].to_numpy()).all()


def test_hmm_without_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    out = hmm.score(spark.createDataFrame([(i, f"some words {i}", "en", "s") for i in held], EMPTY), states=3).toPandas()
    assert len(out) == len(held) and (out["base_score"] == 0).all() and np.isfinite(out["score"]).all()


def test_words_are_split_as_in_bytes():
    texts = pa.array([b"\xff A b\x0b\x1cc\xc3\x89 ", b"", None, b" \n\t ", b"\xc2\x85x \xe3\x80\x80 Y", b"\x00 x\x00 Q\x0c\rq"], pa.binary())
    for at, n in ((0, 6), (1, 2), (3, 3), (2, 0)):
        flat, sizes = hmm.words_in(texts.slice(at, n))
        want = [hmm.words_of(t.as_py()) for t in texts.slice(at, n)]
        assert flat.to_pylist() == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
        assert hmm.listed(flat) == flat.to_pylist() and hmm.joined(flat) == b"\n".join(flat.to_pylist())


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_only_middle_pieces_take_a_matrix(kind, monkeypatch):
    rng, m, rows = np.random.default_rng(4), random_model(3, 9), []
    texts = [rng.integers(0, 9, n) for n in (300, 5, 64, 65, 128, 129, 1_000)]
    slow = slow_expected(m, texts)
    m.emit = m.emit.astype(kind)
    whole = hmm.transfers

    def spied(model, p, some):
        out = whole(model, p, some)
        rows.append((len(out), out.shape[1]))
        return out

    monkeypatch.setattr(hmm, "transfers", spied)
    for got, want in zip(fast_expected(m, texts, 64), slow, strict=True):
        assert np.allclose(got, want, rtol=1e-9 if kind == np.float64 else 1e-4)
    assert sum(n for n, k in rows if k == 3) == 3 + 1 + 14  # it was all 28 pieces of cut texts
    assert sum(n for n, k in rows if k == 1) == 5


def test_numbers_of_rare_words_rise_and_take_little_room(spark):
    docs = documents(spark, 300, 3)
    rows = hmm.encoded(docs, 2, dictionary=2_000).cache()
    known = hmm.vocabulary(rows).cache()
    lex = hmm.lexicon(known, 3, 20)
    names = {r.bucket: bytes(r.words).split(b"\n") for r in known.collect()}
    lists = {(r.portion, r.bucket): bytes(r.words).split(b"\n") for r in rows.where("bucket is not null").collect()}
    found, some = hmm.placed(rows, known, lex, 3).collect(), 0
    assert len(found) == len(lists) > 2
    for r in found:
        at, code, words = hmm.from_rising(bytes(r.at)), np.frombuffer(r.code, "<i4"), lists[r.portion, r.bucket]
        assert (np.diff(at) > 0).all() and sorted(-1 - code[code < 0]) == list(range(len(at)))
        assert all(names[r.bucket][at[-1 - c]] == w for c, w in zip(code.tolist(), words, strict=True) if c < 0)
        assert len(zlib.compress(r.at, 1)) < 2 * len(at) + 40
        some += len(at)
    assert some > 500
