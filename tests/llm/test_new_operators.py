import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from synblock.llm import centroids, minhash, spelling

DOCS = "doc_id long, text string, lang string, row string, digest int, word int"


def slow_groups(rows):
    """Components over all pairs of full sets."""
    found = []
    for _, text, *_ in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        found.append({" ".join(words)} if len(words) == 1 else {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if found[i] and found[j] and 100 * len(found[i] & found[j]) >= 80 * len(found[i] | found[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    least = {}
    for at, (doc, *_) in zip(label, rows, strict=True):
        least[at] = doc if least.get(at) is None else least[at] if doc is None else min(doc, least[at])
    return [(doc, len(s), least[at], doc == least[at]) for (doc, *_), s, at in zip(rows, found, label, strict=True)]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def near_texts():
    rng = random.Random(3)
    rows, shared = [], [f"s{rng.randrange(900)}" for _ in range(30)]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 60]))] + (shared if rng.random() < 0.5 else [])
        for _ in range(14):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = f"Changed{rng.randrange(3)}"
            rows.append((rng.randrange(10_000), " \n".join(words), "en", "x", 1, 2))
    rows += [(7, None, None, None, None, None), (8, "", "en", None, None, None), (9, " \t\n", "en", None, None, None), (10, "One", "en", None, None, None), (11, "one", "en", None, None, None)]
    rows += [rows[0], (None, rows[0][1], "en", None, None, None), (None, "of no id", "en", None, None, None), (None, "of no id", "en", None, None, None), (rows[3][0], "same id other text", "en", None, None, None)]
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_minhash_groups_equal_brute_force(spark, block):
    rows = near_texts()
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), block=block).collect()
    assert sorted(map(key, out)) == sorted(map(key, slow_groups(rows)))
    assert list(out[0].asDict()) == ["doc_id", "n_shingles", "component_id", "kept"]


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, None, "x", "x", 0, 0), (None, "", "x", "x", 0, 0)]
    assert sorted(map(key, minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())) == sorted(map(key, [(1, 0, 1, True), (None, 0, None, True)]))


def test_long_texts_have_whole_sets():
    words = [f"w{i % 70_001}" for i in range(200_000)]
    assert len(minhash.shingle_hashes(" ".join(words).encode())) == len(set(zip(words, words[1:], strict=False)))


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(5)
    by, wrong = minhash.multipliers(), []
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 2_000
        both = round(2 * n * share / (1 + share))
        x, y = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64)
        y[:both] = x[:both]
        low = np.array([minhash.minima(x, by), minhash.minima(y, by)])
        planes = minhash.bit_planes(low)
        direct = int(((low[0] & np.uint64(15)) == (low[1] & np.uint64(15))).sum())
        row = spark.createDataFrame([(planes[0].tolist(), planes[1].tolist())], "a array<long>, b array<long>")
        from pyspark.sql import functions as F

        assert row.select(minhash.agreeing(F.col("a"), F.col("b"))).first()[0] == direct
        wrong.append(abs((direct / minhash.HASHES - 1 / 16) / (15 / 16) - share))
        assert (direct >= minhash.least_agreeing()) == (share >= 0.7)
    assert max(wrong) < 0.09


def test_odd_sketches_lose_no_link():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30, 300, 3_000):
        for share in (0.5, 0.75, 0.79, 0.8, 0.81, 1.0):
            for m in (n, round(0.9 * n) or 1):
                both = min(m, round((n + m) * share / (1 + share)))
                x, y = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, m, dtype=np.uint64)
                y[:both] = x[:both]
                a, b = minhash.odd_sketch(np.sort(x)), minhash.odd_sketch(np.sort(y))
                assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= n + m - 2 * both
                kept = minhash.near_enough(np.array([n]), np.array([m]), a[None, :], b[None, :])[0]
                linked = 100 * both >= 80 * (n + m - both)
                assert kept or not linked
                assert not kept or linked or n not in (30, 300) or share > 0.75


def test_few_pairs_below_the_threshold_are_candidates(spark, monkeypatch):
    rng, base = random.Random(17), [f"w{i}" for i in range(151)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in range(i % 7, 151, 25):
            words[min(150, at + rng.randrange(3))] = f"own{i}x{at}"
        rows.append((i, " ".join(words), "en", "x", 1, 2))
    counts, confirmed = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *a, **b: (counts.append(pairs.count()), confirmed(pairs, *a, **b))[1])
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(key, out)) == sorted(map(key, slow_groups(rows)))
    assert sum(counts) < 300  # of 1,770 pairs, most of which are alike by more than 0.69


def slow_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(float(v) * 256)) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [x for _, x in first]
    x = np.array([v for _, v in kept], object).reshape(-1, 64)
    for at in range(rounds + 1):
        d = [[int(((v - np.array(m, object)) ** 2).sum()) for m in c] for v in x]
        near = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if at < rounds:
            for j in range(len(c)):
                own = [v for v, a in zip(x, near, strict=True) if a == j]
                c[j] = [int(sum(col)) // len(own) for col in zip(*own, strict=True)] if own else c[j]
    dist = [row[a] for row, a in zip(d, near, strict=True)]
    inertia = Counter()
    for a, s in zip(near, dist, strict=True):
        inertia[a] += s
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, a, s, inertia[a], sum(dist), sha[a]) for (i, _), a, s in zip(kept, near, dist, strict=True)]


VECTORS = "vec_id long, embedding array<double>, cluster string, x int"


def vectors(n=400, scale=1.0):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (9, 64))
    rows = [(i, (scale * (centres[rng.integers(9)] + rng.normal(0, rng.choice([0.05, 0.6]), 64))).tolist()) for i in range(n)]
    return rows + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_clusters_equal_brute_force(spark, scale):
    rows = vectors(400 if scale == 1 else 90, scale)
    bad = [(900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], VECTORS).repartition(5)
    assert sorted(map(key, centroids.clustered(table).collect())) == sorted(map(key, slow_clusters(rows)))


def test_few_equal_or_no_vectors(spark):
    for rows in ([], [(1, [0.25] * 64)], [(i, [0.25] * 64) for i in range(50)], [(i, [float(i)] * 64) for i in range(7)]):
        table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
        assert sorted(map(key, centroids.clustered(table).collect())) == sorted(map(key, slow_clusters(rows)))


def test_bounds_are_safe_and_below_the_way():
    rng = np.random.default_rng(2)
    tighter = 0
    for _ in range(200):
        dim = int(rng.integers(2, 9))
        before, x = rng.normal(0, 10, (6, dim)), rng.normal(0, 1, (300, dim))
        after, radius = before + rng.normal(0, rng.choice([0.1, 3, 20]), (6, dim)), rng.choice([0.01, 1, 30], 6)
        most = centroids.gains(before, after, radius)
        way = np.linalg.norm(after - before, axis=1)
        assert (most <= way + 1e-9).all()
        tighter += (most < 0.9 * way).sum()
        for i in range(6):
            inside = before[i] + x / np.linalg.norm(x, axis=1)[:, None] * radius[i] * rng.random((300, 1)) ** 0.2
            gain = np.linalg.norm(inside[:, None] - before[None], axis=2) - np.linalg.norm(inside[:, None] - after[None], axis=2)
            assert (gain <= most[i] + 1e-9).all()
    assert tighter > 1000


def test_bounds_spare_scans(spark):
    rows = [(*r, "x", 1) for r in vectors(400)]
    state, _ = centroids.cluster(spark.createDataFrame(rows, VECTORS), rounds=4, k=9)
    assert state.where("not scanned").count() > 200


def slow_words(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_variants(rows):
    n = slow_words(rows)
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and edit_distance(v, w) == 1] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


@pytest.mark.parametrize("block", [4, 256])
def test_variants_equal_brute_force(spark, block):
    rng = random.Random(9)
    base = ["aaaaa", "abcabc", "Straße", "naïveté", "intern", "interna", "international", "überall", "aaaaaa", "banana", "ÉTUDES", "x×y÷zz"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.choice([0, 4, 30])):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "b", "é"]) + w[at + rng.choice([0, 1]) :]
            words.append(w)
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "1"]).join(words), "en", "x", 1, 2))
    rows += [(1, None, "en", "x", 1, 2), (2, "", "en", "x", 1, 2), rows[5]]
    rows += [(i, "kettendab " + "kettendax " * (i % 3 == 0) + "kettenday " * (i % 9 == 0) + "kettendyy " * (i % 18 == 0), "en", "x", 1, 2) for i in range(100)]
    rows += [(i, "kettndyy", "en", "x", 1, 2) for i in range(3)]
    out = spelling.variants(spark.createDataFrame(rows, DOCS), block=block).collect()
    want = slow_variants(rows)
    assert sorted(map(key, out)) == sorted(map(key, want))
    assert len(want) > 100 and any(r[1] and r[2] != r[1] for r in want)
    assert list(out[0].asDict()) == ["word", "form", "root", "n", "n_near", "form_n"]


def test_no_words_no_variants(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "word abc", "x", "x", 1, 1)], DOCS)).collect() == []


def test_tiles_of_other_alphabets():
    texts = ["日本語学", "日本学", "日本語文", "語日本学"]
    codes, all_of = spelling.Codes(texts), np.arange(4)
    hit = [[spelling.one_edit(codes, all_of[:, None], all_of[None, :], longer, False) for longer in (3, 4)]]
    assert {(int(a), int(b)) for found in hit[0] for a, b in zip(*np.nonzero(found), strict=True)} == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 3), (3, 1)}
