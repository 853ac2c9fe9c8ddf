import random
from itertools import combinations

import numpy as np
import xxhash
from synblock.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, node long"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in combinations(fps, 2):
            if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_masks_cover_all_triples():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for bits in combinations(range(64), 3):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 500):
        text = " \n\t".join(rng.choice(["A", "b", "Ünï", "日本", "cc"]) for _ in range(n))
        assert simhash.simhash(text.encode()) == slow_fingerprint(text)
    assert simhash.simhash(None) == 0
    long = ("x y z w " * 60000).encode()
    assert simhash.simhash(long) == slow_fingerprint(long.decode())


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(60)] = "changed"
        rows.append((i, " ".join(words), "en", "x", 1))
    rows += [(150, None, None, None, None), (151, "", "en", None, None), (152, " \n", "en", None, None), (0, rows[0][1], "en", None, None), (None, "null id", "en", None, None)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=4).collect()
    assert len(out) == len(rows)
    fps = [(i, slow_fingerprint(t)) for i, t, *_ in rows if i is not None]
    want = slow_components(fps)
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["fingerprint"] == f"{dict(fps)[r['doc_id']]:016x}"
    assert {r["component_id"] for r in out if r["doc_id"] in (150, 151, 152)} == {150}


def test_blocks_lose_no_link(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(300)})
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(signed, "node long, fp long"), block=16).collect()
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        for e in edges:
            label[e["src"]] = label[e["dst"]] = min(label[e["src"]], label[e["dst"]])
    assert {i: int(x) for i, x in enumerate(label)} == slow_components(list(enumerate(fps)))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_ids_are_linked(spark):
    rng = random.Random(4)
    while True:  # two texts within three bits, but not alike
        words = [f"w{rng.randrange(500)}" for _ in range(400)]
        texts = [" ".join(words), " ".join([*words[:-1], "changed"])]
        if 0 < (slow_fingerprint(texts[0]) ^ slow_fingerprint(texts[1])).bit_count() <= 3:
            break
    rows = [(None, texts[0], "en", None, None), (7, texts[1], "en", None, None), (None, "alone", "en", None, None)]
    out = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(None, f"{slow_fingerprint(texts[0]):016x}"): 7, (7, f"{slow_fingerprint(texts[1]):016x}"): 7, (None, f"{slow_fingerprint('alone'):016x}"): None}


def test_marked_rows_are_those_of_the_join(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(0, 90_000, 1, 3).withColumn(simhash.ROW, F.monotonically_increasing_id())
    rows.write.parquet(path := str(tmp_path / "rows"))
    rows = spark.read.parquet(path)
    for kept in (rows.where("id % 7 in (0, 3) or id in (0, 32767, 32768, 89999)"), rows.where("false"), rows):
        want = sorted(r["id"] for r in kept.collect())
        for most in (simhash.MAPS, 0):
            out = simhash.marked(rows, kept.select(simhash.ROW), most=most)
            assert out.columns == rows.columns and sorted(r["id"] for r in out.collect()) == want
