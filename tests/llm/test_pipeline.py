import random

import corpus_pipeline as P


def test_stages_over_a_small_corpus(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "of", "and", "to", "in", "is"] + [f"{chr(97 + i % 26)}ord{i}" for i in range(200)]
    make = lambda: " ".join(rng.choice(words[:6] if rng.random() < 0.3 else words) for _ in range(100)) + "."
    texts = [make() for _ in range(80)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "src1", 1) for i in range(10)]  # copies
    rows += [(200 + i, " ".join(f"{w}###" for w in make().split()), "en", "src2", 1) for i in range(15)]  # junk
    rows += [(300, None, None, None, None), (301, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        docs.write.parquet(out := str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(out)
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert sorted(seen["quality rules"]) == sorted([*range(80), *range(100, 110)])
    assert sorted(seen["SimHash near-dedup"]) == list(range(80))
    assert set(seen["mixing sources"]) <= set(range(80)) and max(seen["mixing sources"].count(i) for i in range(80)) <= 2
    assert len(seen["BPE encoding and decoding"]) == len(seen["mixing sources"])
    assert sorted(r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()) == sorted(seen["mixing sources"])


def test_near_dedup_keeps_rows_with_null_and_shared_ids(spark, tmp_path):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, e), (0, e), (None, e), (3, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (1, c), (1, d), (0, e)], key=str)
