import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from synblock.llm import mixing, sharding, topk, warc


def documents(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "é", None, "hot", "hot", "hot"])
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "##", "délta", f"w{rng.randrange(200)}"]) for _ in range(rng.choice([0, 1, 5, 30, 200])))
        rows.append((i, rng.choice([None, text, text, text]), rng.choice(["en", "de", None]), source, 1, "clash"))
    rows += [(5, "same copy " * 50, "en", "hot", 1, "clash")] * 30 + [(1000 + i, "same copy " * 50, "en", "hot", 1, "clash") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, size string")


EMPTY = "doc_id long, text string, lang string, source string"


def test_mix_matches_sql(spark):
    docs = documents(spark)
    out = mixing.mix(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(mixing.ORACLE).df()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    sort = lambda d: d[key].sort_values(key).reset_index(drop=True)
    assert np.allclose(sort(out).to_numpy(float), sort(want).to_numpy(float))
    assert (out["taken"] <= 2 * out["size"]).all()
    rows = out.merge(docs.toPandas().drop_duplicates("doc_id")[["doc_id", "source"]], on="doc_id")
    for _, g in rows.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 31 * g["size"].max()  # 31 rows share an id, and one key
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert copies.count() >= (out["taken"] > 0).sum()
    assert mixing.mix(spark.createDataFrame([], EMPTY)).collect() == []


def test_mix_decides_rows_with_null_and_shared_ids_each(spark):
    text = lambda i: f"word{i} " * 160
    rows = [(None, text(i), "en", "s", "x") for i in range(200)] + [(7, text(i), "en", "t", "x") for i in range(200)] + [(8, "same " * 160, "en", "u", str(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy string").repartition(7)
    out = mixing.mix(docs.join(docs.sparkSession.range(1)).drop("id")).toPandas()
    for _, g in out.assign(source=out["doc_id"].map({7: "t", 8: "u"}).fillna("s")).groupby("source"):
        assert g["size"].sum() == 200 * 160 and abs(g["taken"].sum() - g["target"].iloc[0]) <= 160
    mixed = mixing.mixed(docs).toPandas()
    assert list(mixed.columns) == docs.columns
    assert (mixed["source"].value_counts() * 160).to_dict() == out.groupby(out["doc_id"].map({7: "t", 8: "u"}).fillna("s"))["taken"].sum().to_dict()


def test_targets():
    for sizes in ([("a", 10)], [("a", 100), ("b", 100), ("c", 100)], [("a", 0), ("b", 5)], [("a", 1), ("b", 1000), ("c", 3), ("d", 500)]):
        t = mixing.targets(sizes)
        assert math.isclose(sum(t), 1.5 * sum(s for _, s in sizes), abs_tol=1e-9) and all(x <= 2 * s + 1e-9 for x, (_, s) in zip(t, sizes, strict=True))
        w = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        free = [(x / v) for x, v, (_, s) in zip(t, w, sizes, strict=True) if x < 2 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-9


def test_shards(spark):
    docs = documents(spark, 3000, 2)
    out = sharding.kd_shards(docs, 24).toPandas()
    assert len(out) == docs.count() and set(out["shard"]) == set(range(24))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.35 * sizes.mean()  # texts of up to a kilobyte in shards of twenty
    plain = docs.toPandas()
    assert out["size"].sum() == sum(8 + len((t or "").encode()) for t in plain["text"])
    assert Counter(out["text_crc32"]) == Counter(zlib.crc32((t or "").encode()) for t in plain["text"])
    assert (out["law"] == "bytes").all() and out["grown_shard"].isna().all()
    assert sharding.kd_shards(spark.createDataFrame([], EMPTY)).collect() == []


def test_hot_group_is_cut(spark):
    rows = [(i, "copy " * 40, "en", "s") for i in range(3000)] + [(10000 + i, f"own text {i} " * 20, "de", "t") for i in range(2000)]
    out = sharding.kd_shards(spark.createDataFrame(rows, EMPTY), 8).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.min() < 1.1


def test_equal_rows_are_cut_too(spark):
    rows = [(5, "same " * 30, "en", "s")] * 900 + [(None, None, None, None)] * 300 + [(i, f"own {i} " * 20, "de", "t") for i in range(1800)]
    out = sharding.kd_shards(spark.createDataFrame(rows, EMPTY).repartition(5), 6).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(sizes) == 6 and sizes.max() / sizes.min() < 1.1


def test_values_that_begin_alike_have_places_of_their_own(spark):
    names = ["common_crawl_a", "common_crawl_b", "common_crawl_c", "common", "\x7f", "é", "", None]
    rows = [(i, f"text {i}", "en", names[i % 8]) for i in range(80)]
    got = {(r["source"], r["k1"] >> 32) for r in sharding.points(spark.createDataFrame(rows, EMPTY), "doc_id", "text", ("source",)).join(spark.createDataFrame(rows, EMPTY).select("doc_id", "source"), "doc_id").collect()}
    order = sorted((x for x in names if x is not None), key=lambda x: x.encode()) + [None]
    assert len(got) == 8 and [s for s, _ in sorted(got, key=lambda x: x[1])] == order


def slow_tree(points, shards, axes, tolerance=sharding.TOLERANCE):
    """The tree by sorting whole nodes: a shard for each point ``(size, keys, salt)``."""
    out, todo = {}, [(0, shards, list(range(len(points))))]
    names = []
    while todo:
        node, leaves, rows = todo.pop(0)
        if leaves == 1:
            names.append((node, rows))
            continue
        width = [max((points[r][1][a] for r in rows), default=0) - min((points[r][1][a] for r in rows), default=0) for a in range(axes)]
        axis = max(range(axes), key=lambda a: (width[a], -a))
        goal, weight = sum(points[r][0] for r in rows) * (leaves // 2) / leaves, defaultdict(int)

        def cut(sizes, goal):
            below = 0
            for key in sorted(sizes):
                if below + sizes[key] > goal:
                    return key + 1 if 2 * below + sizes[key] <= 2 * goal else key
                below += sizes[key]
            return 1 << 62

        for r in rows:
            weight[points[r][1][axis]] += points[r][0]
        at = cut(weight, goal)
        over = sum(w for k, w in weight.items() if k < at) - goal
        salt_at = 0
        if abs(over) > sum(weight.values()) / leaves * tolerance:
            some = [k for k in weight if (k < at if over > 0 else k >= at)]
            if some:
                at = max(some) if over > 0 else min(some)
                salts = defaultdict(int)
                for r in rows:
                    if points[r][1][axis] == at:
                        salts[points[r][2]] += points[r][0]
                salt_at = cut(salts, goal - sum(w for k, w in weight.items() if k < at))
        right = {r for r in rows if points[r][1][axis] > at or (points[r][1][axis] == at and points[r][2] >= salt_at)}
        todo += [(2 * node, leaves // 2, [r for r in rows if r not in right]), (2 * node + 1, leaves - leaves // 2, [r for r in rows if r in right])]
    return names


def test_shards_are_those_of_a_tree_made_by_sorting(spark):
    docs = documents(spark, 500, 8)
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in sharding.kd_shards(docs, 8).collect())
    found = sharding.points(docs, "doc_id", "text", ("source", "lang")).collect()
    leaves = slow_tree([(r["size"], (r["k0"], r["k1"], r["k2"]), r["salt"]) for r in found], 8, 3)
    want = Counter((found[r]["doc_id"], found[r]["size"], found[r]["text_crc32"], i) for i, (_, rows) in enumerate(sorted(leaves)) for r in rows)
    assert got == want


VECTORS = "vec_id long, embedding array<float>, label int, score int"


def test_top_k_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(6)], 0, 0) for i in range(300)]
    rows += [(300 + i, rows[40][1], 0, 0) for i in range(40)]  # ties
    rows += [(500, None, 0, 0), (501, [None] * 6, 0, 0), (520, [float("nan")] * 6, 0, 0), (540, [float("inf")] * 6, 0, 0), (560, [1.0, 2.0], 0, 0), (561, [1.0, -2.0], 0, 0), (None, rows[0][1], 0, 0), (7, rows[7][1], 0, 0)]
    out = topk.top_k(spark.createDataFrame(rows, VECTORS), shard=64).collect()
    sound = [(i, [math.floor(64 * np.float32(x).astype(float)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in {i: v for i, v in sound if i % 20 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))[:20]
        want[q] = [(i, -s) for s, i in best]
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == want
    assert topk.top_k(spark.createDataFrame([], VECTORS)).collect() == []
    few = topk.top_k(spark.createDataFrame(rows, VECTORS), shard=64, block=4).collect()  # a job per four queries
    assert sorted(few) == sorted(out)


def test_products_beyond_64_bits_are_exact(spark):
    wide = "vec_id long, embedding array<double>"
    rows = [(0, [1e10, 1e10, 1.0])] + [(i, [1e10, -1e10, float(i % 30)]) for i in range(1, 60)]
    got = topk.top_k(spark.createDataFrame(rows, wide), every=1000, k=5).orderBy("rank").collect()
    want = sorted(((sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(rows[0][1], v, strict=True)), -i) for i, v in rows[1:]), reverse=True)[:5]
    assert [(r["score"], -r["vec_id"]) for r in got] == want
    with pytest.raises(Exception, match="OverflowError|too large|too big"):
        topk.top_k(spark.createDataFrame([*rows, (70, [1e18, 1e18, 0.0])], wide), every=1000, k=5).collect()


PAGES = "page_id long, url string, html string, record_type string"


def test_warc_round_trip(spark, tmp_path):
    big, rows = "x" * 1500, []
    rows = [(i, f"http://e/{i}\r\n", big if i % 3 == 0 else f"<p>é {i}</p>" * (i + 1), "clash") for i in range(30)] + [(100, None, None, "c"), (101, "u", "", "c"), (102, "u", "y" * 999, "c"), (103, "u", "y" * 999, "c"), (27, "again", big, "c")]
    pages = spark.createDataFrame(rows, PAGES)
    got = sorted(tuple(r) for r in warc.round_trip(pages).collect())
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.execute(warc.ORACLE).fetchall())
    assert [(g[0], g[1], g[2], g[3], g[4]) for g in got] == [(w[0], w[2], w[1], w[3], w[4]) for w in want] or got == sorted((w[0], w[1], w[2], w[3], w[4]) for w in want)
    assert sum(g[3] == "revisit" for g in got) == 9
    assert warc.round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_source(spark, tmp_path, compression):
    path = str(tmp_path / compression)
    warc.register(spark)
    pages = spark.createDataFrame([(i, f"http://e/{i}", ("z" * 3000) if i < 5 else f"page {i}", "") for i in range(40)], PAGES)
    warc.records(pages).write.format("warc").option("compression", compression).mode("append").save(path)
    full = warc.read(spark, path)
    assert full.count() == 40
    assert {r["payload_bytes"] for r in full.collect() if r["record_type"] == "revisit"} == {3000}
    one = full.where("target_uri = 'http://e/7'").collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == b"page 7"
    bare = warc.read(spark, path, payload=False).where("record_type in ('revisit', 'response') and refers_to is null").collect()
    assert len(bare) == 36 and all(r["payload"] is None for r in bare)
    reader = warc._Reader(path, True)
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(kept) == 1
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 4


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "archive")
    page = lambda a, b: spark.createDataFrame([(i, f"u{i}", f"page {i}", "") for i in range(a, b)], PAGES)
    ids = lambda: sorted(r["target_uri"] for r in warc.read(spark, path).select("target_uri").collect())
    for a, b in ((0, 5), (5, 9), (9, 9)):
        warc.archive(page(a, b), path)
    assert ids() == [f"u{i}" for i in range(9)]
    warc.archive(page(20, 22), path, mode="overwrite")
    assert ids() == ["u20", "u21"] and sum(x.suffix == ".gz" for x in (tmp_path / "archive").iterdir()) <= 2
    warc.archive(page(30, 31), path)
    assert ids() == ["u20", "u21", "u30"]


def test_blocks_that_are_not_http_are_payloads(tmp_path):
    text = b"software: x\r\n\r\nformat: y"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(text)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head + text + b"\r\n\r\n" + warc.record("response", "i", "u", None, None, None, 2, b"hi"))
    for payload, want in ((True, [(len(text), text), (2, b"hi")]), (False, [(len(text), None), (2, None)])):
        reader = warc._Reader(str(tmp_path), payload)
        assert [r[-2:] for p in reader.partitions() for r in reader.read(p)] == want


def test_foreign_gzip_members(tmp_path):
    import gzip

    data = b"".join(gzip.compress(warc.record("response", f"id{i}", f"u{i}", None, None, None, 5, b"hello" * (1 + 9000 * (i % 2)))) for i in range(5))
    (tmp_path / "a.warc.gz").write_bytes(data)
    reader = warc._Reader(str(tmp_path), True)
    reader.wanted["record_id"] = {"id1", "id4"}
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == ["id1", "id4"] and len(rows[0][-1]) == 45005
