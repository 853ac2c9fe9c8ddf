"""Findings at larger sizes: the work is dealt out in whole arrays, on narrow rows, and results stay what they were."""

import random

import numpy as np
from pyspark.sql import functions as F
from synblock import scratch
from synblock.operators import blocks, hits, ranks, spatial, synteny
from synblock.operators.chain import chains
from synblock.sources import tables


def pairs_of_chromosomes(seed=3):
    """Two long pairs of chromosomes and many of a hit or a few."""
    rng = random.Random(seed)
    rows = [("A", "B", f"c{p}", f"d{p}", f"a{p}_{i}", f"b{p}_{i}", i, i + rng.randrange(3) if p else 400 - i) for p in range(2) for i in range(400) if rng.random() < 0.8]
    rows += [("A", "B", f"c{p % 40}", f"d{p}", f"a{p}_{i}", f"b{p}_{i}", i, i) for p in range(2, 600) for i in range(p % 7)]
    return rows


def test_chains_of_many_pairs_in_one_go(spark):
    rows = pairs_of_chromosomes()
    h = spark.createDataFrame(rows, "genome1 string, genome2 string, chr1 string, chr2 string, ofID1 string, ofID2 string, ord1 long, ord2 long").repartition(7)
    out = synteny.chains_of(h, 5, 5)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # a call for each pair of chromosomes
    want = {}
    for pair in {r[:4] for r in rows}:
        own = sorted((r for r in rows if r[:4] == pair), key=lambda r: (r[6], r[7]))
        found = chains(np.array([r[6] for r in own]), np.array([r[7] for r in own]), 5, 5)
        want |= {r: int(k) for r, k in zip(own, found, strict=True)}
    got = {tuple(r)[:8]: r.chain for r in out.collect()}
    assert got == want and sum(k > 0 for k in want.values()) > 600


def test_a_pair_larger_than_a_batch_is_whole(spark, monkeypatch):
    monkeypatch.setattr(synteny, "_ROWS", 16)
    rows = pairs_of_chromosomes(5)[:700]
    h = spark.createDataFrame(rows, "genome1 string, genome2 string, chr1 string, chr2 string, ofID1 string, ofID2 string, ord1 long, ord2 long").coalesce(1)
    a = synteny.chains_of(h, 5, 5).collect()
    monkeypatch.setattr(synteny, "_ROWS", 1 << 16)
    assert sorted(a) == sorted(synteny.chains_of(h, 5, 5).collect())


def test_synteny_keeps_one_table_and_hits_that_may_not_be_anchors(spark):
    rng = random.Random(8)
    names = "genome1 string, genome2 string, chr1 string, chr2 string, ofID1 string, ofID2 string, ord1 long, ord2 long, bitScore double, sameOG boolean, noAnchor boolean, isArrayRep1 boolean, isArrayRep2 boolean"
    rows = [("A", "B", "c", "d", f"a{i}", f"b{i}", i, i, 200.0, True, i % 9 == 0, True, i % 11 != 0) for i in range(200)]
    rows += [("A", "B", f"c{rng.randrange(50)}", f"d{rng.randrange(50)}", f"a{i}", f"b{i + 1}", i, i + 1, 90.0, True, True, True, True) for i in range(300)]
    hits = spark.createDataFrame(rows, names)
    with scratch.recording() as made:
        out = synteny.synteny(hits)
    assert [scratch.exists(spark, p) for p in made].count(True) == 1  # the steps' tables went
    found = spark.read.parquet(next(p for p in made if scratch.exists(spark, p)))
    got = out.collect()
    assert len(got) == 500 and found.count() == sum(r.isSyntenic for r in got) > 150
    assert not any(r.isSyntenic or r.isAnchor or r.blkID or r.regID for r in got if r.noAnchor or not r.isArrayRep2)


def test_few_pairs_are_listed_where_points_are_dense(monkeypatch):
    listed, whole = [], spatial.neighbour_lists

    def counted(*a):
        p, q = whole(*a)
        listed.append(len(p))
        return p, q

    monkeypatch.setattr(spatial, "neighbour_lists", counted)
    x = np.arange(3000.0)
    assert set(spatial.dbscan_kernel(x, x, 141.4, 5)) == {1} and sum(listed) < 60 * len(x)  # 201 pairs a point in all
    listed.clear()
    hit, nearest = synteny._near(x, x + 1, x, x, 141.4)
    assert hit.all() and nearest.tolist() == list(range(3000))  # as near to the next one
    assert sum(listed) < 60 * len(x)


def test_density_clusters_equal_brute_force():
    rng = np.random.default_rng(4)
    for eps in (3.0, 9.0, 40.0):
        for _ in range(15):
            n = int(rng.integers(1, 120))
            x, y = rng.integers(0, 150, n).astype(float), rng.integers(0, 150, n).astype(float)
            near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
            core = near.sum(1) >= 4
            label = np.where(core, np.arange(n), n)
            while True:
                new = np.where(core, np.where(near & core, label, n).min(1), n)
                if (new == label).all():
                    break
                label = new
            label = np.where(near & core, label, n).min(1)
            names = np.unique(label[label < n])
            assert spatial.dbscan_kernel(x, y, eps, 4).tolist() == np.where(label < n, np.searchsorted(names, label) + 1, 0).tolist()


def given_hits(spark):
    rows = [("A", "B", "c", "d", f"a{i % 30}", f"b{i % 17}", i % 30, i % 17, 10 * (i % 30), 10 * (i % 30) + 5, 10 * (i % 17), 10 * (i % 17) + 5, f"k{i % 3}", True, 1.0) for i in range(60)]
    return spark.createDataFrame(rows, "genome1 string, genome2 string, chr1 string, chr2 string, ofID1 string, ofID2 string, ord1 long, ord2 long, start1 long, end1 long, start2 long, end2 long, blkID string, isAnchor boolean, bitScore double")


def test_genes_of_a_block_are_counted_without_dealing_out_hits(spark):
    h = given_hits(spark)
    out = blocks.coordinates(h)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r.blkID: (r.n1, r.n2) for r in h.groupBy("blkID").agg(F.count_distinct("ofID1").alias("n1"), F.count_distinct("ofID2").alias("n2")).collect()}
    assert {r.blkID: (r.nHits1, r.nHits2) for r in out.collect()} == want


def test_ranks_of_pairs_are_those_of_genes(spark):
    genes = spark.createDataFrame([(g, f"{g}{i}", i, f"o{i * (3 + k) % 23}") for k, g in enumerate("ABC") for i in range(40 - 9 * k)], "genome string, ofID string, ord long, og string")
    a, b = (genes.select("og", *(F.col(c).alias(f"{c}{n}") for c in ("genome", "ofID", "ord"))) for n in (1, 2))
    pairs = a.join(b, "og").where("genome1 < genome2")
    want = ranks.dense_rank(ranks.dense_rank(pairs, ["genome1", "genome2"], "ord1", "r1"), ["genome1", "genome2"], "ord2", "r2").select("ofID1", "ofID2", "r1", "r2").collect()
    out = hits.ranked_pairs(genes).select("ofID1", "ofID2", "r1", "r2")
    assert "denserank" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(out.collect()) == sorted(want) and len(want) > 60


def test_small_blocks_go_before_phases_are_joined(spark):
    h = given_hits(spark).withColumn("blkID", F.when(F.col("ofID1") == "a3", F.concat(F.lit("alone"), "ofID2")).otherwise(F.col("blkID")))
    out = blocks.phased(h, "A", 5, 1e6).where("genome1 = 'A'").collect()
    assert {r.blkID for r in out} == {"k0_1", "k1_1", "k2_1"}


def test_compressed_csv_reads_the_same(spark, tmp_path):
    h = given_hits(spark)
    tables.write_csv(h, str(tmp_path / "t"), compress=True)
    assert list((tmp_path / "t").glob("*.csv.gz"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 60
