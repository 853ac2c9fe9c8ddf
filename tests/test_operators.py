"""Small cases worked out by hand, and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from synblock.operators import blocks, chain, genes, graph, hits, intervals, pangenes, quantile, ranks, sequence, spatial, synteny
from synblock.plans import layout, query
from synblock.plans.params import Params, checked_integer, checked_number
from synblock.sources import newick, tables


def spans(spark, rows, schema="chr string, start long, end long"):
    return spark.createDataFrame([("c", *r) for r in rows], schema)


def sorted_rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_reduce_and_gaps(spark):
    df, length = spans(spark, [(1, 5), (6, 9), (11, 12)]), spark.createDataFrame([("c", 20)], "chr string, length long")
    assert sorted_rows(intervals.merged(df, ["chr"]), "start", "end") == [(1, 9), (11, 12)]
    assert sorted_rows(intervals.gaps(df, length, ["chr"]), "start", "end") == [(10, 10), (13, 20)]
    again = intervals.merged(intervals.merged(df, ["chr"]), ["chr"])
    assert sorted_rows(again, "start", "end") == [(1, 9), (11, 12)]


def test_classify(spark):
    length = spark.createDataFrame([("c", 20)], "chr string, length long")
    out = intervals.classify([("A", spans(spark, [(1, 10)])), ("B", spans(spark, [(5, 15)]))], length, ["chr"])
    assert sorted_rows(out, "start", "end", "class") == [(1, 10, "A"), (11, 15, "B"), (16, 20, "unknown")]


def test_windows_and_coverage(spark):
    length = spark.createDataFrame([("c", 10)], "chr string, length long")
    at = intervals.windows(length, ["chr"], 4, 2)
    out = sorted_rows(intervals.coverage(at, spans(spark, [(3, 5)]), ["chr"]), "start", "end", "bp")
    assert out == [(1, 4, 2), (3, 6, 3), (5, 8, 1), (7, 10, 0), (9, 10, 0)]


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(1)
    a = [(i, s, s + rng.randrange(30)) for i, s in enumerate(rng.randrange(1, 500) for _ in range(80))]
    b = [(i, s, s + rng.randrange(90)) for i, s in enumerate(rng.randrange(1, 500) for _ in range(40))]
    da = spark.createDataFrame([("c", *r) for r in a], "chr string, i long, s1 long, e1 long")
    db = spark.createDataFrame([("c", *r) for r in b], "chr string, j long, s2 long, e2 long")
    want = sorted((i, j) for i, s, e in a for j, t, f in b if s <= f and t <= e)
    for width in (7, 100, 10_000):
        assert sorted_rows(intervals.overlap_join(da, db, ["chr"], "s1", "e1", "s2", "e2", width), "i", "j") == want
    touching = intervals.overlap_join(spark.createDataFrame([("c", 1, 1, 5)], da.schema), spark.createDataFrame([("c", 1, 5, 9)], db.schema), ["chr"], "s1", "e1", "s2", "e2")
    assert touching.count() == 1


def test_runs_and_sessions(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", "b", "b", "a", None, None])], "g int, i int, v string")
    assert sorted_rows(ranks.run_lengths(df, ["g"], ["i"], "v", "run", "n"), "i", "run", "n") == [(0, 1, 2), (1, 1, 2), (2, 2, 2), (3, 2, 2), (4, 3, 1), (5, 4, 2), (6, 4, 2)]
    at = spark.createDataFrame([(1, x) for x in (1, 2, 30, 31)], "g int, x long")
    assert sorted_rows(ranks.gap_sessions(at, ["g"], "x", 25, "s"), "x", "s") == [(1, 1), (2, 1), (30, 2), (31, 2)]


def test_interpolation(spark):
    df = spark.createDataFrame([(1, x, y) for x, y in zip(range(1, 6), (10.0, None, None, 40.0, None), strict=True)], "g int, x long, y double")
    assert sorted_rows(spatial.interpolate(df, ["g"], "x", "y", "p").na.fill(-1.0), "x", "p") == [(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, -1.0)]


def brute_dbscan(x, y, eps, n):
    near = [[j for j in range(len(x)) if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= eps * eps] for i in range(len(x))]
    core = [len(v) >= n for v in near]
    root = list(range(len(x)))
    for _ in x:
        for i, v in enumerate(near):
            for j in v:
                if core[i] and core[j]:
                    root[i] = root[j] = min(root[i], root[j])
    return [min((root[j] for j in v if core[j]), default=None) for v in near]


def test_dbscan(spark):
    rng = random.Random(2)
    for eps, n in ((3, 4), (2.5, 2), (4, 1)):
        x, y = np.array([rng.randrange(30) for _ in range(90)], float), np.array([rng.randrange(30) for _ in range(90)], float)
        want = brute_dbscan(x, y, eps, n)
        names = {c: k + 1 for k, c in enumerate(sorted({w for w in want if w is not None}))}
        assert spatial.dbscan_kernel(x, y, eps, n).tolist() == [names.get(w, 0) for w in want]
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g int, k long, x double, y double")
    out = {r["k"]: r["cluster"] for r in spatial.dbscan(df, ["g"], "x", "y", eps, n, "k").collect()}
    assert [out[i] for i in range(90)] == want


def test_radius_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 0, True), (2, 3, 4, False), (3, 4, 4, False)], "k long, x long, y long, a boolean").withColumn("g", F.lit(1))
    assert sorted_rows(spatial.flag_in_radius(df, ["g"], "x", "y", "a", 5, ["k"]), "k", "in_radius") == [(1, True), (2, True), (3, False)]


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (None, 7), (8, 8)], "src long, dst long")
    assert sorted_rows(graph.connected_components(df), "node", "component") == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in graph.connected_components(path).collect()} == {0}
    assert graph.connected_components(df.limit(0)).collect() == []


def test_weighted_cuts(spark):
    rng = random.Random(3)
    rows = [(g, rng.getrandbits(61), rng.randrange(1, 9)) for g in range(3) for _ in range(400)] + [(3, 5, 10)] * 4
    df = spark.createDataFrame(rows, "g int, key long, w long")
    targets = {g: sum(w for h, _, w in rows if h == g) * share for g, share in enumerate((0.1, 0.5, 1.0, 0.4))}
    cuts = quantile.weighted_cuts(df, "g", "key", "w", targets)
    for g in range(3):
        assert abs(sum(w for h, k, w in rows if h == g and k < cuts[g]) - targets[g]) <= 4
    assert cuts[3] == 5


def test_chain_and_orientation(spark):
    x = np.array([1, 2, 3, 4, 5, 6, 20, 40, 60], float)
    y = np.array([11, 12, 13, 14, 15, 16, 90, 50, 70], float)
    assert chain.chains(x, y, 5, 5).tolist() == [1] * 6 + [0] * 3
    assert chain.chains(x, -y, 5, 5).tolist() == [1] * 6 + [0] * 3
    rows = [("b", "g1", "g2", "c1", "c2", f"a{i}", f"b{i}", 10 * i, 10 * i + 5, i, 100 - 10 * i, 105 - 10 * i, 9 - i) for i in range(6)]
    df = spark.createDataFrame(rows, "blkID string, genome1 string, genome2 string, chr1 string, chr2 string, ofID1 string, ofID2 string, start1 long, end1 long, ord1 long, start2 long, end2 long, ord2 long")
    b = blocks.coordinates(df).collect()[0]
    assert b["orient"] == "-" and b["startBp2"] > b["endBp2"] and b["firstGene2"] == "b0" and b["nHits1"] == 6
    turned = blocks.coordinates(hits.swapped(df)).collect()[0]
    assert turned["orient"] == "-" and turned["startOrd1"] == b["minOrd2"]


def gene_rows(spark):
    rows = [("G", "chr1", 1000 * i + 1, 1000 * i + 500, f"f{i:03d}", 100, f"OG{i}") for i in range(300)]
    for i, p in ((1, 5), (2, 9), (3, 7), (299, 4)):
        rows[i] = ("G", "chr1", 1000 * i + 1, 1000 * i + 500, f"f{i:03d}", p, "T")
    return spark.createDataFrame(rows, "genome string, chr string, start long, end long, ofID string, pepLen long, og string").withColumn("id", F.col("ofID"))


def test_arrays(spark):
    g = genes.gene_order(gene_rows(spark))
    a = genes.tandem_arrays(g, 100)
    t = {r["ofID"]: r["arrayID"] for r in a.where("og = 'T'").collect()}
    assert t["f001"] == t["f002"] == t["f003"] != t["f299"]
    reps = {r["ofID"] for r in genes.array_representatives(a).where("isArrayRep and og = 'T'").collect()}
    assert reps == {"f002", "f299"}


def test_copy_numbers(spark):
    df = spark.createDataFrame([("g1", "A"), ("g1", "A"), ("g2", "B"), ("g1", "B")], "genome string, og string")
    out = sorted_rows(query.copy_numbers(df, {"t": "og"}), "genome", "copyNumber", "nGenes", "nOgs", "percOGs")
    assert out == [("g1", 1, 1, 1, 50.0), ("g1", 2, 2, 1, 50.0), ("g2", 0, 0, 1, 50.0), ("g2", 1, 1, 1, 50.0)]


def test_synteny_of_collinear_genomes(spark):
    def genome(name, order):
        return [(name, "chr1", 1000 * i + 1, 1000 * i + 500, f"{name}_{k}", f"{name}_{k}", 100, f"OG{k}") for i, k in enumerate(order)]

    n = 120
    order = list(range(60)) + list(range(n - 1, 59, -1))  # the second half is inverted
    beds = spark.createDataFrame(genome("A", range(n)) + genome("B", order), "genome string, chr string, start long, end long, id string, ofID string, pepLen long, og string")
    table = genes.annotate(beds)
    raw = spark.createDataFrame([(f"A_{k}", f"B_{k}", 200.0) for k in range(n)] + [("A_3", "B_90", 50.0)], "ofID1 string, ofID2 string, bitScore double")
    found = synteny.synteny(hits.annotate(raw, None, table)).cache()
    assert found.where("isAnchor").count() >= 115
    by = blocks.coordinates(found.where("isAnchor")).collect()
    assert sorted(b["orient"] for b in by) == ["+", "-"]
    at = blocks.interpolated_positions(found, table)
    assert at.where("genome1 = 'A' and ofID1 = 'A_10'").collect()[0]["ord2"] == 11.0
    pan = pangenes.pangenes(table, at, "A")
    row = pan.where("ofID in ('A_10', 'B_10')").collect()
    assert len({r["pgID"] for r in row}) == 1 and {r["pgRepID"] for r in row} == {"A_10"} and {r["flag"] for r in row} == {"PASS"}
    wide = pangenes.wide(pan, ["A", "B"]).where("pgRepID = 'A_10'").collect()[0]
    assert wide["A"] == ["A_10"] and wide["B"] == ["B_10"]


def test_sequences(spark):
    s = spark.createDataFrame([("c", "NNACGTNNNACGTTTNN"), ("d", "ACAC")], "chr string, seq string")
    assert sorted_rows(sequence.kmer_hits(s, ["ACG"]), "chr", "start", "end") == [("c", 3, 5), ("c", 10, 12)]
    assert sorted_rows(sequence.kmer_hits(s, ["ACA", "CAC"]), "start", "kmer") == [(1, "ACA"), (2, "CAC")]
    assert ("c", 4) in sorted_rows(sequence.kmer_hits(s, ["CGA"], 1), "chr", "start")
    assert sorted_rows(sequence.runs_of(s, "N", 2), "start", "end") == [(1, 2), (7, 9), (16, 17)]
    assert sorted_rows(sequence.contigs(s, 2), "chr", "start", "end") == [("c", 3, 6), ("c", 10, 15), ("d", 1, 4)]
    assert sorted_rows(sequence.tiles(s, 4, 6), "name", "seq") == [("c:13_16", "TTTN"), ("c:1_4", "NNAC"), ("c:7_10", "NNNA"), ("d:1_4", "ACAC")]


def test_readers(spark, tmp_path):
    (tmp_path / "hs.bed").write_text("chr1\t0\t10\tg1\textra\nchr1\t20\t\tg2\n")
    assert sorted_rows(tables.read_bed(spark, str(tmp_path / "hs.bed")), "genome", "chr", "start", "end", "id") == [("hs", "chr1", 1, 10, "g1")]
    (tmp_path / "hs.fa").write_text(">g1 first\nMK\nV.\n>g2\nAC-\n")
    assert sorted_rows(tables.read_fasta(spark, str(tmp_path / "hs.fa")), "file", "id", "header", "seq") == [("hs", "g1", "g1 first", "MKV."), ("hs", "g2", "g2", "AC-")]
    assert sorted_rows(tables.count_records(spark, str(tmp_path / "hs.fa")), "n") == [(2,)]
    (tmp_path / "og.tsv").write_text("Orthogroup\ths\tmm\nOG1\tg1, g2\t\nOG2\tg3\tm1\n")
    assert sorted_rows(tables.read_orthogroups(spark, str(tmp_path / "og.tsv")), "og", "genome", "id") == [("OG1", "hs", "g1"), ("OG1", "hs", "g2"), ("OG2", "hs", "g3"), ("OG2", "mm", "m1")]
    assert len(tables.read_orthologues(spark, str(tmp_path / "og.tsv")).where("orthID = 'OG2'").collect()) == 1
    (tmp_path / "s.txt").write_text("0_12: geneA\n")
    assert sorted_rows(tables.read_sequence_ids(spark, str(tmp_path / "s.txt")), "ofID", "genomeNum", "geneNum", "id") == [("0_12", 0, 12, "geneA")]
    (tmp_path / "a.gff").write_text("#c\nchr1\tx\tgene\t5\t9\t.\t+\t.\tID=1;Name=N1;z=2\nchr1\tx\tmRNA\t5\t9\t.\t+\t.\tName=N2\n")
    assert sorted_rows(tables.read_gff(spark, str(tmp_path / "a.gff")), "chr", "start", "end", "id") == [("chr1", 5, 9, "N1")]
    df = spark.createDataFrame([("b", "A", "c1", "B", "c2", "x", None, 1.0, 2.5)], tables.POSITIONS)
    tables.write_table(df, str(tmp_path / "pos"), tables.POSITIONS)
    assert tables.read_table(spark, str(tmp_path / "pos"), tables.POSITIONS).collect() == df.collect()
    with pytest.raises(ValueError, match="malformed"):
        tables.read_table(spark, str(tmp_path / "pos"), tables.PANGENES)


def test_newick():
    assert newick.order("((a:1,b:2)x:1,c:3);", ["a", "b", "c"]) == ["c", "a", "b"]
    assert newick.order("(a,(b,c));", ["a", "b", "d"]) == ["a", "b", "d"]
    assert newick.order(None, ["a"]) == ["a"]


def test_params():
    with pytest.raises(ValueError):
        Params(("a", "a"))
    with pytest.raises(ValueError):
        Params((".a",))
    assert Params(("a", "b"), {"a": 2}).places == 16
    assert checked_integer("7", 1, 5, default=3) == 5 and checked_number("x", default=2.0) == 2.0


def test_colours():
    assert layout.colours(0) == [] and len(set(layout.colours(12))) == 12 and all(layout.are_colours(layout.colours(5)))
    assert layout.are_colours(["#FFFFFF", "red"]) == [True, False] and layout.with_alpha("#000000", 0.5) == "#00000080"


def test_long_sequences_are_scanned_once(spark):
    import time

    unit = "ACGTTGCANN" * 100 + "TTAGGG" + "N" * 7
    text = unit * (5_000_000 // len(unit))
    s = spark.createDataFrame([("x", text), ("y", "é" + text[:50] + "nN"), ("z", None), ("w", "")], "chr string, seq string")
    began = time.time()
    found = sequence.kmer_hits(s, ["TTAGGG"]).groupBy("chr").count().collect()
    assert {r["chr"]: r["count"] for r in found} == {"x": text.count("TTAGGG")}
    runs = sequence.runs_of(s, "N", 7).collect()
    assert len(runs) == text.count("N" * 7) and all(text[r["start"] - 1 : r["end"]] == "N" * 7 for r in runs[::100])
    assert sorted_rows(sequence.runs_of(s, "N", 3).where("chr = 'y'"), "start", "end") == [(50, 53)]
    tiles = sequence.tiles(s, 1_000, 500).where("chr = 'x'")
    assert tiles.count() == (len(text) - 1_000) // 500 + 1 and tiles.where("start = 4000001").first()["seq"] == text[4_000_000:4_001_000]
    assert time.time() - began < 60


def test_kmers_with_mismatches_equal_brute_force(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGTNacgt") for _ in range(2_000))
    s = spark.createDataFrame([(7, text)], "chr long, seq string")
    got = sorted((r["chr"], r["start"], r["kmer"]) for r in sequence.kmer_hits(s, ["ACGTA", "TTT"], 1, True).collect())
    words = {"ACGTA", "TACGT", "TTT", "AAA"}
    want = sorted((7, i + 1, w) for w in words for i in range(len(text) - len(w) + 1) if sum(a != b for a, b in zip(text[i : i + len(w)].upper(), w, strict=True)) <= 1)
    assert got == want


def test_reduce_in_bins_equals_a_sweep(spark):
    rng = random.Random(4)
    rows = [("c", a := rng.randrange(1, 4_000), a + rng.choice([0, 3, 20, 900])) for _ in range(300)]
    df = spark.createDataFrame(rows, "chr string, start long, `end` long")
    for gap in (1, 5):
        want, now = [], None
        for _, a, b in sorted(rows):
            if now and a - now[1] - 1 < gap:
                now = [now[0], max(now[1], b), now[2] + 1]
            else:
                want += [tuple(now)] if now else []
                now = [a, b, 1]
        want.append(tuple(now))
        for width in (50, 1_000_000):
            assert sorted((r["start"], r["end"], r["n"]) for r in intervals.reduce(df, ["chr"], gap, width=width).collect()) == want


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 360)]
    root = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in edges)}
