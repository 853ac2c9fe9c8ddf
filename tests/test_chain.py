import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from synblock.functions import sketches
from synblock.operators import orthogroups
from synblock.plans import riparian
from synblock.sources import tables


def slow_ward(at, clusters):
    """All pairs of clusters in every step; the cheapest merge, the first of equal ones, goes on."""
    groups = [[i] for i in np.argsort(at, kind="stable")]
    while len(groups) > clusters:
        cost = lambda p: len(groups[p[0]]) * len(groups[p[1]]) / (len(groups[p[0]]) + len(groups[p[1]])) * (np.mean(at[groups[p[0]]]) - np.mean(at[groups[p[1]]])) ** 2  # noqa: B023, E731
        a, b = min(combinations(range(len(groups)), 2), key=cost)
        groups[a] += groups.pop(b)
    out = np.zeros(len(at), int)
    for k, g in enumerate(sorted(groups, key=lambda g: np.mean(at[g])), 1):
        out[g] = k
    return out.tolist()


def test_ward_on_a_line_equals_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 40):
        for k in (1, 2, 5, n):
            at = rng.random(n)
            assert riparian.ward(at, min(k, n)).tolist() == slow_ward(at, min(k, n))
    assert riparian.ward(np.array([5.0, 1, 50, 51]), 2).tolist() == [1, 1, 2, 2]
    assert riparian.ward(np.array([0.0, 1, 2.2]), 2, np.array([1.0, 1, 100])).tolist() == [1, 1, 2]
    assert riparian.ward(np.zeros(0), 3).tolist() == []


def test_order_by_synteny(spark):
    rng = random.Random(5)
    genes, og = [], 0
    for c in range(6):  # chromosomes of G1 and G2 are pieces of G0's, in another order of names
        for i in range(40):
            og += 1
            genes.append(("G0", f"chr{c + 1}", c * 100 + i, f"OG{og}"))
            for g, names in (("G1", "FADBEC"), ("G2", "badcfe")):
                if rng.random() < 0.8:
                    genes.append((g, f"s{names[c]}{i // 20}", 1000 * ord(names[c]) + rng.randrange(300), f"OG{og}"))
    genes.append(("G1", "alone", 5, "OGx"))
    table = spark.createDataFrame(genes, "genome string, chr string, ord long, og string")
    chrs = table.select("genome", "chr").distinct().withColumns({"first": F.lit(1), "length": F.lit(100)})
    named = {r[:2]: r[2] for r in riparian.named_order(chrs).select("genome", "chr", "place").collect()}
    assert [c for (g, c), _ in sorted(named.items(), key=lambda x: x[1]) if g == "G0"] == [f"chr{i}" for i in range(1, 7)]

    def pairs(genome):
        ref = {o: (named["G0", c], r) for g, c, r, o in genes if g == "G0"}
        return sorted((*ref[o], r, c) for g, c, r, o in genes if g == genome and o in ref)

    for weight, clusters in ((0.5, 6), (0, 1), (1, 99)):
        got = {(r["genome"], r["chr"]): r["place"] for r in riparian.synteny_order(chrs, table, "G0", weight).collect()}
        for genome in ("G1", "G2"):
            p = pairs(genome)
            at = {c: float(np.median([(i + 1) / len(p) for i, x in enumerate(p) if x[3] == c])) for c in {x[3] for x in p}}
            names = sorted(at)
            group = slow_ward(np.array([at[c] for c in names]), min(clusters, len(names)))
            mean = {c: np.mean([at[x] for x, h in zip(names, group, strict=True) if h == g]) for c, g in zip(names, group, strict=True)}
            want = sorted((c for g, c in named if g == genome), key=lambda c: (c not in mean, round(mean.get(c, 0), 12), named[genome, c]))
            assert sorted((c for g, c in got if g == genome), key=lambda c: got[genome, c]) == want


BLOCK = "blkID string, genome1 string, chr1 string, startOrd1 long, endOrd1 long, genome2 string, chr2 string, startOrd2 long, endOrd2 long, orient string, nHits1 long"


def test_directions_follow_the_chain(spark):
    rows = [
        ("a", "A", "1", 1, 100, "B", "1", 100, 1, "-", 50), ("b", "A", "1", 101, 130, "B", "1", 101, 120, "+", 9), ("c", "A", "2", 1, 90, "B", "2", 1, 90, "+", 40),
        ("d", "B", "1", 1, 100, "C", "1", 1, 100, "+", 50), ("e", "B", "2", 1, 90, "C", "2", 90, 1, "-", 30), ("f", "A", "1", 1, 9, "C", "9", 1, 9, "-", 99),
    ]
    sides = riparian.both_ways(spark.createDataFrame(rows, BLOCK))
    steps = riparian.chained(sides, ["A", "B", "C"])
    turned = riparian.directions(steps, ["A", "B", "C"])
    assert sorted(map(tuple, turned.collect())) == [("B", "1"), ("C", "1"), ("C", "2")]
    own = riparian.lengths(sides)
    placed = riparian.chromosomes(riparian.named_order(own), "A", 0.01, 0.5, turned)
    ends = {r["blkID"]: r for r in riparian.stretches(steps, placed).collect()}
    assert sorted(ends) == ["a", "b", "c", "d", "e"]
    assert ends["a"]["a1"] < ends["a"]["b1"] and ends["a"]["a2"] < ends["a"]["b2"]  # no crossing once turned
    assert ends["d"]["a1"] > ends["d"]["b1"] and ends["d"]["a2"] > ends["d"]["b2"]
    at = {(r["genome"], r["chr"]): r for r in placed.collect()}
    for g in "ABC":
        lo, hi = min(r["x1"] for k, r in at.items() if k[0] == g), max(r["x2"] for k, r in at.items() if k[0] == g)
        assert lo + hi == pytest.approx(1)  # the first begins at 1, so genomes are centred up to that
    total = {g: sum(r["length"] for k, r in at.items() if k[0] == g) for g in "ABC"}
    count = {g: sum(k[0] == g for k in at) for g in "ABC"}
    for g in "ABC":
        assert at[g, "1"]["gap"] == pytest.approx(round(total["A"] * 0.01) + (max(total.values()) - total[g]) / count[g] * 0.5)
    assert at["A", "2"]["x1"] - at["A", "1"]["x2"] == pytest.approx(1 + at["A", "1"]["gap"])
    backwards = riparian.chained(sides, ["C", "B", "A"]).select("blkID", "genome1", "level").collect()
    assert sorted(map(tuple, backwards)) == [("a", "B", 2), ("b", "B", 2), ("c", "B", 2), ("d", "C", 1), ("e", "C", 1)]


def test_regions_are_carried_both_ways(spark):
    rows = [("a", "A", "1", 1, 101, "B", "1", 1, 201, "+", 50), ("b", "B", "1", 1, 101, "C", "1", 151, 51, "-", 50), ("c", "B", "1", 150, 300, "C", "2", 1, 151, "+", 9)]
    sides = riparian.both_ways(spark.createDataFrame(rows, BLOCK))
    regions = spark.createDataFrame([("r", "A", "1", 11, 61), ("m", "B", "1", 51, 101), ("far", "A", "1", 500, 600)], "name string, genome string, chr string, start long, end long")
    got = sorted(tuple(x or "" for x in r) for r in riparian.carried(regions, sides, ["A", "B", "C"]).select("name", "genome", "chr", "start", "end", "blkID").collect())
    want = [
        ("far", "A", "1", 500, 600, ""), ("m", "A", "1", 26, 51, "a"), ("m", "B", "1", 51, 101, ""), ("m", "C", "1", 51, 101, "b"),
        ("r", "A", "1", 11, 61, ""), ("r", "B", "1", 21, 121, "a"), ("r", "C", "1", 51, 131, "b"),
    ]
    assert got == want
    assert riparian.carried(regions.where("false"), sides, ["A", "B", "C"]).count() == 0


def test_scale_bar_is_round(spark):
    placed = spark.createDataFrame([("A", 4000, -50.0), ("A", 1200, 60.0), ("B", 9000, -70.0)], "genome string, length long, x1 double")
    assert tuple(riparian.scale_bar(placed).first()) == (2000.0, -50.0, 1950.0)
    assert tuple(riparian.scale_bar(placed.withColumn("length", F.col("length") * 10_000), "Bp").first()) == (20_000_000.0, -50.0, 19_999_950.0)


def test_colours_go_by_place(spark):
    ordered = spark.createDataFrame([("A", "x", 2), ("A", "y", 1), ("B", "z", 1)], "genome string, chr string, place long")
    assert [r["refChr"] for r in riparian.colours(ordered, "A").collect()] == ["y", "x"]


# Orthologues within regions


def slow_regions(hits, genes, selfhits, least):
    """The pairs of genes in one group, region by region."""
    length = dict(genes)
    by = {}
    for g1, g2, reg, a, b, score, anchor, rep in hits:
        if reg is not None and anchor and rep:
            by.setdefault((g1, g2), {}).setdefault(reg, []).append((a, b, score))
    out = set()
    for pair, regions in by.items():
        other = {r: h for r, h in regions.items() if not {x[0] for x in h} & {x[1] for x in h}}
        size = {r: (len({x[0] for x in h}), len({x[1] for x in h})) for r, h in other.items()}
        mean = {r: sum(s) / 2 for r, s in size.items()}
        if sum(map(len, other.values())) < 5 or sum(m for m in mean.values() if m >= least) < 0.5 * sum(mean.values()):
            continue
        for reg, h in other.items():
            if min(size[reg]) < least:
                continue
            sides = [{x[0] for x in h}, {x[1] for x in h}]
            edges = {"x": h}
            for k, side in enumerate(sides):
                best = {}
                for a, b, s in selfhits:
                    if a != b and a in side and b in side:
                        best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
                edges[k] = [(a, b, s) for (a, b), s in best.items()]
            scored = {}
            for kind, e in edges.items():
                pts = [(a, b, math.log10(length[a] * length[b]), math.log10(s)) for a, b, s in e]
                top = [(x, y) for a, _, x, y in pts if y == max(q[3] for q in pts if q[0] == a)]
                if not top:
                    scored[kind] = []
                    continue
                mx, my = (sum(t[i] for t in top) / len(top) for i in (0, 1))
                sxx = sum((x - mx) ** 2 for x, _ in top)
                slope = sum((x - mx) * (y - my) for x, y in top) / sxx if len({x for x, _ in top}) > 1 else 0
                scored[kind] = [(a, b, round(y - my - slope * (x - mx), 9)) for a, b, x, y in pts]
            x = scored["x"]
            cut = {}
            for a, b, s in x:
                if s == max(q[2] for q in x if q[0] == a) and s == max(q[2] for q in x if q[1] == b):
                    for g in (a, b):
                        cut[g] = min(s, cut.get(g, s))
            links = [(a, b) for e in scored.values() for a, b, s in e if (a in cut or b in cut) and s >= cut.get(a, s) and s >= cut.get(b, s)]
            label = {g: g for e in links for g in e}
            for a, b in links:
                new, old = sorted((label[a], label[b]))
                label = {g: new if v == old else v for g, v in label.items()}
            out |= {(*pair, a, b) for a, b, _ in h if a in label and label[a] == label.get(b)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_region_orthologues_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    hits, genes, own = [], {}, []
    for reg, size in (("r1", 14), ("r2", 9), ("r3", 3), ("selfish", 8), (None, 6)):
        left, right = [f"{reg}a{i}" for i in range(size)], [f"{reg}b{i}" for i in range(size)]
        genes |= {g: rng.randrange(50, 400) for g in left + right}
        for i in range(size):
            for j in {i, rng.randrange(size), rng.randrange(size)}:
                score = genes[left[i]] * genes[right[j]] / 200 * (1 if i == j else rng.uniform(0.2, 1.1))
                hits.append(("A", "B", reg, left[i], right[j], float(round(score + 30)), rng.random() < 0.95, rng.random() < 0.95))
        for side in (left, right):
            for _ in range(size):
                a, b = rng.sample(side, 2)
                own.append((a, b, float(rng.randrange(30, 900))))
    hits.append(("A", "B", "selfish", "selfisha0", "selfisha0", 50.0, True, True))
    hits += [("A", "C", "q", f"r1a{i}", f"c{i}", 80.0 + i, True, True) for i in range(4)]
    genes |= {f"c{i}": 100 for i in range(4)}
    rows = [(*h[:6], not h[6], h[7], True, rng.random() < 0.3) for h in {x[3:5]: x for x in hits}.values()]
    table = spark.createDataFrame(rows, "genome1 string, genome2 string, regID string, ofID1 string, ofID2 string, bitScore double, noAnchor boolean, isArrayRep1 boolean, isArrayRep2 boolean, sameOG boolean")
    g = spark.createDataFrame(list(genes.items()), "ofID string, pepLen long")
    s = spark.createDataFrame(own, "ofID1 string, ofID2 string, bitScore double")
    got = {(r["genome1"], r["genome2"], r["ofID1"], r["ofID2"]): r["sameOG"] for r in orthogroups.region_orthologues(table, g, s, 6, 5).collect()}
    found = slow_regions([(*r[:6], not r[6], r[7]) for r in rows], genes.items(), own, 6)
    assert got == {(r[0], r[1], r[3], r[4]): r[9] or (r[0], r[1], r[3], r[4]) in found for r in rows}
    assert 8 < len(found) < len(rows) - 10
    assert orthogroups.region_orthologues(table.limit(0), g, s).count() == 0
    few = orthogroups.region_orthologues(table, g, s, 40)  # no region is large enough
    assert few.where("sameOG").count() == sum(r[9] for r in rows)


# Names of chromosomes and sketches


def test_names_of_five_styles(spark):
    files = {
        "ncbi": (["NC_1.1 Zea mays chromosome 1, whole genome", "NC_2.1 Zea mays chromosome 2, whole genome", "NC_3.1 Zea mays chromosome X, whole"], ["1", "2", "X"]),
        "ensembl": (["1 dna:chromosome REF", "2 dna:chromosome REF", "MT dna REF"], ["1", "2", "MT"]),
        "plain": (["chr1", "chr2", "chrUn_1"], ["chr1", "chr2", "chrUn_1"]),
        "later": (["id1 sp chr7 x", "id2 sp chr8 x y"], ["chr7", "chr8"]),
        "none": (["scaf1 len=4 a", "scaf2 len=5 a"], ["scaf1 len=4 a", "scaf2 len=5 a"]),
        "repeated": (["s chromosome 1 a", "s chromosome 1 b"], ["s chromosome 1 a", "s chromosome 1 b"]),
        "lead": (["Chr01 ref", "Chr02 ref"], ["Chr01", "Chr02"]),
    }
    rows = [(f, h, i, w) for f, (headers, want) in files.items() for i, (h, w) in enumerate(zip(headers, want, strict=True))]
    got = tables.chromosome_names(spark.createDataFrame(rows, "file string, header string, n int, want string")).collect()
    assert len(got) == len(rows) and [(r["file"], r["chr"]) for r in got if r["chr"] != r["want"]] == []


def test_merged_sketches_are_within_their_error(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 30).alias("c"), (F.col("id") * 7919 % 9000).alias("v"))
    for parts in (["g", "c"], ["g"]):
        d = sketches.estimated(sketches.merge_distinct(sketches.distinct(rows, parts, "v"), ["g"])).collect()
        assert len(d) == 3 and all(abs(r["estimate"] - 3000) <= sketches.distinct_error() * 3000 for r in d)
        q = sketches.quantile(sketches.merge_quantiles(sketches.quantiles(rows, parts, "v"), ["g"]), 0.5, "q").collect()
        assert all(abs(r["q"] - 4500) <= 0.033 * 9000 for r in q)
    assert sketches.distinct(rows.where("false"), ["g"], "v").count() == 0
