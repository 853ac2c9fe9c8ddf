"""Synteny as table operations against the search with a whole pair in one place, and a run that is taken up again."""

import random
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from slow_synteny import slow_synteny  # noqa: E402
from synblock.operators import synteny  # noqa: E402
from synblock.plans.params import Params  # noqa: E402
from synblock.plans.run import run  # noqa: E402
from synblock.sources import tables  # noqa: E402


def made_up_hits(seed, genomes=("A", "B", "C"), n=260, own=True):
    """Genomes with inversions, moved ends, doubled stretches and hits of no meaning."""
    rng = random.Random(seed)
    base = list(range(n))
    place = {}
    for i, g in enumerate(genomes):
        order = base[:]
        if i == 1:
            order[60:140] = order[60:140][::-1]
        if i == 2:
            order = order[200:] + order[:200]
        order = [x for x in order if rng.random() > 0.08]
        if i == 0:
            order += order[20:90]  # a stretch twice
        place[g] = [(f"chr{1 + k * 3 // len(order)}", k + 1, og, f"{g}{k}") for k, og in enumerate(order)]
    rows = []
    for i, a in enumerate(genomes):
        for b in genomes[i:] if own else genomes[i + 1 :]:
            for ca, ka, oa, ia in place[a]:
                for cb, kb, ob, ib in place[b]:
                    if oa == ob or rng.random() < 0.002:
                        rows.append((a, b, ca, cb, ia, ib, ka, kb, float(rng.choice([90, 95, 200, 200, 400])), oa == ob, rng.random() < 0.03, rng.random() > 0.05, True))
    names = "genome1 genome2 chr1 chr2 ofID1 ofID2 ord1 ord2 bitScore sameOG noAnchor isArrayRep1 isArrayRep2".split()
    return pd.DataFrame(rows, columns=names)


def as_set(df):
    cols = ["genome1", "genome2", "ofID1", "ofID2", "isAnchor", "isSyntenic", "blkID", "regID"]
    return sorted(tuple(None if x is None or x != x else x for x in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize(
    ("seed", "base", "ploidy", "second"),
    [
        (1, synteny.Settings(buffer=30), {}, None),
        (2, synteny.Settings(buffer=20, block_radius=10), {"A": 2}, synteny.Settings(only_og=False, n_gaps=10, buffer=20)),
        (3, synteny.Settings(only_og=False, buffer=20, same_chromosomes=True), {}, None),
    ],
)
def test_synteny_by_tables_equals_a_whole_pair_search(spark, seed, base, ploidy, second):
    df = made_up_hits(seed)
    want = as_set(slow_synteny(df, base, ploidy, second))
    got = as_set(synteny.synteny(spark.createDataFrame(df).repartition(5), base, ploidy, second).toPandas())
    assert sum(r[4] for r in want) > 300
    assert got == want


def test_nothing_to_find(spark):
    df = made_up_hits(4, n=30).head(3)
    assert as_set(synteny.synteny(spark.createDataFrame(df)).toPandas()) == as_set(slow_synteny(df, synteny.Settings(), {}, None))
    assert synteny.synteny(spark.createDataFrame(df).limit(0)).collect() == []


def test_a_run_is_taken_up_where_it_stopped(spark, tmp_path):
    rng = random.Random(6)
    rows = [(g, f"chr{1 + k // 40}", k * 1000 + 1, k * 1000 + 500, f"{g}{k}", f"{g}{k}", 100 + rng.randrange(50), f"OG{k}") for g in ("A", "B") for k in range(80)]
    beds = spark.createDataFrame(rows, "genome string, chr string, start long, `end` long, id string, ofID string, pepLen long, og string")
    forward = spark.createDataFrame([(f"A{k}", f"B{k}", 300.0) for k in range(80)], "ofID1 string, ofID2 string, bitScore double")
    folder = str(tmp_path / "run")
    first = run(Params(("A", "B")), beds, forward, references=("A",), folder=folder)
    kept = {p.name: p.stat().st_mtime for p in Path(folder).iterdir()}
    assert {"annotated", "hits", "genes", "positions", "blocks", "regions", "blocks_csv", "regions_csv", "pangenes", "parameters"} <= set(kept)
    again = run(Params(("A", "B")), beds.limit(0), forward.limit(0), references=("A",), folder=folder)
    assert {p.name: p.stat().st_mtime for p in Path(folder).iterdir()} == kept
    assert again.blocks.count() == first.blocks.count() > 0 and again.pangenes["A"].count() == first.pangenes["A"].count() == 160
    assert spark.read.csv(f"{folder}/blocks_csv", header=True).count() == first.blocks.count()
    with pytest.raises(ValueError, match="other parameters"):
        run(Params(("A", "B"), buffer=50), beds, forward, folder=folder)


def test_regions_on_unknown_chromosomes_are_refused(spark):
    from synblock.plans import query

    genes = spark.createDataFrame([("A", "chr1", 1, 5)], "genome string, chr string, start long, `end` long")
    with pytest.raises(ValueError, match="no genes on"):
        query.regions(spark.createDataFrame([("A", "chr9")], "genome string, chr string"), genes)


def test_a_table_with_another_header_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.csv(str(tmp_path / "t"), sep="\t", header=True)
    with pytest.raises(ValueError, match="malformed"):
        tables.read_table(spark, str(tmp_path / "t"), tables.POSITIONS)
