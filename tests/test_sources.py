import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo
from synblock import scratch
from synblock.operators import sequence
from synblock.sources import dna, tables


def fasta(rng, lengths, width):
    """Sequences, and the text of a FASTA file with lines of ``width`` letters (0: one line each, None: lines of any length)."""
    seqs, lines = {}, []
    for i, n in enumerate(lengths):
        name = f"chr{i}"
        seqs[name] = "".join(rng.choice("ACGTNn") for _ in range(n))
        lines.append(f">{name} note {'x' * rng.randrange(40)}")
        at = 0
        while at < n:
            step = width or (n if width == 0 else rng.randrange(1, 30))
            lines.append(seqs[name][at : at + step])
            at += step
    return seqs, "\n".join(lines)


@pytest.mark.parametrize("width", [0, 7, None])
@pytest.mark.parametrize("end", ["\n", "\r\n", ""])
def test_chunks_put_together_are_the_sequences(spark, tmp_path, width, end):
    rng = random.Random(f"{width}{end}")
    seqs, text = fasta(rng, [1, 300, 0, 57, 1000, 3], width)
    (tmp_path / "a.fa").write_bytes((text + end).replace("\n", end or "\n").encode())
    for size, chunk, overlap in ((17, 10, 4), (64, 25, 30), (1000, 40, 0), (1 << 20, 7, 7)):
        rows = dna.chunks(spark, str(tmp_path), chunk, overlap, size).collect()
        found = {}
        for r in sorted(rows, key=lambda r: (r["chr"], r["offset"])):
            assert r["offset"] == len(found.get(r["chr"], "")) and 0 < r["own"] <= chunk
            assert r["seq"] == seqs[r["chr"]][r["offset"] : r["offset"] + r["own"] + overlap]
            found[r["chr"]] = found.get(r["chr"], "") + r["seq"][: r["own"]]
        assert found == {k: v for k, v in seqs.items() if v}


def test_operators_see_no_chunk_edges(spark, tmp_path):
    rng = random.Random(4)
    seqs, text = fasta(rng, [900, 40, 333], 11)
    for name in seqs:  # long runs across edges
        text = text.replace(seqs[name], seqs[name])
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text("\n".join([">n", "N" * 500, ">m", "A" * 60 + "N" * 120 + "A" + "N" * 30]))
    seqs |= {"n": "N" * 500, "m": "A" * 60 + "N" * 120 + "A" + "N" * 30}
    whole = spark.createDataFrame(list(seqs.items()), "chr string, seq string")
    part = lambda overlap: dna.chunks(spark, str(tmp_path), 16, overlap, 37)
    same = lambda a, b: sorted(a.collect()) == sorted(b.collect())
    assert same(sequence.kmer_hits(part(3), ["ACGT", "NN", "TT"]), sequence.kmer_hits(whole, ["ACGT", "NN", "TT"]))
    assert same(sequence.kmer_hits(part(4), ["ACGTA"], 2, True), sequence.kmer_hits(whole, ["ACGTA"], 2, True))
    assert same(sequence.kmer_ranges(part(2), ["NNN"]), sequence.kmer_ranges(whole, ["NNN"]))
    for least in (1, 2, 100):
        assert same(sequence.runs_of(part(5), "N", least), sequence.runs_of(whole, "N", least))
    for size, step in ((20, 7), (20, 50), (1, 1)):
        assert same(sequence.tiles(part(size - 1), size, step), sequence.tiles(whole, size, step))
    assert same(sequence.lengths(part(0)), sequence.lengths(whole))
    assert same(sequence.contigs(part(0), 3), sequence.contigs(whole, 3))
    assert same(sequence.assembly_report(part(2), ["ACG"], 3, least=5, density=0.1), sequence.assembly_report(whole, ["ACG"], 3, least=5, density=0.1))


def test_only_ranges_with_wanted_sequences_are_read(spark, tmp_path):
    seqs, text = fasta(random.Random(1), [200, 200, 200], 10)
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">zipped one\n" + "ACGT" * 100 + "\n>other\nAC\n")
    table = dna.chunks(spark, str(tmp_path), 50, 0, 60)
    one = table.where("chr = 'chr1'")
    at = scratch.written(dna.index(spark, str(tmp_path), 60), "index")[1]
    every, some = dna._Reader({"index": at}), dna._Reader({"index": at})
    assert list(some.pushFilters([EqualTo(("chr",), "chr1"), EqualTo(("own",), 3)])) == [EqualTo(("own",), 3)]
    assert len(every.partitions()) > 10 and len(some.partitions()) < len(every.partitions()) / 2
    assert "chr1" not in one._jdf.queryExecution().executedPlan().toString()  # nothing of the predicate is left to Spark
    assert "".join(r["seq"] for r in sorted(one.collect(), key=lambda r: r["offset"])) == seqs["chr1"]
    assert sorted(r["own"] for r in table.where(F.col("chr").isin("zipped", "other")).collect()) == [2, *[50] * 8]
    assert table.where("chr = 'none'").count() == 0


def test_index_tells_where_ranges_begin(spark, tmp_path):
    (tmp_path / "a.fa").write_text("AC\n>x y\nACGTACGTACGTACGT\n>z\nAAAA\n")
    rows = sorted(tuple(r) for r in dna.index(spark, str(tmp_path / "a.fa"), 10).select("first", "chr", "offset", "chrs").collect())
    assert rows == [(0, None, 0, ["x"]), (10, "x", 2, ["x"]), (20, "x", 12, ["x", "z"]), (30, "z", 2, ["z"])]


GFF = """##gff-version 3
NC_1\tx\tregion\t1\t900\t.\t+\t.\tID=r;chromosome=1
NC_1\tx\tregion\t5\t9\t.\t+\t.\tID=r;chromosome=7
NC_2\tx\tregion\t1\t900\t.\t+\t.\tID=r;chromosome=Unknown
NC_3\tx\tregion\t1\t900\t.\t+\t.\tID=r
NC_1\tx\tgene\t{0}\t90\t.\t+\t.\tID=a;gene=g|1
NC_1\tx\tmRNA\t{0}\t60\t.\t+\t.\tID=b;gene=g|1
NC_2\tx\tgene\t5\t50\t.\t+\t.\tID=c;gene=g_1
NC_2\tx\tgene\t5\t50\t.\t-\t.\tID=d;gene=g-2
NC_4\tx\tgene\t7\t70\t.\t+\t.\tID=e;gene=g3
NC_3\tx\tgene\t7\t70\t.\t+\t.\tID=e;gene=only
"""
FASTA = ">l1 [gene=g|1] [protein=a b]\nM{0}CD.\n>l2 [gene=g_1]\nMA-\n>l3 [gene=g-2]\nMMM\n>l4 [gene=g3] x\nMMM\n>l5\nMW\n"


def test_genomes_may_share_ids(spark, tmp_path):
    for k, genome in enumerate(("A", "B")):
        (tmp_path / f"{genome}.gff3").write_text(GFF.format(10 + k))
        (tmp_path / f"{genome}.fa").write_text(FASTA.format("VW"[k]))
    files = str(tmp_path / "*.gff3"), str(tmp_path / "*.fa")
    got = sorted(tuple(r) for r in tables.read_annotation(spark, *files, "ncbi").collect())
    want = [(g, "1", 10 + k, 90, "g_1", f"M{'VW'[k]}CD") for k, g in enumerate("AB")]
    want += [(g, "NC_2", 5, 50, "g-2", "MMM") for g in "AB"] + [(g, "NC_4", 7, 70, "g3", "MMM") for g in "AB"]
    assert got == sorted(want)
    few = tables.read_annotation(spark, *files, "ncbi", least=4).collect()
    assert {r["id"] for r in few} == {"g_1"} and len(few) == 2
    alone = tables.read_annotation(spark, *files, "ncbi", distinct=True).collect()
    assert sorted((r["genome"], r["id"]) for r in alone) == [("A", "g-2"), ("A", "g_1"), ("B", "g-2"), ("B", "g_1")]


def test_phytozome_ids_are_the_fourth_entry(spark, tmp_path):
    (tmp_path / "A.gff3").write_text("c1\tx\tgene\t5\t9\t.\t+\t.\tID=q;Name=N.1\nc1\tx\tmRNA\t5\t9\t.\t+\t.\tName=N.1.t\n")
    (tmp_path / "A.fa").write_text(">t pacid=1 transcript=t locus=N.1 more\nMA.C*\n>u locus=N.1\nMMMMMMMM\n")
    got = [tuple(r) for r in tables.read_annotation(spark, str(tmp_path / "A.gff3"), str(tmp_path / "A.fa"), "phytozome").collect()]
    assert got == [("A", "c1", 5, 9, "N.1", "MAC*")]


def test_result_files_are_found_and_copied_on_any_file_system(spark, tmp_path):
    from synblock.sources import orthofinder

    run = tmp_path / "run" / "WorkingDirectory"
    run.mkdir(parents=True)
    for name in ("SpeciesIDs.txt", "Blast0_1.txt.gz", "Blast1_0.txt", "notes.txt", "A__v__B.tsv"):
        (run / name).write_text(name)
    (tmp_path / "run" / "Orthogroups.tsv").write_text("og")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    for folder in (f"file://{tmp_path}/run", "viewfs://store/in/run"):
        found = orthofinder.find(spark, folder)
        assert {k: [p.rsplit("/", 1)[-1] for p in v] for k, v in found.items()} == {
            "species_ids": ["SpeciesIDs.txt"], "sequence_ids": [], "orthogroups": ["Orthogroups.tsv"], "hogs": [], "tree": [], "blast": ["Blast0_1.txt.gz", "Blast1_0.txt"], "orthologues": ["A__v__B.tsv"],
        }
        assert all(p.startswith(folder.split(":")[0]) for v in found.values() for p in v)
        into = tmp_path / folder.split(":")[0]
        copied = orthofinder.copy(spark, folder, f"file://{into}")
        assert sorted(p.name for p in into.iterdir() if not p.name.endswith(".crc")) == ["A__v__B.tsv", "Blast0_1.txt.gz", "Blast1_0.txt", "Orthogroups.tsv", "SpeciesIDs.txt"]
        assert (into / "Blast1_0.txt").read_text() == "Blast1_0.txt" and copied["blast"][1].endswith("/Blast1_0.txt")
        assert orthofinder.listing(spark, folder).where("kind = 'blast'").agg({"length": "sum"}).first()[0] == 27
