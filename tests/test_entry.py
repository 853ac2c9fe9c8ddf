import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_package(tmp_path):
    shutil.copytree(REPO / "synblock", tmp_path / "synblock", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 90 and 'pipeline' not in q; print('fine')"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert "fine" in run.stdout, run.stderr


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["genome", "ogType", "copyNumber", "nGenes", "nOgs", "percGenes", "percOGs"] and out.count() > 0


def test_streamed_hits_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F
    from synblock.streaming.append import append_hits

    genes = spark.createDataFrame([("A", "c", 1, 5, "a1", "a1", 1, "x"), ("B", "c", 1, 5, "b1", "b1", 1, "x"), ("B", "c", 8, 9, "b2", "b2", 2, "y")], "genome string, chr string, start long, end long, id string, ofID string, ord long, og string")
    genes = genes.withColumns({"isArrayRep": F.lit(True), "noAnchor": F.lit(False)})
    (tmp_path / "in").mkdir()
    for n, lines in enumerate((["a1\tb1\t90\t10\t0\t0\t1\t9\t1\t9\t1e-9\t50"], ["a1\tb2\t80\t10\t0\t0\t1\t9\t1\t9\t1e-5\t20"])):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines) + "\n")
        append_hits(spark, str(tmp_path / "in"), genes, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    rows = {(r["ofID1"], r["ofID2"], r["sameOG"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("a1", "b1", True), ("a1", "b2", False)}
