"""What plans must not lose: pruned scans, pushed filters, joins with a key."""

from pathlib import Path

import pytest
from synblock.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plan(spark, name):
    return catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jn01_annotate_hits", "jn09_overlap_join", "jn11_genes_in_block", "jn12_point_in_box", "jn13_radius_flag", "jn14_nearest", "iv04_intersect", "iv05_subtract", "iv07_window_coverage", "qy03_copy_numbers", "sy13_self"])
def test_joins_have_keys(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark):
    text = plan(spark, "ag11_boolean_sum")
    assert "l_extendedprice" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "GreaterThan(l_quantity" in plan(spark, "jn07_semi")


def test_no_python_where_none_is_needed(spark):
    for name in ("iv08_classify", "sy04_placements", "jn15_interpolate", "wn09_run_lengths", "sy22_block_coordinates"):
        text = plan(spark, name)
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
