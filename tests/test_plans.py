"""Plans of the spatial joins: no nested loops, no cross products."""

import pytest

from vellum.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["assign_regions", "supplementary_regions", "tie_breaks", "nesting_flags", "route_regions", "paragraph_blocks", "pair_distances"])
def test_no_nested_loop(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
