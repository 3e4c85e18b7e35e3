import sys
from pathlib import Path

import os

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cellflow.plans import campaigns, catalog, gating, geometry, scoring  # noqa: E402
from oracle import same  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name], D)


def test_geometry_is_in_the_catalog():
    assert catalog.QUERIES["grown_box"] is campaigns.grown_box and catalog.QUERIES["epoch_scores"] is scoring.epoch_scores and catalog.QUERIES["plate_response"] is geometry.plate_response and catalog.QUERIES["spread_gate"] is gating.spread_gate


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
