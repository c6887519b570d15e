"""Registered queries against DuckDB on the smallest data set (all of them: ``python check_oracle.py``)."""

import os

import pytest

import __spark_entry__ as contract
from urlrisk.plans import registry

FOLDER = "/root/testdata/sf0.001"
#: ALL_ORACLES=1 runs every registered SQL text of the library.
CHOSEN = (
    "canonical_urls url_features brand_matches layered_scan split_counts evaluation_report isotonic_fit scan_records "
    "robustness_homoglyph feedback_rates feed_recall verdict_counts f1_at_threshold error_list triage"
).split()
if os.environ.get("ALL_ORACLES"):
    CHOSEN = sorted(registry.ORACLE)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, name):
    from check_oracle import compare, duck

    ok, info = compare(spark, duck(FOLDER), name, FOLDER)
    assert ok, info


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["registered_domain", "verdict", "n"]
