"""Registered queries against their SQL twins on the smallest driver tables.

tools/compare.py runs all of them; here one per kind keeps the suite short.
"""

import os

import pytest

import __spark_entry__ as entry
import oracle
import queries
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["a2_decode_frames", "a8_allowlist_ranges", "b10_conjunction", "b14_drop_allowlisted", "c5_all_rules", "c6_custom_rules",
         "d_offline_alerts", "d6_capture_score", "e5_digest", "f5_investigate", "f11_top_attackers"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_every_query_has_a_twin():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, note, *_ = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
