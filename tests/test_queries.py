"""Every registered query against its SQL, with slices as they are and with narrow ones."""

import __spark_entry__ as entry_file
import oracle
import pytest
from tidewatch.plans.registry import QUERIES, SQL

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
ROWS_ONLY = {"progress_table"}
# queries with ordered steps
NARROW = sorted(
    n
    for n in SQL
    if n.startswith(("counter", "offset", "phase", "running", "scrape", "pod_", "rtt", "jitter", "request"))
    or n.startswith(("latency_summary_ms", "latency_describe", "latency_box", "quantile", "rolling", "io_rate"))
    or n in {"packet_table", "network_report", "intermessage_stats", "fleet_replay", "slo_check", "node_resources"}
    or n in {"disruption", "true_starts", "preagg_rate", "drift_centered_iqr", "running_total"}
)


@pytest.fixture(scope="module")
def small():
    return oracle.connect(SMALL)


@pytest.fixture(scope="module")
def tiny():
    return oracle.connect(TINY)


def test_only_named_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    assert oracle.differences(QUERIES[name](spark, SMALL), small, SQL[name]) is None


@pytest.mark.parametrize("name", NARROW)
def test_narrow_slices_match_sql(spark, tiny, narrow, name):
    assert oracle.differences(QUERIES[name](spark, TINY), tiny, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.count() == 3
    assert df.columns[0] == "stage" and "median_edge_ms" in df.columns
