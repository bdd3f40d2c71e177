"""What the plans must show: filters and columns that reach the scan, and no product of large sides."""

import pytest

from tableferry import plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, filters, columns",
    [
        ("scan_scope", ["EqualTo(o_orderstatus,F)", "GreaterThan(o_totalprice,100000.0)"], "o_orderkey"),
        ("scan_incremental", ["GreaterThan(event_id,4000)"], "user_id"),
        ("scan_lag_window", ["GreaterThan(ts,", "LessThanOrEqual(ts,"], "event_id"),
        ("filter_where", ["StringStartsWith(o_orderpriority,1)", "LessThanOrEqual(o_orderkey,9000)"], "o_totalprice"),
    ],
)
def test_filters_reach_the_scan(spark, name, filters, columns):
    text = plan(plans.QUERIES[name](spark, SF))
    pushed = text[text.index("PushedFilters") :]
    assert all(f in pushed for f in filters), pushed[:400]
    read = text[text.index("ReadSchema") :]
    assert columns in read and "o_orderdate" not in read and "props" not in read


@pytest.mark.parametrize("name", ["post_missing_keys", "key_diff", "orphan_rows", "key_hash_buckets", "dedup_last", "row_hash_diff"])
def test_joins_are_on_keys(spark, name):
    text = plan(plans.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_projections_prune_columns(spark):
    assert "l_extendedprice" not in plan(plans.QUERIES["dup_keys_source"](spark, SF))
