"""Physical-plan properties that matter at scale: pushdown, pruning, top-k
without a full sort, no cartesian products, exchange reuse."""

import io
import re
from contextlib import redirect_stdout

import pytest

from churnwise.operators import lists, rollups
from churnwise.operators.quantiles import quantiles
from churnwise.plans import catalog
from conftest import SF_SMALL


@pytest.fixture(autouse=True)
def nothing_reused(spark):
    """Plans as they are without the tables that other tests have asked to be reused."""
    spark.catalog.clearCache()


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_point_lookup_reaches_the_scan(spark):
    plan = _plan(lists.customer_history(catalog.tx(spark, SF_SMALL), 7))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_custkey,7\)", plan)


@pytest.mark.parametrize("name", ["customer_history", "customer_activity"])
def test_one_customer_reads_few_lines(spark, name):
    """The lines are filtered by the keys of the customer's orders before they are grouped."""
    plan = _plan(catalog.REGISTRY[name].run(spark, SF_SMALL))
    scan = re.search(r"Scan parquet \n(?:(?!Scan parquet)[\s\S])*?lineitem\.parquet[\s\S]*?ReadSchema", plan).group()
    pushed = re.findall(r"(?:DataFilters|PushedFilters): \[[^\]]*\]", plan)
    assert "LeftSemi" in plan
    assert any("l_orderkey" in p and "GreaterThanOrEqual" in p for p in pushed) or "l_orderkey" in scan
    tree = plan[:plan.index("\n\n")]
    line = [i for i, x in enumerate(tree.splitlines()) if "Semi" in x][0]
    assert any("HashAggregate" in x or "SortAggregate" in x for x in tree.splitlines()[:line])  # grouped above the join


def test_columns_are_pruned(spark):
    plan = _plan(rollups.customer_rollup(catalog.tx(spark, SF_SMALL)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    line = [s for s in schemas if "l_orderkey" in s]
    assert line and all("l_partkey" not in s and "l_quantity" not in s for s in line)
    assert all("o_orderstatus" not in s for s in schemas)


def test_top_k_is_take_ordered(spark):
    plan = _plan(lists.top_risk(catalog.cu(spark, SF_SMALL)))
    assert "TakeOrderedAndProject" in plan


def test_no_cartesian_products(spark):
    for name in ("segment_stats", "rule_risk", "customers", "amount_histogram", "box_purchase"):
        plan = _plan(catalog.REGISTRY[name].run(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name


def _scans(df) -> dict[str, int]:
    """Scans per table that the executed plan holds (a reused exchange counts once)."""
    df.collect()
    plan = _plan(df)
    plan = plan[plan.index("== Final Plan =="):] if "== Final Plan ==" in plan else plan
    plan = plan.split("== Initial Plan ==")[0]
    return {t: len(re.findall(rf"Location: \S+ \[\S*/{t}\.parquet\]", plan)) for t in ("customer", "orders", "lineitem")}


@pytest.mark.parametrize("name,customer,orders", [
    ("customers", 1, 4), ("kpis", 1, 4), ("top_risk", 1, 4), ("describe_amount", 0, 2), ("customer_rollup", 0, 1)])
def test_scan_counts(spark, name, customer, orders):
    scans = _scans(catalog.REGISTRY[name].run(spark, SF_SMALL))
    assert scans["customer"] <= customer and scans["orders"] <= orders, scans


def test_rows_are_not_exchanged_by_group(spark):
    """Quantiles per category send counts over the network, not the rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i % 5, float(i)) for i in range(20000)], "g int, x double").repartition(4)
        df = quantiles(rows, "x", [0.1, 0.5], by=["g"])
        plan = _plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan


def test_report_sections(spark):
    rep = catalog.REGISTRY["quality_report"].run(spark, SF_SMALL)
    sections = {r["section"] for r in rep.select("section").distinct().collect()}
    assert sections == {"shape", "sales_amount", "modification_count", "modification_count.distribution",
                        "cancellations", "correlation", "segment", "churn_probability", "risk_level", "checks"}
    assert rep.where("section = 'correlation'").count() == 25
