"""Every registered query with an SQL twin agrees with DuckDB at sf0.001."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from churnwise.sources.bindings import TABLES
from conftest import SF_SMALL
from tools.check_oracle import _frame, digest

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "customer_segment" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    sdf = queries()[name](spark, SF_SMALL)
    pdf = _frame([tuple(r) for r in sdf.collect()], sdf.columns)
    cur = con.execute(SQL[name])
    odf = _frame(cur.fetchall(), [c[0] for c in cur.description])
    assert digest(pdf)[:3] == digest(odf)[:3]


def test_sanity_counts(spark):
    """FIXTURES section 4 at sf0.001."""
    from churnwise.plans import catalog as c
    assert c.tx(spark, SF_SMALL).count() == 1500
    assert c.tx180(spark, SF_SMALL).count() == 106
    seg = {r["customer_segment"]: r["customers"] for r in queries()["segment_stats"](spark, SF_SMALL).collect()}
    assert sum(seg.values()) == 150 and seg["VIP"] == 15 and seg["premium"] == 30
    recent = queries()["customer_table_recent"](spark, SF_SMALL)
    assert recent.where("total_purchase_amount = 0").count() == 70
