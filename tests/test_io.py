"""CSV reading with a byte-order mark, lenient and strict timestamps."""

import os
import tempfile

import pytest

from churnwise.sources import io


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(text)


def test_read_tables_bom_and_lenient(spark):
    d = tempfile.mkdtemp(prefix="cw-io-")
    _write(f"{d}/transactions.csv/part-0.csv",
           "transaction_id,customer_id,transaction_date,sales_amount,service_category,modification_count,"
           "additional_payment,service_rating,fee_rate,transaction_canceled,cancellation_date\n"
           "TXN_0000001,CUST_00001,2024-01-02 03:04:05,1000000,dev,1,0,4.5,0.075,1,bad\n")
    _write(f"{d}/customers.csv/part-0.csv",
           "customer_id,age,region,total_purchase_amount,customer_segment,registration_date,"
           "total_modification_count,total_additional_payment\nCUST_00001,30,r,1.0,regular,2024-01-01 00:00:00,1.0,0.0\n")
    _write(f"{d}/predictions.csv/part-0.csv", "customer_id,churn_probability,risk_level\nCUST_00001,0.5,mid\n")
    t = io.read_tables(spark, d)
    row = t["transactions"].first()
    assert t["transactions"].columns[0] == "transaction_id"
    assert row["transaction_id"] == "TXN_0000001"
    assert row["cancellation_date"] is None
    assert str(row["transaction_date"]) == "2024-01-02 03:04:05"


def test_strict_timestamp_raises(spark):
    df = spark.createDataFrame([("bad",)], "t string")
    assert io.parse_ts(df, "t", lenient=True).first()[0] is None
    with pytest.raises(Exception):
        io.parse_ts(df, "t").collect()


@pytest.mark.parametrize("text,want", [
    ("2024-01-02", "2024-01-02 00:00:00"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
    ("2024-01-02 03:04:05.1", "2024-01-02 03:04:05.100000"), ("2024-01-02 03:04:05.123456", "2024-01-02 03:04:05.123456"),
    ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), (" 2024-01-02 ", "2024-01-02 00:00:00")])
def test_timestamp_forms(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert str(io.parse_ts(df, "t").first()[0]) == want
    assert str(io.parse_ts(df, "t", lenient=True).first()[0]) == want


def test_fixed_timestamp_form(spark):
    df = spark.createDataFrame([("02.01.2024",), ("bad",)], "t string")
    got = io.parse_ts(df, "t", lenient=True, fmt="dd.MM.yyyy").collect()
    assert [str(r[0]) for r in got] == ["2024-01-02 00:00:00", "None"]


def test_write_read_round_trip(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="cw-rt-")
    df = spark.createDataFrame([("a", 1.25, dt.datetime(2024, 1, 1, 5, 6, 7, 123456))], "k string, v double, ts timestamp_ntz")
    io.write_tables({"t": df}, d)
    back = io.read_tables(spark, d, schemas={"t": df.schema})["t"]
    assert back.collect() == df.collect()
    io.write_json(df, f"{d}/json")
    assert spark.read.json(f"{d}/json").count() == 1


def test_write_report_text(spark):
    from churnwise.operators.stats import quality_report
    from churnwise.plans import catalog
    from conftest import SF_SMALL
    d = tempfile.mkdtemp(prefix="cw-rep-")
    rep = quality_report(catalog.tx(spark, SF_SMALL), catalog.ct(spark, SF_SMALL), catalog.preds(spark, SF_SMALL))
    io.write_report(rep, f"{d}/report")
    lines = [r[0] for r in spark.read.text(f"{d}/report").collect()]
    assert len(lines) == rep.count()
    assert "shape | transactions.rows | 1500.000000" in lines


SCHEMA = "id long, amount double, at timestamp_ntz, note string, cancellation_date timestamp_ntz"


def test_quarantine_accounts_for_every_row(spark):
    from pyspark.sql import types as T
    d = tempfile.mkdtemp(prefix="cw-bad-")
    lines = ["id,amount,at,note,cancellation_date", "1,1.5,2024-01-02,ok,", "2,x,2024-01-02,two faults in none,",
             "3,2.5,2024-99-02,late,", "4,y,2024-99-02,both,", "5,1.0", "6,1.0,2024-01-02,more,,7",
             "7,1.0,2024-01-02,\"a, quoted\",soon", "", "8,,,,", "1.5,1.0,2024-01-02,no int,"]
    _write(f"{d}/t.csv/part-0.csv", "\n".join(lines) + "\n")
    got = io.read_checked(spark, d, {"t": T.StructType.fromDDL(SCHEMA)})["t"]
    rows = {r["id"]: r for r in got.rows.collect()}
    assert sorted(rows) == [1, 7, 8]
    assert rows[7]["note"] == "a, quoted" and rows[7]["cancellation_date"] is None
    assert rows[8][1:] == (None, None, None, None)
    rejected = {r["record"]: (r["reason"], r["reasons"]) for r in got.rejected.collect()}
    assert len(rejected) == 6 and rejected["5,1.0"][0] == io.MALFORMED
    assert rejected["6,1.0,2024-01-02,more,,7"][0] == io.MALFORMED
    both = next(v for k, v in rejected.items() if k.startswith("4,"))
    assert both == ("bad amount", ["bad amount", "bad at"])
    assert [(r["reason"], r["record"][:2]) for r in got.nulled.collect()] == [("bad cancellation_date", "7,")]
    counts = {(r["outcome"], r["reason"]): r["rows"] for r in io.check_summary("t", got).collect()}
    assert counts == {("read", None): 3, ("rejected", "bad amount"): 2, ("rejected", "bad at"): 1,
                      ("rejected", "bad id"): 1, ("rejected", io.MALFORMED): 2, ("nulled", "bad cancellation_date"): 1}
    assert got.rows.count() + got.rejected.count() == len([x for x in lines[1:] if x])


def test_quarantine_of_an_empty_table(spark):
    from pyspark.sql import types as T
    d = tempfile.mkdtemp(prefix="cw-none-")
    _write(f"{d}/t.csv/part-0.csv", "id,amount,at,note,cancellation_date\n")
    got = io.read_checked(spark, d, {"t": T.StructType.fromDDL(SCHEMA)})["t"]
    assert got.rows.count() == got.rejected.count() == got.nulled.count() == 0


@pytest.mark.parametrize("bom", [True, False])
def test_byte_order_mark(spark, bom):
    d = tempfile.mkdtemp(prefix="cw-bom-")
    df = spark.createDataFrame([("가", 1.0), ("b", 2.0)], "k string, v double").repartition(2)
    io.write_tables({"t": df}, d, bom=bom)
    parts = [f for f in os.listdir(f"{d}/t.csv") if f.startswith("part-")]
    assert parts
    for f in parts:
        with open(f"{d}/t.csv/{f}", "rb") as h:
            assert h.read().startswith(b"\xef\xbb\xbfk,v") == bom
    assert sorted(io.read_tables(spark, d, {"t": df.schema})["t"].collect()) == sorted(df.collect())
