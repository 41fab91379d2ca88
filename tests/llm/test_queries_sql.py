"""Queries of the package that SQL can state agree with DuckDB, also on odd rows."""

import duckdb
import pytest

from churnwise.llm import embedding_dedup, suffix_dedup
from churnwise.llm.queries import QUERIES, SQL
from conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_small_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in cur.description)
    order = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(cur.fetchall())


def test_repeats_of_hand_rows(spark):
    rows = [(1, "é" + "x" * 80), (2, "x" * 80 + "é"), (3, None), (4, "y" * 49), (5, "y" * 49), (6, "x" * 60 + "--" + "x" * 60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    df = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = df.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["op6_suffix_dedup"]).fetchall())


def test_links_of_hand_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.25], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
            (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, 0.0], 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    df = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = [(r["id"], r["n_links"], r["component"], r["id"] == r["component"]) for r in df.collect()]
    assert sorted(got) == sorted(con.execute(SQL["op7_embedding_dedup"]).fetchall())
