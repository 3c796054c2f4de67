"""Every catalogued query runs; where it has SQL, both agree row by row."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphmill.plans import audit, evaluation, exchange, generation, graph, rendering
from glyphmill.streaming import events

CATALOGUE = {name: query for plan in (evaluation, audit, graph, generation, exchange, rendering) for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in (evaluation, audit, graph, generation, exchange, rendering) for name, sql in plan.ORACLES.items()}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, sf, duck, name):
    rows = CATALOGUE[name](spark, sf)
    columns = sorted(rows.columns)
    found = sorted((tuple(_cell(r[c]) for c in columns) for r in rows.collect()), key=str)
    if name in SQL:
        relation = duck.sql(SQL[name])
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        expected = sorted((tuple(_cell(r[i]) for i in at) for r in relation.fetchall()), key=str)
        assert found == expected


@pytest.fixture(scope="module")
def many_suppliers(spark, sf, tmp_path_factory):
    """More suppliers than numbers of four characters."""
    base = tmp_path_factory.mktemp("suppliers")
    os.symlink(f"{sf}/part.parquet", base / "part.parquet")
    spark.range(10_403).selectExpr("id * 3 as s_suppkey").coalesce(1).write.parquet(str(base / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{base}/part.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{base}/supplier.parquet/*.parquet'")
    return str(base), con


@pytest.mark.parametrize("name", ["residual_rows", "split_summary"])
def test_more_pairs_than_four_digits(spark, many_suppliers, name):
    base, con = many_suppliers
    relation = con.sql(SQL[name])
    found = CATALOGUE[name](spark, base).select(*relation.columns).collect()
    assert sorted(map(tuple, found)) == sorted(relation.fetchall())


def test_json_document_writes_few_files(spark, sf):
    made = exchange.json_document(spark, sf)
    assert made.columns == ["last", "rows", "part"] and made.count() > 1 and len(made.inputFiles()) == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CATALOGUE) <= set(entry.queries())


def test_streamed_counts_equal_batch_counts(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    os.symlink(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    stream = events.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    batch = events.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    assert {(r[0], r[1], r[2]) for r in spark.sql("SELECT * FROM counts").collect()} == {(r[0], r[1], r[2]) for r in batch.collect()}
