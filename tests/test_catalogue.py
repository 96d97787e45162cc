"""Every query with a SQL twin against DuckDB on the smallest tables; the others against their batch form."""

import os

import duckdb
import pytest

from voxelspark.plans import catalogue, scenes, volumes  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_streamed_counts_are_the_batch_counts(spark):
    got = {(r["start"].date(), r["event_type"]): r["n"] for r in catalogue.QUERIES["stream_sequence_counts"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as date) as day", "event_type").groupBy("day", "event_type").count().collect()
    assert got == {(r["day"], r["event_type"]): r["count"] for r in rows}


def test_streamed_blend_is_a_fold(spark):
    got = {r["user_id"]: (r["seen"], r["value"]) for r in catalogue.QUERIES["stream_temporal_blend"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        n, v = want.get(r["user_id"], (0, 0.0))
        want[r["user_id"]] = (n + 1, r["value"] if n == 0 else v + (r["value"] - v) * 0.25)
    assert {k: (n, round(v, 5)) for k, (n, v) in got.items()} == {k: (n, round(v, 5)) for k, (n, v) in want.items()}
