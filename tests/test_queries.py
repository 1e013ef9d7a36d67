"""Queries of the catalogue and of streams against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import pytest

from wayfold.functions import shared
from wayfold.plans import catalogue, commands, distributed, function_families, graph_queries, learning
from wayfold.sources import files
from wayfold.streaming import queries as streaming

PARTS = (catalogue, function_families, commands, files, graph_queries, distributed, learning, streaming)
OWN = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in PARTS for name, text in part.SQL.items()}

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((str([plain(r[k]) for k in order]) for r in found))


@pytest.mark.parametrize("name", [name for name in OWN if name in SQL])
def test_query(spark, duck, name):
    df = OWN[name](spark, DATA)
    got = rows(df.columns, df.collect())
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())


#: Least and most of each measure of the models that are fitted in rounds.
BOUNDS = {
    "ml_classifiers": {None: (0.6, 1.0), "tree": (0.9, 1.0), "logistic": (0.9, 1.0)},
    "ml_regressors": {None: (0.8, 1.0), "generalized": (0.999, 1.0)},
    "ml_clusters": {None: (0.1, 1.0), "topics": (0.0, 20.0)},
    "ml_factors": {None: (0.0, 5.0)},
    "ml_projections": {None: (0.0, 1e6), "pca": (0.5, 1.0), "quantiles": (3, 4)},
    "ml_tuning": {None: (0.8, 1.0), "ks": (0.0, 0.3)},
}


@pytest.mark.parametrize("name", list(BOUNDS))
def test_models(spark, name):
    found = {r["model"]: r["measure"] for r in learning.QUERIES[name](spark, DATA).collect()}
    for model, value in found.items():
        low, high = BOUNDS[name].get(model, BOUNDS[name][None])
        assert low <= value <= high, (model, value)


@pytest.mark.parametrize("query", [learning._part, function_families.QUERIES["fn_nested_by_name"]])
def test_rows_of_a_small_file_are_dealt_to_tasks(spark, query, monkeypatch):
    """One file of a few bytes is worked on by a task for every so many rows, the same rows together each time."""
    rows = spark.read.parquet(f"{DATA}/part.parquet").count()
    monkeypatch.setattr(shared, "DEALT", rows // 5)
    df = query(spark, DATA)
    held = [[r["p_partkey"] for r in part] for part in df.rdd.glom().collect()]
    assert df.rdd.getNumPartitions() >= 5 and max(map(len, held)) < rows / 2
    assert all(part == sorted(part) for part in held) and sum(map(len, held)) == rows
    assert held == [[r["p_partkey"] for r in part] for part in query(spark, DATA).rdd.glom().collect()]


def test_columns_that_differ_by_case(spark, tmp_path):
    """The crosstab's p and P can be written and referred to, and the caller's session goes on taking names without case."""
    df = commands.QUERIES["api_crosstab"](spark, DATA)
    df.write.parquet(str(tmp_path / "t"))
    back = df.sparkSession.read.parquet(str(tmp_path / "t"))
    assert back.columns == ["p", "F", "O", "P"] and sorted(back.collect()) == sorted(df.collect())
    assert df.select("P").schema["P"].dataType.typeName() == "long" and df.select("p").schema["p"].dataType.typeName() == "string"
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_strong_components(spark):
    """Against the pairs that reach each other."""
    from wayfold.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7), (7, 8)], "src long, dst long")
    assert {r["id"]: r["value"] for r in graph.strong_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
