"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from holloway import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf), duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda data: sorted((tuple(map(plain, r)) for r in data), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


#: Queries without SQL and their columns; their rows are tested elsewhere by brute force or known answers. On the smallest tables
#: the network has one site and so no links.
COLUMNS = {
    "contours": None, "kriging": "id variance z", "mst_edges": "a b d2", "centrality_unweighted": "betweenness closeness id", "centrality_weighted": "betweenness closeness id",
    "isochrones": "c closed length level line part pieces r x1 x2 y1 y2", "cost_network": "dist_m from_id from_nm kind model time_ab time_ba time_sym to_id to_nm",
    "united_pits": "at key ring x y", "region_rings": "at region ring x y", "contour_paths": "at closed level line size x y",
    "cost_network_nodes": "betweenness closeness comp_size component degree id", "trench_select": "id rank score x y", "class_regions": "area_ha cells class region",
}


def test_queries_without_sql_are_known():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_without_sql_runs(spark, sf, name):
    out = catalog.QUERIES[name](spark, sf)
    assert COLUMNS[name] is None or sorted(out.columns) == COLUMNS[name].split()
    assert name == "cost_network" or out.count() > 0
