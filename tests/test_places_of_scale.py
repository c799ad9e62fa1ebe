"""Rows that only large tables have, on small ones made for them."""

import duckdb
import numpy as np
import pytest

from holloway import catalog, lineage
from holloway.operators import graph


def same_as_sql(spark, folder, name, **tables):
    """The query and its SQL on tables given as SQL; the rows are compared exactly."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, str(folder)), con.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    rows = sorted(tuple(r) for r in got.select(*columns).collect())
    assert rows == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall()) and rows
    return rows


@pytest.mark.parametrize("name", ["site_relations", "leading_directions"])
def test_box_in_the_middle_of_the_area(spark, tmp_path, name):
    # 2 * xmin + width = 920 and 2 * ymin + height = 820: the centre of the area.
    place = "SELECT p, s FROM range(991 * 983) a(p), range(1, 51) b(s) WHERE 2 * (p * 37 % 991) + 5 + s % 23 = 920 AND 2 * (p * 53 % 983) + 5 + s % 17 = 820 LIMIT 2"
    rows = same_as_sql(spark, tmp_path, name, part=f"SELECT p AS p_partkey, 'n' AS p_name, 'b' AS p_brand, CAST(s AS INT) AS p_size FROM ({place})")
    assert "N" in rows[0]


def test_costs_round_as_their_sql(spark, tmp_path):
    # Pairs whose wheeled cost lies by a half of the last digit, some found among 100 million.
    pairs = [(266158.56, 432613.51), (111670.97, 197805.71), (299418.13, 469502.71), (335288.47, 416480.62), (335990.29, 505933.18), (238180.02, 429440.25), (480438.64, 654970.79), (305601.44, 350282.67)]
    rows = ", ".join(f"({1000 * i + j}, {v}::DOUBLE)" for i, pair in enumerate(pairs) for j, v in enumerate(pair))
    same_as_sql(spark, tmp_path, "cost_wheeled", orders=f"SELECT k::BIGINT AS o_orderkey, v AS o_totalprice FROM (VALUES {rows}) t(k, v)")


def test_all_samples_count_for_a_drawn_surface(spark, sf):
    got = [r.z for r in catalog.QUERIES["drawn_surface"](spark, sf).orderBy("r", "c").collect()]
    con = duckdb.connect()
    for t in ("supplier", "customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    head = catalog.ORACLES["drawn_surface"].split("SELECT r, c, round(")[0]  # every sample for every cell, averaged here
    pairs = con.sql(f"{head} SELECT r, c, z, d2 FROM k").fetchall()
    places = con.sql(f"{head} SELECT count(*) FROM p").fetchall()[0][0]
    assert len(pairs) == 400 * places and places > 12
    for n, (r, c) in enumerate((r, c) for r in range(20) for c in range(20)):
        own = [(z, d2) for a, b, z, d2 in pairs if (a, b) == (r, c)]
        want = [z for z, d2 in own if d2 == 0] or [sum(z / d2 for z, d2 in own) / sum(1 / d2 for _, d2 in own)]
        assert got[n] == pytest.approx(sum(want) / len(want), abs=1e-4)


@pytest.mark.parametrize("filled", [4])
def test_open_links_keep_forests_parts_and_gabriel_links(spark, monkeypatch, filled):
    monkeypatch.setattr(graph, "FILLED", filled)
    rng = np.random.default_rng(4)
    grid = [(x, y) for x in range(18) for y in range(16) if rng.random() < 0.95]  # equal distances everywhere
    places = grid + [(float(x), float(y)) for x, y in rng.normal(60, 12, (60, 2))] + [grid[0], grid[7], (120, 3)]
    ids = rng.permutation(len(places))
    s = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, places, strict=True)], "id long, x double, y double")
    every, few = lineage.cut(graph.within(s, 9)), lineage.cut(graph.open_links(s, 9))
    pairs = lambda t: sorted(tuple(r) for r in t.select("a", "b", "d2").collect())
    assert set(pairs(few)) < set(pairs(every)) and few.count() < every.count() / 4
    for f in (lambda t: graph.gabriel(t, s), lambda t: graph.relative_neighbours(t, s), graph.spanning_tree):
        assert pairs(f(few)) == pairs(f(every))
    assert sorted(map(tuple, graph.labelled(few, s).collect())) == sorted(map(tuple, graph.labelled(every, s).collect()))
    assert sorted(map(tuple, graph.degree_within(s, 9).collect())) == sorted(map(tuple, graph.degree(every).collect()))
    assert graph.open_links(s.limit(0), 9).count() == 0 and graph.open_links(s.limit(1), 9).count() == 0
