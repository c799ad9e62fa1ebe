"""Proximity graphs, trees, centrality and interpolation over the sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import graph, surfaces, triangulation
from ..operators.quantile import quantile
from ..sources.grid import Grid
from .tables import SITES_SQL, read, sites

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KNN_SQL = SITES_SQL + ", kp AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM sites a, sites b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) <= 3)"
REACH_SQL = SITES_SQL + ", ln AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM sites a JOIN sites b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 900)"


def _near(spark, sf_dir):
    s = sites(spark, sf_dir)
    return graph.nearest(s, s, 3, same=True)


def _links(spark, sf_dir):
    return graph.within(sites(spark, sf_dir), 30)


def _open(spark, sf_dir):
    return graph.open_links(sites(spark, sf_dir), 30)


def _whole(t):
    return t.select("a", "b", F.col("d2").cast("double").alias("d2"))


@query(f"WITH {KNN_SQL} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, CAST(d2 AS DOUBLE) AS d2 FROM kp")
def knn_graph(spark, sf_dir):
    return _whole(graph.undirected(_near(spark, sf_dir)))


@query(f"WITH {KNN_SQL} SELECT p.a, p.b, CAST(p.d2 AS DOUBLE) AS d2 FROM kp p JOIN kp q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b")
def knn_mutual(spark, sf_dir):
    return _whole(graph.mutual(_near(spark, sf_dir)))


@query(f"WITH {REACH_SQL} SELECT a, b, CAST(d2 AS DOUBLE) AS d2 FROM ln")
def threshold_graph(spark, sf_dir):
    return _whole(_links(spark, sf_dir))


ENDS = "FROM ln JOIN sites p ON p.id = ln.a JOIN sites q ON q.id = ln.b WHERE NOT EXISTS (SELECT 1 FROM sites c WHERE c.id <> ln.a AND c.id <> ln.b AND"


@query(f"WITH {REACH_SQL} SELECT a, b, CAST(d2 AS DOUBLE) AS d2 {ENDS} (c.x - p.x) * (c.x - q.x) + (c.y - p.y) * (c.y - q.y) < 0)")
def gabriel_graph(spark, sf_dir):
    return _whole(graph.gabriel(_open(spark, sf_dir), sites(spark, sf_dir)))


@query(f"WITH {REACH_SQL} SELECT a, b, CAST(d2 AS DOUBLE) AS d2 {ENDS} (c.x - p.x) ** 2 + (c.y - p.y) ** 2 < d2 AND (c.x - q.x) ** 2 + (c.y - q.y) ** 2 < d2)")
def rng_graph(spark, sf_dir):
    return _whole(graph.relative_neighbours(_open(spark, sf_dir), sites(spark, sf_dir)))


@query(f"WITH {REACH_SQL} SELECT id, count(*) AS degree FROM (SELECT a AS id FROM ln UNION ALL SELECT b FROM ln) GROUP BY id")
def degree(spark, sf_dir):
    return graph.degree_within(sites(spark, sf_dir), 30)


PARTS_SQL = f"""{REACH_SQL}, lk AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln), cc(id, component) USING KEY (id) AS (SELECT id, id FROM sites UNION SELECT l.b, min(c.component) FROM cc c JOIN lk l ON l.a = c.id LEFT JOIN recurring.cc k ON k.id = l.b GROUP BY l.b HAVING min(c.component) < min(k.component))"""


@query(f"WITH RECURSIVE {PARTS_SQL} SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM cc")
def components(spark, sf_dir):
    """Connected parts of the sites' graph."""
    return graph.labelled(_open(spark, sf_dir), sites(spark, sf_dir))


@query()
def mst_edges(spark, sf_dir):
    """A least spanning forest of the sites' graph; tested against Kruskal's."""
    return graph.spanning_tree(_open(spark, sf_dir))


@query(f"WITH RECURSIVE {PARTS_SQL} SELECT c.component, count(*) - 1 AS links FROM cc c GROUP BY c.component HAVING count(*) > 1")
def mst_sizes(spark, sf_dir):
    """How many links the forest has in each part: one less than the part has sites."""
    links = cut(_open(spark, sf_dir))
    parts = graph.labelled(links, sites(spark, sf_dir))
    return graph.spanning_tree(links).join(parts, F.col("a") == F.col("id")).groupBy("component").agg(F.count("*").alias("links"))


@query(f"WITH {SITES_SQL} SELECT a.id AS a, b.id AS b, CAST((a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS DOUBLE) AS d2 FROM sites a, sites b WHERE NOT a.hub AND b.hub QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) = 1")
def hub_links(spark, sf_dir):
    return _whole(graph.hub_links(sites(spark, sf_dir)))


@query(f"WITH {SITES_SQL}, g AS (SELECT a.id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2 FROM sites a JOIN sites b ON a.id <> b.id GROUP BY a.id) SELECT round(median(sqrt(d2)), 6) AS gap FROM g WHERE d2 > 0")
def median_gap(spark, sf_dir):
    """The median distance to the nearest other site, of sites that have none in the same place."""
    s = sites(spark, sf_dir)
    gap = quantile(cut(graph.nearest(s, s, 1, same=True).where("d2 > 0").select("d2")), F.sqrt("d2"), 0.5)
    return spark.range(1).select(F.round(F.lit(gap).cast("double"), 6).alias("gap"))


def _hubs(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey * 37 % 101 AS x", "s_suppkey * 53 % 97 AS y")


@query()
def centrality_unweighted(spark, sf_dir):
    """Closeness and betweenness of the suppliers' graph, counting links; tested on graphs with known answers."""
    s = _hubs(spark, sf_dir)
    return graph.centrality(graph.within(s, 12), s)


@query()
def centrality_weighted(spark, sf_dir):
    s = _hubs(spark, sf_dir)
    return graph.centrality(graph.within(s, 12).withColumn("d", F.sqrt("d2")), s, "d")


HEIGHTS_SQL = "h AS (SELECT s_suppkey AS id, s_suppkey * 37 % 1009 + s_acctbal / 1000 AS x, s_suppkey * 53 % 997 - s_acctbal / 700 AS y, s_acctbal AS z FROM supplier)"
TRIANGLES_SQL = HEIGHTS_SQL + """, k AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, a.z AS az, b.z AS bz, c.z AS cz,
  2 * ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS d, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 AS p, (c.x - a.x) ** 2 + (c.y - a.y) ** 2 AS q FROM h a JOIN h b ON a.id < b.id JOIN h c ON b.id < c.id),
o AS (SELECT *, ((cy - ay) * p - (by_ - ay) * q) / d AS u, ((bx - ax) * q - (cx - ax) * p) / d AS v FROM k WHERE d <> 0),
t AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id <> o.a AND h.id <> o.b AND h.id <> o.c AND (h.x - ax - u) ** 2 + (h.y - ay - v) ** 2 < u * u + v * v))"""


def _heights(spark, sf_dir):
    """Suppliers at uneven places, with heights."""
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey * 37 % 1009 + s_acctbal / 1000 AS x", "s_suppkey * 53 % 997 - s_acctbal / 700 AS y", "s_acctbal AS z")


@query(f"WITH {TRIANGLES_SQL} SELECT DISTINCT l.a, l.b, round((p.x - q.x) ** 2 + (p.y - q.y) ** 2, 6) AS d2 FROM (SELECT a, b FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t) l JOIN h p ON p.id = l.a JOIN h q ON q.id = l.b")
def delaunay_edges(spark, sf_dir):
    return triangulation.delaunay(_heights(spark, sf_dir)).select("a", "b", F.round("d2", 6).alias("d2"))


@query(f"""WITH {TRIANGLES_SQL}, w AS (SELECT r, c AS col, c * 20 + 10.0 AS x, 1000 - (r * 20 + 10.0) AS y FROM range(0, 50) g(r), range(0, 50) f(c)),
i AS (SELECT r, col, az, bz, cz, (cx - bx) * (w.y - by_) - (cy - by_) * (w.x - bx) AS wa, (ax - cx) * (w.y - cy) - (ay - cy) * (w.x - cx) AS wb, (bx - ax) * (w.y - ay) - (by_ - ay) * (w.x - ax) AS wc
  FROM w JOIN t ON w.x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND w.y BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy))
SELECT r, col AS c, round(min((wa * az + wb * bz + wc * cz) / (wa + wb + wc)), 4) AS z FROM i WHERE wa >= 0 AND wb >= 0 AND wc >= 0 OR wa <= 0 AND wb <= 0 AND wc <= 0 GROUP BY r, col""")
def tin_linear(spark, sf_dir):
    """Heights carried linearly over the triangles of the sites."""
    return triangulation.linear_surface(_heights(spark, sf_dir), Grid(0.0, 1000.0, 20.0, 50, 50)).select("r", "c", F.round("z", 4).alias("z"))


GRID_SQL = "g AS (SELECT r * 25 + c AS id, c * 40 + 20 AS x, r * 40 + 20 AS y FROM range(0, 25) a(r), range(0, 25) b(c))"


def _grid(spark):
    return spark.range(625).selectExpr("id", "id % 25 * 40 + 20 AS x", "(id DIV 25) * 40 + 20 AS y")


@query(f"""WITH {SITES_SQL}, {GRID_SQL}, k AS (SELECT g.id, s.z, (g.x - s.x) ** 2 + (g.y - s.y) ** 2 AS d2 FROM g, sites s QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY (g.x - s.x) ** 2 + (g.y - s.y) ** 2, s.id) <= 12)
SELECT id, round(coalesce(avg(z) FILTER (d2 = 0), sum(z / d2) FILTER (d2 > 0) / sum(1 / d2) FILTER (d2 > 0)), 4) AS z FROM k GROUP BY id""")
def idw(spark, sf_dir):
    return surfaces.inverse_distance(_grid(spark), sites(spark, sf_dir)).select("id", F.round("z", 4).alias("z"))


@query()
def kriging(spark, sf_dir):
    """Ordinary kriging from 16 neighbours; tested against one dense solve for each place."""
    return surfaces.kriging(_grid(spark), sites(spark, sf_dir))
