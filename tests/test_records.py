"""Numbering, quantiles, staged results, run logs, layers and small rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from holloway import lineage
from holloway.functions import records
from holloway.operators import decision, graph, profile, quantile, routes, sampling, surveys, vector
from holloway.sources import files, layers
from holloway.sources.grid import Grid


def test_numbered_and_evenly(spark):
    t = spark.range(1000).select(F.pmod(F.col("id") * 377, F.lit(1009)).alias("v")).repartition(5)
    want = sorted(r.v for r in t.collect())
    assert [r.v for r in lineage.numbered(t, "v").orderBy("n").collect()] == want
    assert sorted(r.n for r in lineage.numbered(t, "v").collect()) == list(range(1000))
    assert lineage.numbered(t.limit(0), "v").count() == 0
    for most in (1, 2, 7, 999):
        places = sorted({round(i * 999 / (most - 1)) for i in range(most)}) if most > 1 else [0]
        assert sorted(r.v for r in profile.evenly(t, "v", most).collect()) == [want[k] for k in places]


@pytest.mark.parametrize("few", [100_000, 3])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantile, "FEW", few)
    monkeypatch.setattr(quantile, "RANGES", 50)
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=301), np.r_[np.zeros(200), 1e9, -5], np.array([4.0]), rng.integers(0, 4, 100) * 1.0):
        t = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        for share in (0.1, 1.0):
            assert quantile.quantile(t, F.col("v"), share) == pytest.approx(np.quantile(values, share))
    assert quantile.quantile(spark.createDataFrame([], "v double"), F.col("v"), 0.5) is None


def test_salted_join(spark):
    rows = spark.range(5000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = lineage.join_salted(rows, keyed, "k", "n", "id")
    assert got.count() == 5000 and got.exceptAll(rows.join(keyed, "k").select(*got.columns)).count() == 0


def test_staged_results(spark, tmp_path):
    home = str(tmp_path)
    grid = Grid(0.0, 10.0, 5.0, 2, 2)
    cells = spark.createDataFrame([(0, 0, 1.5), (1, 1, None), (9, 9, 2.0)], "r long, c long, z double")
    files.write_raster(cells, grid, f"{home}/dem")
    back, found = files.read_raster(spark, f"{home}/dem")
    assert found == grid and sorted(map(tuple, back.collect())) == [(0, 0, 1.5), (1, 1, None)]
    with pytest.raises(FileExistsError):
        files.write_raster(cells, grid, f"{home}/dem")
    with pytest.raises(ValueError):
        files.write_raster(cells.drop("z"), grid, f"{home}/x")
    assert sorted(p for p in os.listdir(home) if not p.startswith(".")) == ["dem"] and not [p for p in os.listdir(home) if p.startswith(files.STAGED)]
    staged = files.stage_folder(spark, home, "r1", "test")
    (tmp_path / "plain").mkdir()
    assert not files.drop_stage(spark, f"{home}/plain") and files.drop_stage(spark, staged) and not os.path.exists(staged)
    for k in "ab":
        spark.range(2).write.parquet(f"{home}/s{k}")
    with pytest.raises(FileNotFoundError):
        files.publish_all(spark, [(f"{home}/sa", f"{home}/fa"), (f"{home}/missing", f"{home}/fb")])
    assert not os.path.exists(f"{home}/fa")
    with pytest.raises(FileExistsError):
        files.publish_all(spark, [(f"{home}/sa", f"{home}/f"), (f"{home}/sb", f"{home}/f")])
    files.publish_all(spark, [(f"{home}/sa", f"{home}/fa"), (f"{home}/sb", f"{home}/fb")])
    assert spark.read.parquet(f"{home}/fb").count() == 2


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    lineage.log_run(spark, path, "zonal", "r1", "raster", "m", {"b": 2, "a": 1})
    lineage.log_run(spark, path, "views", "r2", "raster")
    lineage.log_run(spark, path, "zonal", "r1", "raster", "km")
    got = {r.run_id: r for r in lineage.run_log(spark, path).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].units == "km" and got["r2"].params_json == "{}"


def test_fields(spark):
    t = spark.createDataFrame([], "fid int, osm_id long, height double, mean double, note string, land_use string, r int")
    assert records.fields_of(t, ("mean",)) == (["mean", "height"], "land_use") and records.height_field(t) == "height"
    assert records.fields_of(t.withColumn("Layer", F.lit("x")))[1] == "Layer" and records.height_field(t.drop("height")) is None
    assert records.common_fields(t, t.select("note", "r")) == ["note", "r"] and records.common_fields() == []
    assert records.of_codes(t, ("a",), "Code") is t
    v = spark.createDataFrame([("1.5",), ("inf",), ("x",), (None,), ("nan",)], "v string").select(records.finite(F.col("v")).alias("v")).collect()
    assert [r.v for r in v] == [1.5, None, None, None, None]
    assert spark.range(1).select(records.safe_file(F.lit(' a/b: "c"  d '))).first()[0] == "a_b___c__d"


def test_small_rules():
    assert [decision.view_mode(*a) for a in ((3,), (21,), (3, False, True), (3, True, True), (3, False, False, True))] == ["flags", "union", "count", "weighted", "union"]
    assert decision.preferences("target", 0, 10, 20) == {"target": 5.0} and decision.preferences("target", 0, 10, 4) == {"target": 4}
    assert decision.preferences("range", 0, 8, span=(5, 3)) == {"span": (2.0, 6.0)} and decision.preferences("range", 0, 8, span=(1, 3)) == {"span": (1, 3)}
    assert decision.preferences("reclass", 9, 1) == {"ranges": [(1, 9, 1.0)]} and decision.preferences("benefit", 0, 1) == {}
    assert decision.grouped(["a", "b", "c"], {"g": ["b", "x", "b"], "h": ["b"]}) == {"g": ["b"], "a": ["a"], "c": ["c"]}
    assert decision.snapped(0.3) == pytest.approx(1 / 3) and decision.snapped(6.6) == 7 and decision.snapped(40) == 9
    assert layers.widened_step(1000, 1000, 1e6, 50) == 50
    step = layers.widened_step(10_000, 10_000, 1e8, 10)
    assert 7000 < (10_000 / step + 1) ** 2 < 9000
    assert layers.widened_step(10_000, 10_000, 1.0, 1.0) > 12


def test_polygon_points(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    horseshoe = ring((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10))
    row = spark.range(1).select(vector.representative(horseshoe).alias("p"), vector.centroid(horseshoe).alias("c"), horseshoe.alias("ring")).select("p", "c", vector.contains(F.col("ring"), F.col("p.x"), F.col("p.y")).alias("in"), vector.contains(F.col("ring"), F.col("c.x"), F.col("c.y")).alias("off")).first()
    assert row["in"] and not row.off
    fixed = spark.range(1).select(vector.repaired(ring((0, 0), (0, 0), (1, 0), (1, 1), (0, 0))).alias("a"), vector.repaired(ring((0, 0), (1, 0), (0, 0))).alias("b")).first()
    assert [(p.x, p.y) for p in fixed.a] == [(0, 0), (1, 0), (1, 1)] and fixed.b is None
    assert spark.range(1).select(profile.length_of(ring((0, 0), (3, 4), (3, 5)))).first()[0] == 6.0
    points = vector.boundary_points(spark.range(1).select("id", ring((0, 0), (10, 0), (10, 10), (0, 10)).alias("ring")), 1.0, most=4).orderBy("i").collect()
    assert [(p.x, p.y) for p in points] == [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_proximity_graphs(spark):
    rng = np.random.default_rng(12)
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (60, 2)))], "id long, x double, y double")
    links = {k: {(r.a, r.b) for r in graph.proximity(k, t, 3, 40.0 if k == "threshold" else None).collect()} for k in ("knn", "mutual", "threshold", "delaunay", "gabriel", "rng")}
    assert links["rng"] <= links["gabriel"] <= links["delaunay"] and links["mutual"] <= links["knn"] and len(links["threshold"]) > len(links["knn"])
    with pytest.raises(ValueError):
        graph.proximity("threshold", t)


def test_hub_network(spark):
    inf = float("inf")
    costs = spark.createDataFrame([(1, 2, 5.0, 7.0), (1, 3, 4.0, 9.0), (2, 3, 1.0, 1.0), (3, 4, 2.0, inf), (2, 4, 8.0, 8.0)], "a long, b long, forth double, back double")
    hubs = spark.createDataFrame([(2,), (3,)], "id long")
    assert sorted(map(tuple, routes.hub_edges(costs, hubs).collect())) == [(1, 3, "hub_link"), (2, 3, "hub_mst"), (2, 4, "hub_link")]
    assert {r.kind for r in routes.network(costs, 1, hubs).collect()} == {"mst", "knn", "hub_link", "hub_mst"}
    sites = spark.createDataFrame([(k, f"s{k}" if k != 4 else None, k * 3, 0) for k in (1, 2, 3, 4)], "id long, name string, x long, y long")
    with pytest.raises(ValueError):
        routes.network(costs, 1, sites=sites.select("id").unionAll(hubs.select(F.col("id") + 50)))
    table = routes.edge_table(routes.network(costs, 1), costs, sites, "tobler", 10.0)
    row = table.where("kind = 'mst' AND from_id = 1").first()
    assert row.time_ab * 60 == 5 and row.dist_m == 30.0 and row.from_nm == "s1"
    assert {(r.a, r.b): r.w for r in routes.weights_of(table).collect()}[1, 2] == pytest.approx(0.1)


def test_samples(spark):
    t = spark.createDataFrame([(1, 1.00000001, 2.0, 4.0), (2, 1.0, 2.0, 8.0), (3, 5.0, 5.0, None)], "seq long, x double, y double, z double")
    assert [tuple(r) for r in sampling.averaged(t, "seq").collect()] == [(1.0, 2.0, 6.0, 2)]
    assert sampling.even_grid(spark, 0, 100, 0, 50, 50).count() == 50


def test_stack(spark, tmp_path):
    target, fine = Grid(0.0, 40.0, 10.0, 4, 4), Grid(0.0, 40.0, 5.0, 8, 8)
    coarse = target.cells(spark).withColumn("z", (F.col("r") * 4 + F.col("c")).cast("double"))
    classes = fine.cells(spark).withColumn("z", (F.col("c") % 3).cast("double"))
    home = str(tmp_path)
    surveys.write_stack({"height": (coarse, target, "continuous"), "soil": (classes, fine, "classes")}, target, f"{home}/stack", "r1")
    assert spark.read.parquet(f"{home}/stack/height").count() == 16
    soil = {(r.r, r.c): r.z for r in spark.read.parquet(f"{home}/stack/soil").collect()}
    assert len(soil) == 16 and set(soil.values()) <= {0.0, 1.0, 2.0}
    rows = spark.read.option("header", True).csv(f"{home}/stack/manifest.csv").collect()
    assert {(r.variable, r.resampling) for r in rows} == {("height", "bilinear"), ("soil", "nearest")}
    with pytest.raises(ValueError):
        surveys.write_stack({"away": (coarse, Grid(900.0, 40.0, 10.0, 4, 4), "continuous")}, target, f"{home}/other", "r2")
    assert sorted(os.listdir(home)) == ["stack"]


def test_surfaces_and_views(spark):
    grid = Grid(0.0, 100.0, 10.0, 10, 10)
    t = spark.createDataFrame([(k, float(x), float(y), float(2 * x + y), "7111" if k % 2 else "x") for k, (x, y) in enumerate(np.random.default_rng(6).uniform(-20, 120, (120, 2)))], "id long, x double, y double, z double, Layer string")
    plane = surveys.surface([t.where("id < 60"), t.where("id >= 60").withColumn("more", F.lit(1))], grid, "tin").collect()
    assert len(plane) == 100 and all(r.z == pytest.approx(2 * (r.c * 10 + 5) + 100 - (r.r * 10 + 5)) for r in plane)
    assert surveys.surface([t], grid, "kriging", ("7111",)).count() == 100
    with pytest.raises(ValueError):
        surveys.surface([t], grid, "spline")
    cells = grid.cells(spark).withColumn("z", F.when(F.col("c") == 5, 50.0).otherwise(0.0))
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((12, 42), (28, 42), (28, 58), (12, 58))])
    p = spark.range(1).select("id", square.alias("ring"))
    seen = {(r.r, r.c): r.visible for r in surveys.outline_view(p, cells, grid, 5.0, 12).collect()}
    assert seen[5, 4] and not seen[5, 8] and len(seen) == 100
    assert surveys.outline_view(p, cells, grid, 5.0, 12, cut_out=True).count() == 100 - 4
    assert surveys.covariate_table(spark.createDataFrame([("a", "b", None)], "a string, b string, r double"), spark.createDataFrame([("a", float("inf"), "bad")], "column string, vif double, level string")).collect()[0].value == "inf"


def test_quantiles_of_infinite_values(spark, monkeypatch):
    inf = float("inf")
    monkeypatch.setattr(quantile, "FEW", 10)
    for values in ([inf, *range(50)], [-inf, inf, *range(49)], [inf] * 30 + [1.0], [1e308, -1e308, *range(50)], [-inf] * 3):
        t = spark.createDataFrame([(float(v),) for v in values], "v double")
        order = sorted(map(float, values))
        for share in (0, 0.25, 0.5, 0.99, 1):
            at = share * (len(order) - 1)
            a, b = order[int(at)], order[min(int(at) + 1, len(order) - 1)]
            want = a if at == int(at) or a in (inf, -inf) else a + (at - int(at)) * (b - a)
            assert quantile.quantile(t, F.col("v"), share) == pytest.approx(want)


def test_numbered_names_are_free(spark):
    names = ["a", "a", "a_2", "a", "a_4", "a_2", "a_2_2", "a_02", "", None, "layer_2", "a_99999999999"]
    t = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = [r.key for r in records.numbered_names(t, F.col("name"), "id").orderBy("id").collect()]
    assert got == ["a", "a_3", "a_2", "a_5", "a_4", "a_2_3", "a_2_2", "a_02", "layer", "layer_3", "layer_2", "a_99999999999"]
