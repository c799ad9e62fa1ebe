"""Column expressions on values with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from holloway.functions import classes, legend, movement, scoring
from holloway.operators import decision
from holloway.sources.grid import Grid


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column).first()[0]


def cost(spark, model, h, dz, mode="time", **p):
    return value(spark, movement.step_cost(model, F.col("h"), F.col("dz"), mode, **p), h=h, dz=dz)


def test_movement(spark):
    assert cost(spark, "naismith", 1000, 0) == pytest.approx(720)
    assert cost(spark, "naismith", 1000, -100) == pytest.approx(720)
    assert cost(spark, "unknown", 1000, 600) == pytest.approx(720 + 3600)
    assert cost(spark, "tobler", 100, -5) == pytest.approx(100 / (6 / 3.6))
    assert cost(spark, "pandolf", 100, -50, "energy") == pytest.approx(1.5 * 70 * 100 / (5 / 3.6))
    assert cost(spark, "herzog", 100, 0) == cost(spark, "conolly", 100, 0) == pytest.approx(72)
    assert cost(spark, "wheeled", 10, 100) == math.inf
    assert all(cost(spark, m, 0, 5) == 0 for m in movement.TIME)
    assert movement.isochrone_levels(50) == [15, 30, 45] and movement.isochrone_levels(70) == [15, 30, 45, 60]
    assert movement.isochrone_levels(math.nan) == [] and len(movement.isochrone_levels(1e9)) == 60 and len(movement.isoenergy_levels(1e9)) == 80


def test_scores(spark):
    s = lambda v, mode, **o: value(spark, scoring.score(F.col("v"), mode, 0.0, 100.0, **o), v=v)
    assert [s(v, "benefit") for v in (-5, 25, 200, None)] == [0, 0.25, 1, None]
    assert s(25, "cost") == 0.75 and s(25, "nonsense") == 0.25
    assert s(25, "target", target=25) == 1 and s(50, "target", target=900) == 1 and s(0, "target", target=0) == 1
    assert s(50, "range") == 1 and s(12.5, "range") == 0.5 and s(None, "range") is None
    table = [{"min": 0, "max": 50, "score": 0.2}, {"min": 100, "max": 50, "score": 0.9}]
    assert [s(v, "reclass", ranges=table) for v in (0, 49, 50, 100, 101, None)] == [0.2, 0.2, 0.9, 0.9, 0, None]
    with pytest.raises(ValueError):
        scoring.score_ranges([{"min": 0, "max": 50, "score": 1}, {"min": 40, "max": 60, "score": 1}])


def test_legend(spark):
    ramp = [(0.0, (0, 0, 0)), (10.0, (255, 255, 255))]
    v = lambda rgb, **o: value(spark, legend.value_of_colour(F.col("r"), F.col("g"), F.col("b"), ramp, **o), r=rgb[0], g=rgb[1], b=rgb[2])
    assert v((255, 0, 0)) == pytest.approx(10 / 3) and v((153, 153, 153)) == pytest.approx(6)
    assert v((153, 153, 153), snap=0.5) == 10 and v((300, 300, 300)) == 10
    for name in ("fe2o3", "zn"):
        pixels = spark.createDataFrame([(float(x), *c) for x, c in legend.preset(name)], "x double, r int, g int, b int")
        rows = pixels.select("x", legend.value_of_colour(F.col("r"), F.col("g"), F.col("b"), legend.preset(name)).alias("v")).collect()
        assert len(legend.PRESETS) == 7 and all(r.v == pytest.approx(r.x) for r in rows)
    assert [value(spark, legend.class_of(F.col("v"), [0, 10, 20]), v=x) for x in (-1, 10, 25, None)] == [1, 2, 2, 0]


def test_classes(spark):
    position = lambda t, s: value(spark, classes.slope_position(F.col("t"), F.col("s")), t=t, s=s)
    assert [position(t, s) for t, s in ((-2, 0), (-0.7, 0), (0, 5), (0, 6), (1, 0), (1.1, 0), (None, 1))] == [1, 2, 3, 4, 5, 6, 0]
    assert [value(spark, classes.compass8(F.col("b")), b=b) for b in (0, 22.5, 359, 180)] == ["N", "NE", "N", "S"]
    assert [value(spark, classes.distance_phrase(F.col("m")), m=m) for m in (0.2, 99.6, 1500)] == ["touching", "100 m", "1.5 km"]


def test_grid():
    g = Grid.covering(0.2, 10.45, -1.3, 6.9, 1.7)
    assert (g.width, g.height) == (6, 5) and g.xmax == pytest.approx(10.4) and g.ymin == pytest.approx(-1.6)
    assert [Grid.covering(0, s, 0, 1, 1).width for s in (9.49, 9.5, 10.5, 0.1)] == [9, 10, 11, 1]
    assert g.mismatches(g) == [] and "xmin" in g.mismatches(Grid(g.xmin + 1.7, g.ymax, g.res, 6, 5))
    with pytest.raises(ValueError):
        Grid.covering(0, 0, 0, 1, 1)


def test_pairwise_weights():
    m = decision.matrix(["a", "b", "c"], {("a", "b"): 9.0, ("b", "c"): 9.0, ("c", "a"): 9.0})
    assert decision.weights(m)[2] > 0.1 and math.isnan(decision.weights(decision.matrix([str(i) for i in range(16)], {}))[2])
    w = decision.hierarchy({"g": ["x", "y"], "h": ["z"]}, {("g", "h"): 2.0}, {("x", "y"): 3.0})
    assert [round(w[k], 4) for k in "xyz"] == [0.5, 0.1667, 0.3333]
