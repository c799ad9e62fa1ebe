"""Polygons, regions, files and reports."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from holloway.operators import decision, raster, vector
from holloway.sources import files, outcome
from holloway.sources.grid import Grid


def test_polygons(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3))])  # an L
    row = spark.range(1).select(vector.area(ring).alias("a"), vector.perimeter(ring).alias("p"), vector.centroid(ring).alias("c"), *[vector.contains(ring, F.lit(x), F.lit(y)).alias(n) for n, x, y in (("i", 3.5, 0.5), ("o", 3.5, 1.5), ("u", 0.5, 2.5))]).first()
    assert (row.a, row.p) == (6.0, 14.0) and (row.c.x, row.c.y) == pytest.approx((1.5, 1.0)) and (row.i, row.o, row.u) == (True, False, True)
    cells = vector.rasterized(spark.range(1).select("id", ring.alias("ring")), Grid(0.0, 3.0, 0.5, 8, 6)).count()
    assert cells == 24


def test_regions(spark):
    z = np.random.default_rng(3).integers(1, 4, (12, 15))
    cells = spark.createDataFrame([(r, c, int(z[r, c])) for r in range(12) for c in range(15)], "r long, c long, class int")
    seen, want = set(), {}
    for r in range(12):
        for c in range(15):
            if (r, c) not in seen:
                stack, n = [(r, c)], 0
                seen.add((r, c))
                while stack:
                    i, j = stack.pop()
                    n += 1
                    for k in range(max(0, i - 1), min(12, i + 2)):
                        for m in range(max(0, j - 1), min(15, j + 2)):
                            if (k, m) not in seen and z[k, m] == z[r, c]:
                                seen.add((k, m))
                                stack.append((k, m))
                want[r * 15 + c] = n
    assert {x.region: x.cells for x in vector.regions(cells, 15).collect()} == want


def test_ascii_grid(spark, tmp_path):
    grid = Grid(10.0, 50.0, 5.0, 3, 2)
    cells = spark.createDataFrame([(r, c, None if r == c else r * 3.5 + c) for r in range(2) for c in range(3)], "r long, c long, z double")
    files.write_ascii_grid(cells, grid, str(tmp_path / "g"))
    back, found = files.read_ascii_grid(spark, str(tmp_path / "g"))
    assert found == grid and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_legend_table(spark, tmp_path):
    (tmp_path / "l.csv").write_text("# a comment\nvalue,r,g,b\n3.5, 300, -4, 7\n1,2,3,4\n3.5,1,1,1\nbad\n")
    assert [tuple(r) for r in files.read_legend(spark, str(tmp_path / "l.csv")).collect()] == [(1.0, 2, 3, 4), (3.5, 1, 1, 1)]


def test_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "hello")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    rows = files.read_bundles(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.bundle), r.name, r.content and bytes(r.content), r.fault is None) for r in rows) == [("a.zip", "x.txt", b"hello", True), ("b.zip", None, None, False)]
    assert files.bundle_fault([(11 << 20, 10)]) and files.bundle_fault([(1, 1)] * 5001) and files.bundle_fault([(3 << 30, 3 << 30)]) and not files.bundle_fault([(100, 1)])


def test_publish(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "staged"))
    files.publish(spark, str(tmp_path / "staged"), str(tmp_path / "final"))
    assert spark.read.parquet(str(tmp_path / "final")).count() == 3
    spark.range(3).write.parquet(str(tmp_path / "staged"))
    with pytest.raises(FileExistsError):
        files.publish(spark, str(tmp_path / "staged"), str(tmp_path / "final"))
    assert [r.resampling for r in files.manifest([{"variable": "a"}, {"variable": "b", "kind": "classes"}], spark).collect()] == ["bilinear", "nearest"]


def test_outcome(spark):
    log = [(1, 1, False, True, False), (1, 2, True, False, False), (2, 1, True, False, False), (2, 2, False, True, False), (3, 1, True, False, False), (3, 0, False, False, True), (4, 0, False, True, False)]
    got = {r.run: r.reason for r in outcome.outcome(spark.createDataFrame(log, "run long, seq long, marker boolean, diagnostic boolean, fatal boolean")).collect()}
    assert got == {1: "ok", 2: "diagnostic after marker", 3: "fatal diagnostic", 4: "no marker"}


def test_masks(spark):
    cells = spark.range(4).select(F.lit(0).cast("long").alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("z"))
    mask = cells.where("c < 2").unionAll(cells.where("c < 1"))
    assert raster.keep(cells, mask).count() == 2 and raster.burn(cells, mask).where("z IS NULL").count() == 2 and raster.burn(cells, mask).count() == 4


def test_spaced_choice(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(rng.uniform(0, 100, (300, 3)))]
    got = decision.spaced(spark.createDataFrame(rows, "id long, x double, y double, score double"), 8, 15.0, 50.0).collect()
    assert len(got) == 8 and all((a.x - b.x) ** 2 + (a.y - b.y) ** 2 >= 225 for a in got for b in got if a.id < b.id)
    assert got[0].score == max(r[3] for r in rows)


@pytest.mark.parametrize("block, spacing", [(5000, 9.0), (3, 9.0), (2, 30.0)])
def test_spaced_choice_overlooks_nothing(spark, block, spacing):
    """Against the plain loop over squares in turns, with a clustered surface whose best candidates conflict."""
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), float(round(100 - abs(x - 50) - abs(y - 50), 3))) for i, (x, y) in enumerate(rng.normal(50, 14, (400, 2)))]
    squares = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        squares.setdefault((r[1] // 20, r[2] // 20), []).append(r)
    order, kept, at = sorted(squares, key=lambda k: (-squares[k][0][3], squares[k][0][0])), [], dict.fromkeys(squares, 0)
    progress = True
    while progress and len(kept) < 25:
        progress = False
        for k in order:
            while at[k] < len(squares[k]) and len(kept) < 25:
                r = squares[k][at[k]]
                at[k] += 1
                if all((r[1] - q[1]) ** 2 + (r[2] - q[2]) ** 2 >= spacing**2 for q in kept):
                    kept.append(r)
                    progress = True
                    break
    got = decision.spaced(spark.createDataFrame(rows, "id long, x double, y double, score double"), 25, spacing, 20.0, block).orderBy("rank").collect()
    assert [r.id for r in got] == [r[0] for r in kept]


def test_inflation(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 200))
    rows = [(float(x), float(y), float(x + 0.1 * z), 1.0) for x, y, z in zip(a, b, rng.normal(size=200), strict=True)]
    got = {r.column: r for r in decision.inflation(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c"]).collect()}
    assert got["a"].level == "bad" and got["b"].vif < 1.2
    x = np.array(rows)[:, :3]
    others = np.c_[np.ones(200), x[:, 1:]]
    fit = others @ np.linalg.lstsq(others, x[:, 0], rcond=None)[0]
    assert got["a"].vif == pytest.approx(1 / (1 - np.corrcoef(fit, x[:, 0])[0, 1] ** 2))


def test_ascii_grid_with_gaps(spark, tmp_path):
    """Cells without a row keep their place; so do rows of the grid without any cell."""
    grid = Grid(0.0, 40.0, 10.0, 3, 4)
    have = {(0, 0): 1.0, (0, 2): 3.0, (2, 0): 7.0, (2, 1): float("nan")}
    files.write_ascii_grid(spark.createDataFrame([(r, c, z) for (r, c), z in have.items()], "r long, c long, z double"), grid, str(tmp_path / "gaps"))
    back, again = files.read_ascii_grid(spark, str(tmp_path / "gaps"))
    assert again == grid
    assert {(r.r, r.c): r.z for r in back.collect()} == {(r, c): {(0, 0): 1.0, (0, 2): 3.0, (2, 0): 7.0}.get((r, c)) for r in range(4) for c in range(3)}
