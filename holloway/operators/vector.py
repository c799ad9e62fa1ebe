"""Polygons as arrays of vertices (struct of x, y; not closed), measured with higher-order functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..lineage import TASKS, dealt, stored
from ..sources.grid import Grid
from .components import components, joined

#: Cells along a side of the blocks in which areas are found first.
REGION_BLOCK = 256
#: Polygons of each side, and corners, that a task overlays at once, and pairs (or pairs of sides) in one of its arrays.
TOGETHER, CORNERS, AT_ONCE = 1500, 100_000, 1 << 20


def rectangle(x: Column, y: Column, length: float, width: float, bearing: Column) -> Column:
    """A rectangle round a centre; its length lies along the bearing (degrees clockwise from north)."""
    dx, dy = F.sin(F.radians(bearing)), F.cos(F.radians(bearing))
    corner = lambda a, b: F.struct((x + dx * (a * length / 2) + dy * (b * width / 2)).alias("x"), (y + dy * (a * length / 2) - dx * (b * width / 2)).alias("y"))
    return F.array(corner(1, 1), corner(-1, 1), corner(-1, -1), corner(1, -1))


def _sides(ring: Column) -> Column:
    """Each vertex with the next one."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("p"), after.alias("q"))


def area(ring: Column) -> Column:
    """Area by the shoelace formula; rings of either direction."""
    cross = F.transform(_sides(ring), lambda s: s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def perimeter(ring: Column) -> Column:
    return F.aggregate(F.transform(_sides(ring), lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])), F.lit(0.0), lambda a, x: a + x)


def centroid(ring: Column) -> Column:
    """Struct of x and y: the centre of mass, taken from the first vertex on for precision."""
    o = F.element_at(ring, 1)
    local = F.transform(ring, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))
    terms = F.transform(_sides(local), lambda s: F.struct((s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]).alias("w"), (s["p"]["x"] + s["q"]["x"]).alias("x"), (s["p"]["y"] + s["q"]["y"]).alias("y")))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["w"])
    mean = lambda k: F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["w"] * t[k]) / (3 * total)
    return F.struct((o["x"] + mean("x")).alias("x"), (o["y"] + mean("y")).alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the even-odd rule."""
    crossed = F.filter(_sides(ring), lambda s: ((s["p"]["y"] > y) != (s["q"]["y"] > y)) & (x < (s["q"]["x"] - s["p"]["x"]) * (y - s["p"]["y"]) / F.nullif(s["q"]["y"] - s["p"]["y"], F.lit(0.0)) + s["p"]["x"]))
    return F.size(crossed) % 2 == 1


def _meeting(left: DataFrame, right: DataFrame, sides: Column, by: tuple[str, ...] = ()) -> tuple[DataFrame, tuple[float, float]]:
    """Pairs (a, b, a_whole, sides and rings of both) of polygons (id, ring) whose boxes meet, and the least x and y of the left ones.

    Boxes meet in square buckets as wide as boxes are on average, or a 256th of the widest; a pair counts in the first bucket that it shares.
    """
    ends = {f"{v}{k}": f(F.col(f"ring.{v}")) for v in "xy" for k, f in ((0, F.array_min), (1, F.array_max))}
    boxed = [t.select(*by, F.col("id").alias(k), area(F.col("ring")).alias(f"{k}_whole"), sides.alias(f"{k}_sides"), F.col("ring").alias(f"{k}_ring"), *[e.alias(f"{k}{n}") for n, e in ends.items()]) for t, k in ((left, "a"), (right, "b"))]
    wide = [F.greatest(F.col(f"{k}x1") - F.col(f"{k}x0"), F.col(f"{k}y1") - F.col(f"{k}y0")) for k in "ab"]
    facts = [t.agg(F.avg(w), F.max(w), F.min(f"{k}x0"), F.min(f"{k}y0")).first() for t, w, k in zip(boxed, wide, "ab", strict=True)]
    size = max([f[0] or 0.0 for f in facts] + [(f[1] or 0.0) / 256 for f in facts] + [1e-9])
    ox, oy = facts[0][2] or 0.0, facts[0][3] or 0.0
    filed = []
    for t, k in zip(boxed, "ab", strict=True):
        steps = [F.sequence(F.floor(F.col(f"{k}{v}0") / size), F.floor(F.col(f"{k}{v}1") / size)) for v in "xy"]
        filed.append(t.select("*", F.explode(steps[0]).alias("u")).select("*", F.explode(steps[1]).alias("v")))
    met = filed[0].join(filed[1], [*by, "u", "v"]).where("ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1")
    once = met.where((F.col("u") == F.floor(F.greatest("ax0", "bx0") / size)) & (F.col("v") == F.floor(F.greatest("ay0", "by0") / size)))
    return once.select(*by, "a", "b", "a_whole", "a_sides", "b_sides", "a_ring", "b_ring"), (float(ox), float(oy))


def meeting(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, a_ring, b_ring) of polygons (by, id, ring) with equal columns ``by`` whose boxes meet."""
    return _meeting(left, right, F.lit(None), by)[0].select(*by, "a", "b", "a_ring", "b_ring")


class Shapes:
    """The polygons (id, x, y) of one side of a group as arrays: all corners behind one another, the first one and the number of each polygon's, and its box."""

    def __init__(self, t: pa.Table):
        xs, ys = (t[k].combine_chunks() for k in ("x", "y"))
        self.id, self.x, self.y = t["id"], xs.flatten().to_numpy(zero_copy_only=False), ys.flatten().to_numpy(zero_copy_only=False)
        self.n = xs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.after = np.arange(1, len(self.x) + 1)
        self.after[self.first + self.n - 1] = self.first
        self.box = [f.reduceat(v, self.first) for v in (self.x, self.y) for f in (np.minimum, np.maximum)]


def ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` items of each row: the row, and the item's number in it."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _met(a: Shapes, b: Shapes, u: int, v: int, size: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of polygons whose boxes meet and that count in the bucket (u, v), in blocks."""
    step = max(1, AT_ONCE // len(b.n))
    for lo in range(0, len(a.n), step):
        x0, x1, y0, y1 = (k[lo : lo + step, None] for k in a.box)
        i, j = np.nonzero((x0 <= b.box[1]) & (b.box[0] <= x1) & (y0 <= b.box[3]) & (b.box[2] <= y1))
        own = (np.floor(np.maximum(a.box[0][i + lo], b.box[0][j]) / size) == u) & (np.floor(np.maximum(a.box[2][i + lo], b.box[2][j]) / size) == v)
        yield i[own] + lo, j[own]


def paired(left: DataFrame, right: DataFrame, kernel, schema: str, most: int) -> DataFrame:
    """What ``kernel(a, b, blocks of pairs (i, j))`` makes, as Arrow tables, of polygons (id, ring) of two tables whose boxes meet; no pair is a row before.

    Boxes meet in square buckets as wide as boxes are on average, or a 256th of the widest; a pair counts in the first bucket that it shares. The polygons
    of a bucket are dealt into parts of some ``most`` (and some CORNERS corners) on both sides; a task gets a part of each at a time, so its memory does not grow with a bucket.
    """
    boxed = []
    for t in (left, right):
        t = t.where(F.size("ring") > 0).select("id", *[F.col(f"ring.{v}").cast("array<double>").alias(v) for v in "xy"])
        boxed.append(t.select("*", *[f(v).alias(f"{v}{k}") for v in "xy" for k, f in ((0, F.array_min), (1, F.array_max))]))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    facts = [t.agg(F.avg(wide), F.max(wide)).first() for t in boxed]
    size = max([f[0] or 0.0 for f in facts] + [(f[1] or 0.0) / 256 for f in facts] + [1e-9])
    filed = []
    for t in boxed:
        steps = [F.sequence(F.floor(F.col(f"{v}0") / size), F.floor(F.col(f"{v}1") / size)) for v in "xy"]
        filed.append(t.select("id", "x", "y", F.explode(steps[0]).alias("u"), steps[1].alias("vs")).select("id", "x", "y", "u", F.explode("vs").alias("v")))
    counts = [t.groupBy("u", "v").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum(F.size("x")) / CORNERS)).cast("int").alias(k)) for t, k in zip(filed, "mn", strict=True)]
    grid = stored(counts[0].join(counts[1], ["u", "v"]))
    groups = grid.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    sides = []
    for t, own, other, k, l in ((filed[0], "m", "n", "g", "h"), (filed[1], "n", "m", "h", "g")):  # noqa: E741
        part = t.join(grid, ["u", "v"]).withColumn(k, F.pmod(F.xxhash64("id", "x", "y"), F.col(own)).cast("int")).withColumn(l, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        part = part.select("u", "v", "g", "h", "id", "x", "y")
        sides.append((dealt(part, "u", "v", "g", "h", tasks=max(TASKS, groups // 8)) if groups > TASKS else part).groupBy("u", "v", "g", "h"))

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            return empty
        a, b = Shapes(p), Shapes(q)
        return kernel(a, b, _met(a, b, p["u"][0].as_py(), p["v"][0].as_py(), size))

    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _upper_sides(s: Shapes, ox: float, oy: float) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Of each polygon how many sides are not upright, and in rows, filled up with sides of no width: where they begin and end, height at x = 0 and slope (an upright side has no ground below it), and the sign of their way."""
    row, _ = ragged(s.n)
    px, py, qx, qy = s.x - ox, s.y - oy, s.x[s.after] - ox, s.y[s.after] - oy
    at = np.flatnonzero(px != qx)
    n = np.bincount(row[at], minlength=len(s.n))
    k = ragged(n)[1]
    out = [np.zeros((len(n), n.max())) for _ in range(5)]
    slope = (qy[at] - py[at]) / (qx[at] - px[at])
    for o, v in zip(out, (np.minimum(px, qx)[at], np.maximum(px, qx)[at], py[at] - slope * px[at], slope, np.sign(qx - px)[at]), strict=True):
        o[row[at], k] = v
    return n, tuple(out)


def _shared_areas(a: Shapes, b: Shapes, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Kernel of overlay(). Coordinates are taken from the group's corner, for precision; polygons of ``b`` with some numbers of sides are looked at together, one side of ``a`` after the other."""
    ox, oy = min(a.box[0].min(), b.box[0].min()), min(a.box[2].min(), b.box[2].min())
    x, y = a.x - ox, a.y - oy
    whole = np.abs(np.add.reduceat(x * y[a.after] - x[a.after] * y, a.first)) / 2
    (na, sides_a), (nb, sides_b) = _upper_sides(a, ox, oy), _upper_sides(b, ox, oy)
    wide, out = np.ceil(np.log2(np.maximum(nb, 1))).astype(int), []
    for i, j in blocks:
        for c in np.unique(wide[j]):
            some = np.flatnonzero(wide[j] == c)
            most = int(nb[wide == c].max())
            step = max(1, AT_ONCE // 32 // max(1, most))
            for lo in range(0, len(some), step):
                p, q = i[some[lo : lo + step]], j[some[lo : lo + step]]
                tlo, thi, tc, tm, ts = (v[q, :most] for v in sides_b)
                shared = np.zeros(len(p))
                for k in range(int(na[p].max())):
                    slo, shi, sc, sm, ss = (v[p, k, None] for v in sides_a)
                    low, high = np.maximum(slo, tlo), np.minimum(shi, thi)
                    w, dc, dm = np.maximum(high - low, 0.0) * ts, sc - tc, sm - tm
                    d0, d1 = dc + dm * low, dc + dm * high
                    far = np.abs(d0) + np.abs(d1)
                    apart = far + 2 * np.minimum(d0 * d1, 0.0) / (far + 1e-300)  # twice the mean distance of the two lines
                    shared += ss[:, 0] * np.einsum("ij,ij->i", w, 2 * (sc + tc) + (sm + tm) * (low + high) - apart)
                shared = np.abs(shared) / 4
                kept = shared > 1e-9 * whole[p]
                out.append((p[kept], q[kept], shared[kept]))
    p, q = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    shared = np.concatenate([o[2] for o in out]) if out else np.zeros(0)
    return pa.table({"a": a.id.take(p), "b": b.id.take(q), "shared": shared, "outside": np.maximum(0.0, whole[p] - shared)})


def overlay(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, shared, outside): of polygons (id, ring) whose boxes meet, the area that they share, if any, and what is left of ``a``.

    No polygon is cut. Whether a place is inside one is the sum, over the sides above it, of +1 for sides that run one way and
    -1 for the others; so the shared area is the sum over pairs of sides, with the product of their signs, of the area under both.
    """
    kind = [t.schema["id"].dataType.simpleString() for t in (left, right)]
    return paired(left, right, _shared_areas, f"a {kind[0]}, b {kind[1]}, shared double, outside double", TOGETHER)


def _crosses(p: Column, q: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether the straight line from p to q has a point in a box: the part of it that each side of the box leaves is not empty."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for d, at, lo, hi in ((dx, p["x"], x0, x1), (dy, p["y"], y0, y1)):
        a, b = (lo - at) / F.nullif(d, F.lit(0.0)), (hi - at) / F.nullif(d, F.lit(0.0))
        flat = F.when((d == 0) & ((at < lo) | (at > hi)), F.lit(2.0)).otherwise(F.lit(0.0))
        enter += [F.coalesce(F.least(a, b), F.lit(0.0)), flat]
        leave.append(F.coalesce(F.greatest(a, b), F.lit(1.0)))
    return F.greatest(*enter) <= F.least(*leave)


def length_in_box(p: Column, q: Column, box: tuple[float, float, float, float]) -> Column:
    """The length of a straight line that lies in a box (xmin, xmax, ymin, ymax)."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for d, at, lo, hi in ((dx, p["x"], *box[:2]), (dy, p["y"], *box[2:])):
        a, b = (lo - at) / F.nullif(d, F.lit(0.0)), (hi - at) / F.nullif(d, F.lit(0.0))
        outside = F.when((d == 0) & ((at < lo) | (at > hi)), F.lit(2.0)).otherwise(F.lit(0.0))
        enter += [F.coalesce(F.least(a, b), F.lit(0.0)), outside]
        leave.append(F.coalesce(F.greatest(a, b), F.lit(1.0)))
    return F.greatest(F.lit(0.0), F.least(*leave) - F.greatest(*enter)) * F.hypot(dx, dy)


def line_crossings(lines: DataFrame, features: DataFrame, size: float) -> DataFrame:
    """(id, other, t, x, y): where each line (id, x1, y1, x2, y2) crosses the features' lines (id, x1, y1, x2, y2), at the share ``t`` of its length.

    Lines meet in the squares of width ``size`` that their boxes touch; a crossing counts in the square where it lies.
    """
    def filed(t: DataFrame, p: str) -> DataFrame:
        span = lambda k: F.explode(F.sequence(F.floor(F.least(f"{p}{k}1", f"{p}{k}2") / size), F.floor(F.greatest(f"{p}{k}1", f"{p}{k}2") / size)))
        return t.select(F.col("id").alias(p), *[F.col(k).cast("double").alias(f"{p}{k}") for k in ("x1", "y1", "x2", "y2")]).withColumn("bx", span("x")).withColumn("by", span("y"))

    both = filed(lines, "a").join(filed(features, "b"), ["bx", "by"]).selectExpr("*", "(ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1) AS cross").where("cross <> 0")
    at = both.selectExpr("*", "((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / nullif(cross, 0) AS t", "((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / nullif(cross, 0) AS u").where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    at = at.selectExpr("a AS id", "b AS other", "t", "ax1 + t * (ax2 - ax1) AS x", "ay1 + t * (ay2 - ay1) AS y", "bx", "by")
    return at.where((F.floor(F.col("x") / size) == F.col("bx")) & (F.floor(F.col("y") / size) == F.col("by"))).drop("bx", "by")


def long_axis(ring: Column) -> Column:
    """The bearing (0 to 180 degrees) of the long side of the least rectangle round a polygon; of equally small ones the first.

    One side of that rectangle lies along a side of the convex hull, which joins two vertices; so the directions between all pairs of vertices are tried.
    """
    pairs = F.flatten(F.transform(ring, lambda p: F.transform(F.filter(ring, lambda q: (q["x"] != p["x"]) | (q["y"] != p["y"])), lambda q: F.struct((q["x"] - p["x"]).alias("x"), (q["y"] - p["y"]).alias("y")))))

    def box(d: Column) -> Column:
        n = F.hypot(d["x"], d["y"])
        along = F.transform(ring, lambda p: (p["x"] * d["x"] + p["y"] * d["y"]) / n)
        over = F.transform(ring, lambda p: (p["x"] * d["y"] - p["y"] * d["x"]) / n)
        length, width = F.array_max(along) - F.array_min(along), F.array_max(over) - F.array_min(over)
        bearing = F.degrees(F.atan2(d["x"], d["y"])) + F.when(length >= width, 0.0).otherwise(90.0)
        return F.struct(F.round(length * width, 6).alias("area"), F.round(F.pmod(F.round(bearing, 9), F.lit(180.0)), 6).alias("bearing"))

    return F.array_min(F.transform(pairs, box))["bearing"]


def representative(ring: Column) -> Column:
    """A point that is inside the polygon: its centroid, or else the middle of the widest inner stretch at half its height."""
    y = (F.array_min(F.transform(ring, lambda p: p["y"])) + F.array_max(F.transform(ring, lambda p: p["y"]))) / 2 + 1e-7
    hits = F.array_sort(F.transform(F.filter(_sides(ring), lambda s: (s["p"]["y"] > y) != (s["q"]["y"] > y)), lambda s: s["p"]["x"] + (y - s["p"]["y"]) / (s["q"]["y"] - s["p"]["y"]) * (s["q"]["x"] - s["p"]["x"])))
    runs = F.transform(F.sequence(F.lit(1), F.size(hits) - 1, F.lit(2)), lambda k: F.struct((F.element_at(hits, k + 1) - F.element_at(hits, k)).alias("w"), ((F.element_at(hits, k + 1) + F.element_at(hits, k)) / 2).alias("x")))
    middle = centroid(ring)
    return F.when(contains(ring, middle["x"], middle["y"]), middle).otherwise(F.struct(F.array_max(runs)["x"].alias("x"), y.alias("y")))


def repaired(ring: Column) -> Column:
    """A ring without repeated vertices in a row and without the first one again at its end; null if fewer than three are left."""
    kept = F.aggregate(ring, F.slice(ring, 1, 0), lambda a, p: F.when(F.size(a) == 0, F.array(p)).when(F.element_at(a, -1) == p, a).otherwise(F.concat(a, F.array(p))))
    open_ = F.when((F.size(kept) > 1) & (F.element_at(kept, -1) == F.element_at(kept, 1)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    return F.when(F.size(open_) >= 3, open_)


def boundary_points(polygons: DataFrame, step: float, most: int = 0, key: str = "id") -> DataFrame:
    """(key, i, x, y): points along each ring ``step`` apart, both ends of it; ``most`` widens the step. Points equal to a millimetre are one."""
    whole = polygons.select(key, "ring", perimeter(F.col("ring")).alias("length"))
    width = F.greatest(F.lit(step), F.col("length") / most) if most else F.lit(step)
    sides = whole.select(key, "length", width.alias("step"), F.posexplode(_sides(F.col("ring"))).alias("k", "s")).withColumn("own", F.hypot(F.col("s.q.x") - F.col("s.p.x"), F.col("s.q.y") - F.col("s.p.y")))
    w = Window.partitionBy(key).orderBy("k")
    sides = sides.withColumn("upto", F.sum("own").over(w)).withColumn("from", F.col("upto") - F.col("own")).withColumn("last", F.lead("k").over(w).isNull())
    n = F.floor(F.col("length") / F.col("step")) + 1
    places = F.filter(F.sequence(F.ceil(F.col("from") / F.col("step")), F.least(n, F.ceil(F.col("upto") / F.col("step")))), lambda i: (F.least(F.col("length"), i * F.col("step")) >= F.col("from")) & ((F.least(F.col("length"), i * F.col("step")) < F.col("upto")) | F.col("last")))
    at = sides.where("own > 0").select("*", F.explode(places).alias("i")).withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least("length", F.col("i") * F.col("step")) - F.col("from")) / F.col("own"))))
    points = at.select(key, "i", (F.col("s.p.x") + F.col("t") * (F.col("s.q.x") - F.col("s.p.x"))).alias("x"), (F.col("s.p.y") + F.col("t") * (F.col("s.q.y") - F.col("s.p.y"))).alias("y"))
    return points.groupBy(key, F.round(F.col("x") * 1000).alias("u"), F.round(F.col("y") * 1000).alias("v")).agg(F.min(F.struct("i", "x", "y")).alias("m")).select(key, "m.*")


def rasterized(polygons: DataFrame, grid: Grid, key: str = "id", touched: bool = False) -> DataFrame:
    """(key, r, c) of the cells whose centre is inside each polygon (column ``ring``), with ``touched`` also of those that its sides cross: only cells of its box are looked at."""
    low, high = (lambda k: F.array_min(F.col(f"ring.{k}"))), (lambda k: F.array_max(F.col(f"ring.{k}")))
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v)))
    box = polygons.select(key, "ring", clip((F.lit(grid.ymax) - high("y")) / grid.res, grid.height).alias("r0"), clip((F.lit(grid.ymax) - low("y")) / grid.res, grid.height).alias("r1"),
                          clip((low("x") - grid.xmin) / grid.res, grid.width).alias("c0"), clip((high("x") - grid.xmin) / grid.res, grid.width).alias("c1"))
    cells = box.select("*", F.explode(F.sequence("r0", "r1")).alias("r")).select("*", F.explode(F.sequence("c0", "c1")).alias("c"))
    inside = contains(F.col("ring"), grid.x("c"), grid.y("r"))
    if touched:
        half = grid.res / 2
        inside = inside | F.exists(_sides(F.col("ring")), lambda s: _crosses(s["p"], s["q"], grid.x("c") - half, grid.x("c") + half, grid.y("r") - half, grid.y("r") + half))
    return cells.where(inside).select(key, "r", "c")


def attribute_raster(polygons: DataFrame, grid: Grid, value: str, order: str, touched: bool = True) -> DataFrame:
    """(r, c, value): of overlapping polygons the one that comes last in ``order`` decides; of those with one ring only that one is rasterized."""
    marked = polygons.groupBy("ring").agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("id"))
    return rasterized(marked, grid, "id", touched).groupBy("r", "c").agg(F.max("id").alias("m")).select("r", "c", F.col("m.v").alias(value))


def _label_block(width: int, corners: bool):
    """Kernel: the cells (r, c, class) of one block, with the first cell of the area that each lies in as far as the block goes."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        r, c = t["r"].to_numpy(np.int64), t["c"].to_numpy(np.int64)
        kind, (h, w) = pd.factorize(t["class"])[0], (np.ptp(r) + 1, np.ptp(c) + 1)
        at = (r - r.min()) * w + c - c.min()
        grid = np.full(h * w, -1)
        grid[at] = kind
        place, grid = np.arange(h * w).reshape(h, w), grid.reshape(h, w)
        ways = [(np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:])] + ([(np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])] if corners else [])
        same = [(grid[p] == grid[q]) & (grid[p] >= 0) for p, q in ways]
        root = joined(h * w, np.concatenate([place[p][m] for (p, _), m in zip(ways, same, strict=True)]), np.concatenate([place[q][m] for (_, q), m in zip(ways, same, strict=True)]))[at]
        return t[["r", "c", "class"]].assign(region=(root // w + r.min()) * width + root % w + c.min())

    return run


def labelled_regions(cells: DataFrame, width: int, corners: bool = True) -> DataFrame:
    """(r, c, class, region) of the cells that have a class: connected areas of one class, named by their first cell; with ``corners`` cells that touch at one hang together.

    Areas are found in blocks of REGION_BLOCK cells a side first; only cells along the blocks' borders link the parts of an area.
    """
    size = REGION_BLOCK
    kinds = {k: cells.schema[k].dataType.simpleString() for k in ("r", "c", "class")}
    blocks = cells.where("class IS NOT NULL").select("r", "c", "class", F.floor(F.col("r") / size).alias("br"), F.floor(F.col("c") / size).alias("bc")).groupBy("br", "bc")
    parts = stored(blocks.applyInPandas(_label_block(width, corners), ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", region long"))
    edge = parts.where(" OR ".join(f"pmod({k}, {size}) IN (0, {size - 1})" for k in "rc"))
    moves = [(0, 1), (1, 0)] + ([(1, -1), (1, 1)] if corners else [])
    beside = edge.select("class", F.col("region").alias("a"), F.inline(F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in moves])))
    links = beside.join(edge.withColumnRenamed("region", "b"), ["r", "c", "class"]).where("a <> b").select("a", "b")
    roots = components(links)
    return parts.join(roots, F.col("region") == F.col("node"), "left").select("r", "c", "class", F.coalesce("root", "region").alias("region"))


def regions(cells: DataFrame, width: int, corners: bool = True) -> DataFrame:
    """(region, class, cells): the connected areas of one class (cells that touch, corners too); named by their first cell."""
    return labelled_regions(cells, width, corners).groupBy("region", "class").agg(F.count("*").alias("cells"))
