"""Delaunay triangulations of sites (id, x, y) and linear surfaces over them.

A triangle of sites belongs to the triangulation when their Voronoi cells meet in a point. A site's cell needs only the sites near
it: it is cut from the box of all sites by the bisectors to its nearest neighbours, and is final when the farthest one is twice as
far as the cell's farthest corner. Sites that are not final go on with four times as many neighbours, so no task sees more than the
neighbours of single sites. Cells that reach the box are those of the sites along the border; these alone decide the diagram outside
the box, so they are searched once more, among themselves, in a box FAR times as wide.

Ties (four or more sites on a circle) are broken by small weights that depend on the ids, so every task breaks them alike. Sites in
one place count as one, under the smallest id; sites on one line, or less than three, have no triangles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..sources.grid import Grid
from .graph import nearest

#: Neighbours looked at first; width of the outer box in widths of the sites' box; weight of ties against the mean area of a site.
FIRST, FAR, TIE = 24, 1e5, 1e-8
#: Sites along the border that are sent to all tasks (24 bytes each); more are searched by nearest neighbours.
MOST_BORDER = 200_000

_LINK = [("b", pa.int64()), ("x1", pa.float64()), ("y1", pa.float64()), ("x2", pa.float64()), ("y2", pa.float64())]
_SCHEMA = pa.schema([("id", pa.int64()), ("final", pa.bool_()), ("border", pa.bool_()), ("links", pa.list_(pa.struct(_LINK)))])
#: A site's cell: whether it is final, whether it reaches the box, and its sides with the neighbours behind them.
CORNERS = "id long, final boolean, border boolean, links array<struct<b: long, x1: double, y1: double, x2: double, y2: double>>"


def _weight(ids: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that are no linear function of the ids: on a lattice of sites those would not break ties."""
    h = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            h = h * np.uint64(factor)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)) / float(1 << 53)


def cell(x: float, y: float, offsets: np.ndarray, reach: np.ndarray, box: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Corners, relative to the site, of its cell in ``box`` and the neighbour behind the side after each corner (-1: the box).

    The cell holds the places p with p . offsets <= reach; neighbours that do not cut it are passed over together.
    """
    corners = np.array([(box[0] - x, box[1] - y), (box[2] - x, box[1] - y), (box[2] - x, box[3] - y), (box[0] - x, box[3] - y)])
    behind, at = np.full(4, -1), 0
    while at < len(offsets):
        cuts = np.flatnonzero((offsets[at:] @ corners.T > reach[at:, None]).any(axis=1))
        if not len(cuts):
            break
        at += int(cuts[0])
        over = corners @ offsets[at] - reach[at]
        new, owner = [], []
        for i in range(len(corners)):
            j = (i + 1) % len(corners)
            if over[i] <= 0:
                new.append(corners[i])
                owner.append(behind[i])
            if (over[i] <= 0) != (over[j] <= 0):
                new.append(corners[i] + (corners[j] - corners[i]) * (over[i] / (over[i] - over[j])))
                owner.append(at if over[i] <= 0 else behind[i])
        if len(new) < 3:
            break
        corners, behind, at = np.array(new), np.array(owner), at + 1
    return corners, behind


def _row(i: int, x: float, y: float, ids: np.ndarray, px: np.ndarray, py: np.ndarray, box: tuple, tie: float, whole: bool) -> dict:
    """A row of CORNERS for a site and its neighbours; ``whole``: these are all other sites."""
    offsets = np.stack([px - x, py - y], axis=1)
    d2 = (offsets * offsets).sum(axis=1)
    order = np.argsort(d2, kind="stable")
    order = order[d2[order] > 0]
    ids, offsets, d2 = ids[order], offsets[order], d2[order]
    own = _weight(np.array([i]))[0]
    corners, behind = cell(x, y, offsets, (d2 + tie * (own - _weight(ids))) / 2, box)
    after = np.roll(corners, -1, axis=0)
    final = whole or len(d2) > 0 and d2[-1] >= 4 * (corners * corners).sum(axis=1).max() + 2 * tie
    links = [{"b": int(ids[b]), "x1": p[0] + x, "y1": p[1] + y, "x2": q[0] + x, "y2": q[1] + y} for b, p, q in zip(behind, corners.tolist(), after.tolist(), strict=True) if b >= 0]
    return {"id": i, "final": bool(final), "border": bool((behind < 0).any()), "links": links}


def _near_cells(box: tuple, tie: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.array([p["b"] for p in r["near"]], np.int64)
                rows.append(_row(r["id"], r["x"], r["y"], ids, np.array([p["x"] for p in r["near"]]), np.array([p["y"] for p in r["near"]]), box, tie, len(ids) >= n - 1))
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _among(sent, box: tuple, tie: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, y = sent.value
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                others = ids != r["id"]
                rows.append(_row(r["id"], r["x"], r["y"], ids[others], x[others], y[others], box, tie, True))
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _cells(sites: DataFrame, n: int, box: tuple, tie: float) -> DataFrame:
    """Final rows of CORNERS of all ``sites``, from ever more nearest neighbours."""
    todo, parts, k = sites, [], min(FIRST, max(1, n - 1))
    while True:
        pairs = nearest(todo, sites, k, same=True).join(sites.select(F.col("id").alias("b"), "x", "y"), "b")
        near = pairs.groupBy("a").agg(F.collect_list(F.struct("b", "x", "y")).alias("near"))
        rows = cut(todo.join(near, todo["id"] == near["a"]).select("id", "x", "y", "near").mapInArrow(_near_cells(box, tie, n), CORNERS))
        parts.append(rows.where("final"))
        todo = cut(todo.join(rows.where("NOT final").select("id"), "id", "left_semi"))
        if k >= n - 1 or todo.isEmpty():
            break
        k = min(4 * k, n - 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _voronoi(sites: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(a, b) and (a, b, c): the links and triangles, smaller ids first."""
    sites = cut(sites.where("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("id").cast("long").alias("id")).select("id", "x", "y"))
    x0, x1, y0, y1, n = sites.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if n < 2:
        return None
    span = max(x1 - x0, y1 - y0)
    box, tie = (x0, y0, x1, y1), TIE * max((x1 - x0) * (y1 - y0), span * span / n) / n
    if min(x1 - x0, y1 - y0) == 0:  # on one line along an axis the box is empty
        box = (x0 - span, y0 - span, x1 + span, y1 + span)
    inner = _cells(sites, n, box, tie)
    border = cut(sites.join(inner.where("border").select("id"), "id", "left_semi"))
    m, wide = border.count(), (x0 - FAR * span, y0 - FAR * span, x1 + FAR * span, y1 + FAR * span)
    if m <= MOST_BORDER:
        got = border.toPandas()
        sent = sites.sparkSession.sparkContext.broadcast((got["id"].to_numpy(np.int64), got["x"].to_numpy(), got["y"].to_numpy()))
        outer = border.repartition("id").mapInArrow(_among(sent, wide, tie), CORNERS)
    else:
        outer = _cells(border, m, wide, tie)
    outside = lambda x, y: (F.col(x) < box[0]) | (F.col(x) > box[2]) | (F.col(y) < box[1]) | (F.col(y) > box[3])
    after = F.concat(F.slice("links", 2, F.greatest(F.size("links"), F.lit(1))), F.slice("links", 1, 1))
    opened = lambda t: t.select(F.col("id").alias("a"), F.inline(F.arrays_zip(F.col("links").alias("k"), after.alias("next")))).select("a", "k.*", F.col("next.b").alias("c"), (F.col("k.x2") == F.col("next.x1")) & (F.col("k.y2") == F.col("next.y1")))
    names = ["a", "b", "x1", "y1", "x2", "y2", "c", "meet"]
    inner, outer = opened(inner).toDF(*names), opened(outer).toDF(*names)
    sides = inner.unionAll(outer.where(outside("x1", "y1") | outside("x2", "y2")))
    corners = inner.unionAll(outer.where(outside("x2", "y2"))).where("meet AND b <> c")
    ordered = F.array_sort(F.array("a", "b", "c"))
    return (cut(sides.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()),
            cut(corners.select(*[ordered[k].alias(v) for k, v in enumerate("abc")]).distinct()))


def delaunay(sites: DataFrame) -> DataFrame:
    """(a, b, d2): the links of the triangulation, a < b, with squared lengths."""
    found = _voronoi(sites)
    ends = [sites.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "ab"]
    links = found[0] if found else sites.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return links.join(ends[0], "a").join(ends[1], "b").select("a", "b", d2.cast("double").alias("d2"))


def triangles(sites: DataFrame) -> DataFrame:
    """(a, b, c): the triangles, by ascending ids."""
    found = _voronoi(sites)
    return found[1] if found else sites.select(*[F.col("id").alias(k) for k in "abc"]).limit(0)


def _side(p: str, q: str, x: Column, y: Column) -> Column:
    return (F.col(f"{q}x") - F.col(f"{p}x")) * (y - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (x - F.col(f"{p}x"))


def linear_surface(sites: DataFrame, grid: Grid) -> DataFrame:
    """(r, c, z): sites' heights (column ``z``) carried linearly over the triangles to the centres of the cells inside the hull.

    A triangle looks only at the cells of its box. A centre on a common side is taken once; the triangles agree there.
    """
    t = triangles(sites)
    for k in "abc":
        t = t.join(sites.select(F.col("id").alias(k), *[F.col(v).cast("double").alias(f"{k}{v}") for v in "xyz"]), k)
    low, high = (lambda v: F.least(f"a{v}", f"b{v}", f"c{v}")), (lambda v: F.greatest(f"a{v}", f"b{v}", f"c{v}"))
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v)))
    rows = F.sequence(clip((F.lit(grid.ymax) - high("y")) / grid.res, grid.height), clip((F.lit(grid.ymax) - low("y")) / grid.res, grid.height))
    columns = F.sequence(clip((low("x") - grid.xmin) / grid.res, grid.width), clip((high("x") - grid.xmin) / grid.res, grid.width))
    cells = t.select("*", F.explode(rows).alias("r")).select("*", F.explode(columns).alias("k"))
    x, y = grid.x("k"), grid.y("r")
    cells = cells.select("*", _side("b", "c", x, y).alias("wa"), _side("c", "a", x, y).alias("wb"), _side("a", "b", x, y).alias("wc"))
    inside = cells.where("(wa >= 0 AND wb >= 0 AND wc >= 0 OR wa <= 0 AND wb <= 0 AND wc <= 0) AND wa + wb + wc <> 0")
    z = F.expr("(wa * az + wb * bz + wc * cz) / (wa + wb + wc)")
    return inside.groupBy("r", F.col("k").alias("c")).agg(F.min(z).alias("z"))
