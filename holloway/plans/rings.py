"""What queries of outlines share: a table of each class, and the counts of corners that give the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import outlines, vector
from .tables import WIDTH


def quads_sql(cells: str, name: str) -> str:
    """Of cells (r, c, class): how many corners of each class have one, two beside one another, three, or two opposite cells of it. These counts give
    outer rings less holes, the length of all outlines and the number of their points."""
    return f"""{name}_q AS (SELECT class, r + i AS i, c + j AS j, sum(1 << (2 * i + j)) AS m FROM {cells}, range(0, 2) a(i), range(0, 2) b(j) GROUP BY 1, 2, 3),
{name} AS (SELECT class, count(*) FILTER (m IN (1, 2, 4, 8)) AS one, count(*) FILTER (m IN (3, 5, 10, 12)) AS two, count(*) FILTER (m IN (7, 11, 13, 14)) AS three, count(*) FILTER (m IN (6, 9)) AS opposite FROM {name}_q GROUP BY class)"""


def outlined(cells: DataFrame, corners: bool) -> DataFrame:
    """Of each class of cells (r, c, class): outer rings less holes, cells, length and points of its outlines."""
    areas = cut(vector.labelled_regions(cells, WIDTH, corners))
    table = outlines.ring_table(outlines.outlines(areas, corners)).join(areas.groupBy("region").agg(F.max("class").alias("class")), "region")
    return table.groupBy("class").agg(F.sum(F.signum("area")).cast("long").alias("shells_less_holes"), F.sum("area").cast("long").alias("cells"), F.sum("length").alias("sides"), F.sum("points").alias("points"))
