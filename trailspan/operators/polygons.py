"""Polygons as layers: an index of grid cells, points and lines against it, and the flags that segments get from layers.

Polygons are rows (poly_id, a, b), one for each edge of their rings, so that a polygon of any size is dealt to many tasks; see
polygon_edges. A point is inside where an odd number of a polygon's rings hold it, so holes, islands in holes and several parts
need nothing of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.functions import geometry
from trailspan.operators.network import passed_cells, straight_pieces
from trailspan.shared import stored


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, a, b) from rows (poly_id, ring), ring being an array<struct<x,y>>. Rings that are not closed are closed; those of
    fewer than three points have no edges."""
    ring = F.col("ring")
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    some = polygons.where(F.size("ring") > 2).withColumn("ring", closed)
    return some.select("poly_id", F.explode(geometry.segments(F.col("ring"))).alias("s")).select("poly_id", "s.a", "s.b").where("a <> b")


def _x_at(y: Column) -> Column:
    return F.try_divide((F.col("b.x") - F.col("a.x")) * (y - F.col("a.y")), F.col("b.y") - F.col("a.y")) + F.col("a.x")


def _y_at(x: Column) -> Column:
    return F.try_divide((F.col("b.y") - F.col("a.y")) * (x - F.col("a.x")), F.col("b.x") - F.col("a.x")) + F.col("a.y")


def rim_edges(edges: DataFrame, cell: float) -> DataFrame:
    """Edges once in every cell that they pass."""
    return edges.withColumn("c", F.explode(passed_cells(F.col("a"), F.col("b"), cell))).select("poly_id", "a", "b", "c.cx", "c.cy")


def polygon_cells(edges: DataFrame, cell: float) -> DataFrame:
    """(poly_id, cx, cy, middle, rim): cells whose middle is inside or that the rim passes.

    In each row of cells the line through the middles is cut where edges cross
    it; in order, what lies between an odd cut and the next one is inside. So
    edges meet in rows of cells, never all of a polygon's in one place.
    """
    low, high = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor(low / cell) - 1, F.floor(high / cell) + 1)))
    y = (F.col("cy") + 0.5) * cell
    cuts = rows.where((F.col("a.y") > y) != (F.col("b.y") > y)).select("poly_id", "cy", _x_at(y).alias("x"))
    w = Window.partitionBy("poly_id", "cy").orderBy("x")
    spans = cuts.withColumn("n", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).where("n % 2 = 1 AND to IS NOT NULL")
    first, last = F.ceil(F.col("x") / cell - 0.5), F.ceil(F.col("to") / cell - 0.5) - 1
    inner = spans.where(last >= first).select("poly_id", "cy", F.explode(F.sequence(first, last)).alias("cx"), F.lit(True).alias("middle"))
    rim = rim_edges(edges, cell).select("poly_id", "cx", "cy").distinct().withColumn("rim", F.lit(True))
    both = inner.join(rim, ["poly_id", "cx", "cy"], "full")
    return both.select("poly_id", "cx", "cy", F.coalesce("middle", F.lit(False)).alias("middle"), F.coalesce("rim", F.lit(False)).alias("rim"))


#: Edges of one polygon in a cell, on the average, beyond which cells are halved.
CROWD = 8


def _finer(edges: DataFrame, cell: float) -> int:
    """By what power of two cells are to be narrower: the root of how far they are beyond CROWD, since the edges that a point meets
    fall with the width while the rows of cells rise."""
    seen = rim_edges(edges, cell).groupBy("poly_id", "cx", "cy").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 0.0
    return 1 << max(0, math.floor(math.log2(max(1.0, seen / CROWD)) / 2))


def points_in(points: DataFrame, edges: DataFrame, cell: float = 100.0, key: str = "point_id") -> DataFrame:
    """(key, poly_id): which polygons hold each point (key, x, y).

    A point in a cell that no rim passes is where the cell's middle is. In a rim
    cell the way from the middle to the point, first up or down and then
    sideways, changes sides at every edge that it crosses, and only edges in the
    cell can cross it. Where many edges share a cell, cells are made smaller, as
    a point then meets fewer. Points on the rim itself may count either way;
    points without a place are nowhere. Both joins are by sorted rows: cells and
    edges in them look small as files and are many times their number as rows,
    more than a driver holds for a broadcast.
    """
    edges = stored(edges.select("poly_id", "a", "b").repartition("a", "b"), "polygon-edges")
    cell /= _finer(edges, cell)
    cells = stored(polygon_cells(edges, cell), "polygon-cells")
    at = points.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    near = stored(at.join(cells.hint("merge"), ["cx", "cy"]), "polygon-near")
    sure = near.where("NOT rim AND middle").select(key, "poly_id")
    mx, my = (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell
    between = lambda v, p, q: (v > F.least(p, q)) & (v <= F.greatest(p, q))
    upright = ((F.col("a.x") > mx) != (F.col("b.x") > mx)) & between(_y_at(mx), my, F.col("y"))
    level = ((F.col("a.y") > F.col("y")) != (F.col("b.y") > F.col("y"))) & between(_x_at(F.col("y")), mx, F.col("x"))
    tried = near.where("rim").join(rim_edges(edges, cell).hint("merge"), ["poly_id", "cx", "cy"])
    turns = tried.groupBy(key, "poly_id").agg(F.first("middle").alias("middle"), (F.count_if(upright) + F.count_if(level)).alias("n"))
    return sure.unionByName(turns.where(F.col("middle") != (F.col("n") % 2 == 1)).select(key, "poly_id"))


def middles(lines: DataFrame) -> DataFrame:
    """(line_id, x, y): the middle of each line (line_id, line), worked out once for all that read it."""
    return lines.select("line_id", F.explode(F.array(geometry.point_at(F.col("line"), 0.5))).alias("p")).select("line_id", "p.x", "p.y")


def points_near(points: DataFrame, edges: DataFrame, reach: float, key: str = "point_id") -> DataFrame:
    """(key, poly_id, distance): polygons that hold a point, at distance 0, or whose rim is within ``reach`` of it. Edges stand in the
    cells of that size that they pass, points look into nine. An edge without length is a place of its own."""
    inside = points_in(points, edges.where("a <> b"), max(reach, 50.0), key).withColumn("distance", F.lit(0.0))
    around = F.explode(F.array(*(F.struct((F.floor(F.col("x") / reach) + i).alias("cx"), (F.floor(F.col("y") / reach) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    here = points.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").withColumn("c", around).select(key, "x", "y", "c.cx", "c.cy")
    n = geometry.nearest_on_segment(geometry.point(F.col("x"), F.col("y")), F.col("a"), F.col("b"))
    beside = here.join(rim_edges(edges, reach), ["cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - n["x"], F.col("y") - n["y"])).where(F.col("distance") <= reach)
    return inside.unionByName(beside.select(key, "poly_id", "distance")).groupBy(key, "poly_id").agg(F.min("distance").alias("distance"))


def rim_crossings(lines: DataFrame, edges: DataFrame, cell: float = 100.0) -> DataFrame:
    """(line_id, poly_id): lines (line_id, line) that cross or touch a polygon's rim.

    Pieces of lines and edges meet in the cells that both pass. One crossing is
    enough, so lines are tried against every 64th edge first, then against every
    eighth, and only those that have not met the rim by then against all.
    """
    rims = stored(rim_edges(edges.where("a <> b"), cell).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(64))), "rim-cells")
    pieces = straight_pieces(lines.select("line_id", "line"), False).withColumn("c", F.explode(passed_cells(F.col("a"), F.col("b"), cell)))
    here = pieces.select("line_id", F.col("a").alias("p"), F.col("b").alias("q"), "c.cx", "c.cy")
    left = stored(here.join(rims.select("poly_id", "cx", "cy").distinct().hint("merge"), ["cx", "cy"]), "rim-lines")
    rx, ry = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    sx, sy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    qx, qy = F.col("a.x") - F.col("p.x"), F.col("a.y") - F.col("p.y")
    cross = rx * sy - ry * sx
    meets = (cross != 0) & F.try_divide(qx * sy - qy * sx, cross).between(0, 1) & F.try_divide(qx * ry - qy * rx, cross).between(0, 1)
    found = None
    for part in ("part = 0", "part % 8 = 0 AND part > 0", "part % 8 > 0"):
        met = stored(left.join(rims.where(part).select("poly_id", "cx", "cy", "a", "b").hint("merge"), ["poly_id", "cx", "cy"]).where(meets).select("line_id", "poly_id").distinct(), "rim-met")
        found = met if found is None else found.unionByName(met)
        left = left.join(met.hint("merge"), ["line_id", "poly_id"], "left_anti")
    return found


def lines_against(lines: DataFrame, edges: DataFrame, cell: float = 100.0) -> DataFrame:
    """(line_id, poly_id, middle_inside, crosses, contains, intersects) for every line and polygon that meet.

    A line that meets no rim is inside where its middle is; one that meets it
    counts as lying on both sides, a touch too. Other pairs have no row.
    """
    inside = points_in(middles(lines), edges, cell, "line_id").withColumn("in", F.lit(True))
    over = rim_crossings(lines, edges, cell).withColumn("over", F.lit(True))
    both = inside.join(over, ["line_id", "poly_id"], "full")
    crosses = F.coalesce("over", F.lit(False))
    return both.select("line_id", "poly_id", F.coalesce("in", F.lit(False)).alias("middle_inside"), crosses.alias("crosses"), (~crosses).alias("contains"), F.lit(True).alias("intersects"))


def layer_flags(lines: DataFrame, town: DataFrame, campus: DataFrame, private: DataFrame, cell: float = 100.0) -> DataFrame:
    """(line_id, inside_boundary, crosses_boundary, in_campus, in_private) for every line, from layers of polygon edges: the midpoint in the town, the town's rim
    crossed, the midpoint on campus, the midpoint in private land. A layer without polygons holds nothing."""
    kinds = [town.select(F.lit("t").alias("kind"), "poly_id", "a", "b"), campus.select(F.lit("c").alias("kind"), "poly_id", "a", "b"), private.select(F.lit("p").alias("kind"), "poly_id", "a", "b")]
    named = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).select(F.concat_ws("/", "kind", F.col("poly_id").cast("string")).alias("poly_id"), "a", "b")
    met = lines_against(lines, stored(named, "layer-edges"), cell).withColumn("kind", F.substring("poly_id", 1, 1))
    has = lambda kind, what: F.coalesce(F.bool_or((F.col("kind") == kind) & F.col(what)), F.lit(False))
    per = met.groupBy("line_id").agg(has("t", "middle_inside").alias("inside_boundary"), has("t", "crosses").alias("crosses_boundary"), has("c", "middle_inside").alias("in_campus"), has("p", "middle_inside").alias("in_private"))
    every = lines.select("line_id").join(per, "line_id", "left")
    return every.select("line_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("inside_boundary", "crosses_boundary", "in_campus", "in_private")))
