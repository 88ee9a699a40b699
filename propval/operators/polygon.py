"""Point in polygon: boxes reach their cells, candidates are tested by ray casting over the edges of their row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propval.operators.gridjoin import cell_of


def edges_of(polygons: DataFrame, poly_id: str = "poly_id", ring: str = "ring") -> DataFrame:
    """One row an edge from closed exterior rings (array of x, y structs); rings under three vertices are left out."""
    kept = polygons.where(F.size(ring) >= 3)
    nxt = F.concat(F.slice(F.col(ring), F.lit(2), F.size(ring) - 1), F.slice(F.col(ring), 1, 1))
    e = kept.select(*[c for c in polygons.columns if c != ring], F.explode(F.zip_with(F.col(ring), nxt, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).alias("e"))
    return e.select(*[c for c in polygons.columns if c != ring], "e.*")


def max_level(points: DataFrame, edges: DataFrame, key: str, width: float = 1000.0) -> DataFrame:
    """points with the highest level of the polygons (edges: poly_id, level, x1, y1, x2, y2) that hold them; null if none.

    A polygon's box, one row, goes to the cells that it reaches, and gives each point its candidates. An edge goes to the rows of
    cells that it spans, not to all of its polygon's cells: a candidate meets the edges of its polygon that cross its own row, and an
    odd number of them to its right means inside."""
    box = edges.groupBy("poly_id", "level").agg(F.min(F.least("x1", "x2")).alias("bx1"), F.max(F.greatest("x1", "x2")).alias("bx2"), F.min(F.least("y1", "y2")).alias("by1"), F.max(F.greatest("y1", "y2")).alias("by2"))
    reach = lambda a, b: F.explode(F.sequence(cell_of(F.col(a), width), cell_of(F.col(b), width)))
    cells = box.withColumn("__cx", reach("bx1", "bx2")).withColumn("__cy", reach("by1", "by2"))
    located = points.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y", cell_of(F.col("x"), width).alias("__cx"), cell_of(F.col("y"), width).alias("__cy"))
    near = located.join(cells, ["__cx", "__cy"]).where("x BETWEEN bx1 AND bx2 AND y BETWEEN by1 AND by2").select(key, "x", "y", "poly_id", "level", "__cy")
    rows = edges.drop("level").withColumns({"ly": F.least("y1", "y2"), "hy": F.greatest("y1", "y2")}).withColumn("__cy", reach("ly", "hy")).drop("ly", "hy")
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * F.try_divide(F.col("y") - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    inside = near.join(rows, ["poly_id", "__cy"]).where(crossing).groupBy(key, "poly_id", "level").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return points.join(inside.groupBy(key).agg(F.max("level").alias("level")), key, "left")
