"""Density clusters of places by cells: exact, with no pairs inside crowded cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import DEGREE_M
from roadloom.operators.links import components
from roadloom.sources.scratch import materialize

#: Cells in a cell in each direction, level by level, when two crowded cells are held against each other.
PARTS = 4
#: Cells of this offset or less can hold two places within the reach.
OFFSETS = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]


def _square(a: str, b: str) -> Column:
    return F.pow(F.col(f"x{a}") - F.col(f"x{b}"), 2) + F.pow(F.col(f"y{a}") - F.col(f"y{b}"), 2)


def _around(df: DataFrame) -> DataFrame:
    """Every row once for each cell around its own; cy, cx: that cell."""
    at = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in OFFSETS])).alias("o")
    return df.select("*", at).withColumns({"cy": F.col("cy") + F.col("o.dy"), "cx": F.col("cx") + F.col("o.dx")}).drop("o")


def _cell_links(cores: DataFrame, side: float, reach: float) -> DataFrame:
    """(a, b), a < b: cells with cores at most `reach` apart.

    Pairs of cells near each other are cut into parts: a pair of parts that is whole within reach links the cells, one that
    is whole beyond it goes, and the others are cut again, down to places. Equal places are one row, so the parts at the end
    hold what the resolution of the coordinates lets them.
    """
    cells = cores.select("cell", "cy", "cx").distinct()
    near = _around(cells.withColumnRenamed("cell", "a")).join(cells.withColumnRenamed("cell", "b"), ["cy", "cx"]).where("a < b").select("a", "b")
    left, found, size = materialize(near), [], side
    on_a, on_b = [], []
    for _ in range(3):
        size /= PARTS
        own = {}
        for c in "ab":
            px, py = F.floor(F.col("x") / size).cast("long"), F.floor(F.col("y") / size).cast("long")
            keys = [F.col("cell").alias(c), px.alias(f"px{c}"), py.alias(f"py{c}"), F.floor(px / PARTS).alias(f"ux{c}"), F.floor(py / PARTS).alias(f"uy{c}")]
            own[c] = cores.select(*keys).distinct()
        j = left.join(own["a"], ["a", *on_a]).join(own["b"], ["b", *on_b])
        gap = lambda d: F.greatest(F.lit(0), F.abs(F.col(f"p{d}a") - F.col(f"p{d}b")) - 1) * size
        far = lambda d: (F.abs(F.col(f"p{d}a") - F.col(f"p{d}b")) + 1) * size
        j = j.select("a", "b", *[F.col(f"p{d}{c}").alias(f"u{d}{c}") for c in "ab" for d in "xy"], (F.pow(gap("x"), 2) + F.pow(gap("y"), 2)).alias("least"), (F.pow(far("x"), 2) + F.pow(far("y"), 2)).alias("most"))
        j = materialize(j.where(F.col("least") <= reach * reach * (1 + 1e-9)))
        linked = materialize(j.where(F.col("most") <= reach * reach * (1 - 1e-9)).select("a", "b").distinct())
        found.append(linked)
        on_a, on_b = ["uxa", "uya"], ["uxb", "uyb"]
        left = materialize(j.join(linked, ["a", "b"], "left_anti").select("a", "b", *on_a, *on_b))
    rows = {}
    for c in "ab":
        px, py = F.floor(F.col("x") / size).cast("long"), F.floor(F.col("y") / size).cast("long")
        rows[c] = cores.select(F.col("cell").alias(c), px.alias(f"ux{c}"), py.alias(f"uy{c}"), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"))
    last = left.join(rows["a"], ["a", *on_a]).join(rows["b"], ["b", *on_b]).where(_square("a", "b") <= reach * reach).select("a", "b").distinct()
    for more in found:
        last = last.unionByName(more)
    return last.distinct()


def density_clusters(points: DataFrame, reach_m: float, least: int, middle_lat: float | None = None) -> DataFrame:
    """point_id, cluster, core of points (point_id, lat, lng): clusters of places with `least` points within reach_m.

    A point is a core if `least` points, itself included, lie within reach_m (borders included) of it; cores within reach_m
    of each other share a cluster, named by its smallest point_id of a core; another point within reach_m of a core is in
    the cluster with the smallest name, else in none (null). Metres are flat, around middle_lat (the mean latitude).
    Cells have a diagonal of reach_m, so the points of a cell with `least` of them are cores without any pair being made;
    only points of thinner cells, fewer than `least` in each, meet the points around them. Points at one place count as one
    row with a weight. Points without a place are left out.
    """
    p = points.where("lat is not null and lng is not null").select("point_id", "lat", "lng")
    middle = p.agg(F.avg("lat")).first()[0] if middle_lat is None else middle_lat
    k, side = math.cos(math.radians(middle or 0.0)) * DEGREE_M, reach_m / math.sqrt(2.0)
    xy = p.withColumns({"x": F.col("lng") * k, "y": F.col("lat") * DEGREE_M})
    places = xy.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("point_id").alias("least_id"))
    places = materialize(places.withColumns({"cy": F.floor(F.col("y") / side).cast("long"), "cx": F.floor(F.col("x") / side).cast("long")}))
    crowd = places.groupBy("cy", "cx").agg(F.sum("n").alias("all"))
    full = places.join(crowd.where(F.col("all") >= least), ["cy", "cx"], "left_semi")
    thin = places.join(crowd.where(F.col("all") < least), ["cy", "cx"], "left_semi")
    asked = _around(thin.select(F.col("x").alias("xa"), F.col("y").alias("ya"), "cy", "cx"))
    others = places.select("cy", "cx", F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("n").alias("nb"))
    counts = asked.join(others, ["cy", "cx"]).where(_square("a", "b") <= reach_m * reach_m).groupBy("xa", "ya").agg(F.sum("nb").alias("all"))
    more = thin.join(counts.where(F.col("all") >= least).select(F.col("xa").alias("x"), F.col("ya").alias("y")), ["x", "y"], "left_semi").select(full.columns)
    cores = full.unionByName(more)
    name = cores.groupBy("cy", "cx").agg(F.min("least_id").alias("cell"))
    cores = materialize(cores.join(name, ["cy", "cx"]))
    whole = components(_cell_links(cores, side, reach_m))
    of_cell = cores.select("cell").distinct().join(whole.withColumnsRenamed({"node": "cell", "component": "cluster"}), "cell", "left").select("cell", F.coalesce("cluster", "cell").alias("cluster"))
    cores = materialize(cores.join(of_cell, "cell"))
    rest = _around(thin.join(cores.select("x", "y"), ["x", "y"], "left_anti").select(F.col("x").alias("xa"), F.col("y").alias("ya"), "cy", "cx"))
    near = rest.join(cores.select("cy", "cx", F.col("x").alias("xb"), F.col("y").alias("yb"), "cluster"), ["cy", "cx"]).where(_square("a", "b") <= reach_m * reach_m)
    border = near.groupBy(F.col("xa").alias("x"), F.col("ya").alias("y")).agg(F.min("cluster").alias("cluster"))
    known = cores.select("x", "y", "cluster", F.lit(True).alias("core")).unionByName(border.withColumn("core", F.lit(False)))
    return xy.join(known, ["x", "y"], "left").select("point_id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
