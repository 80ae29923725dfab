"""Nearest things by cells that grow until a bound shows that nothing nearer is outside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import cell
from roadloom.sources.scratch import discard, materialize


def crossed_cells(segments: DataFrame, size: float) -> DataFrame:
    """segments (lat1, lon1, lat2, lon2, pad_lat, pad_lon, ..) once for every cell (cy, cx) within the pads of their line.

    Row by row of cells: the part of the line inside the row, widened, gives its columns, so a segment goes to about as many
    cells as it is long, not as its box has.
    """
    low, high = F.least("lat1", "lat2") - F.col("pad_lat"), F.greatest("lat1", "lat2") + F.col("pad_lat")
    s = segments.withColumn("cy", F.explode(F.sequence(cell(low, size), cell(high, size))))
    tall = F.col("lat2") - F.col("lat1")
    share = lambda edge, flat: F.when(tall == 0, flat).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("lat1")) / tall)))
    a = F.col("lon1") + share(F.col("cy") * size - F.col("pad_lat"), 0.0) * (F.col("lon2") - F.col("lon1"))
    b = F.col("lon1") + share((F.col("cy") + 1) * size + F.col("pad_lat"), 1.0) * (F.col("lon2") - F.col("lon1"))
    s = s.withColumns({"from__": cell(F.least(a, b) - F.col("pad_lon"), size), "to__": cell(F.greatest(a, b) + F.col("pad_lon"), size)})
    return s.withColumn("cx", F.explode(F.sequence("from__", "to__"))).drop("from__", "to__")


def ring_nearest(queries: DataFrame, segments: DataFrame, on: list[str], best: Column, metres: str, per_degree: Column, size: float = 0.01, grow: int = 4, prepare: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """queries (query_id, lat, lng, on..) with the least `best` (a struct) over the segments of their key, as a column best.

    segments: on.., lat1, lon1, lat2, lon2, ..; best may use all columns of both sides and those that prepare adds to the
    pairs step by step (so that no part is computed twice in a row), and its field `metres` is the
    distance, of which per_degree is the least number of a degree at the query. In each round a query looks at the nine cells
    around it; what is not in them is a cell's width away at least, so it is settled when its best is nearer than that.
    Others go on with cells `grow` times as wide, where a segment lies in fewer of them; the widest hold everything. So
    candidates follow the density around a query, not the length of its key's line. A query whose key has no segment
    gives no row.
    """
    left, out = queries.join(segments.select(*on).distinct(), on, "left_semi"), []
    s = segments.withColumns({"pad_lat": F.lit(1e-9), "pad_lon": F.lit(1e-9)})
    while True:
        around = lambda c: F.explode(F.sequence(cell(F.col(c), size) - 1, cell(F.col(c), size) + 1))
        asked = left.withColumn("cy", around("lat")).withColumn("cx", around("lng"))
        found = prepare(asked.join(crossed_cells(s, size), [*on, "cy", "cx"])).groupBy("query_id").agg(F.min(best).alias("best"), F.min(per_degree).alias("degree__"))
        widest = size >= 360
        done = materialize(found if widest else found.where(F.col(f"best.{metres}") < F.col("degree__") * size * 0.999999))
        out.append(done.select("query_id", "best"))
        if widest:
            break
        before, left = left, materialize(left.join(done, "query_id", "left_anti").select(left.columns))
        if len(out) > 1:
            discard(before)
        if left.isEmpty():
            break
        size *= grow
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_


def growing(centers: DataFrame, near: Callable[[DataFrame, float], DataFrame], k: int, radius: float, first: float | None = None) -> DataFrame:
    """near(centers, r): ranked rows of each center within r. The first k within radius, looked for in growing circles.

    A center that has k rows within a circle needs no larger one, so candidates follow what is near, not the radius.
    """
    r, left, out = first or radius / 16, centers, None
    while True:
        found = materialize(near(left, min(r, radius)).where(F.col("rank") <= k))
        full = found.where(F.col("rank") == k).select("center_id")
        done = found if r >= radius else found.join(full, "center_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        if r >= radius:
            return out
        left = materialize(left.join(full, "center_id", "left_anti"))
        if left.isEmpty():
            return out
        r *= 4
