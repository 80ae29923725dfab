"""Running values over long recordings: windows of segments, with what came before carried in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.scratch import materialize

#: Rows that one window takes at most; a key with more is cut into segments.
SEGMENT_ROWS = 1 << 20
SEGMENT = "segment__"


def segmented(df: DataFrame, by: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """df with segment__: 0 for all rows where no key of `by` has over `most` rows, else the range of (by, order) they lie in.

    Ranges are cut by Spark over by and order together, so one key with all rows gets as many segments as there are
    partitions, and rows with equal order stay in one. The table is written once, as its ranges must not change.
    """
    most = SEGMENT_ROWS if most is None else most
    if df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).isEmpty():
        return df.withColumn(SEGMENT, F.lit(0))
    rows = df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))
    return materialize(df.repartitionByRange(parts, *by, *order).withColumn(SEGMENT, F.spark_partition_id()))


def scan(df: DataFrame, by: list[str], order: list[str], **values: tuple) -> DataFrame:
    """df (from `segmented`) with a running value for each name: (kind, column) or (kind, column, True) to leave out the row.

    Kinds, over the rows of the key up to the row: `last` (the last value that is not null), `sum` and `max`; `next` is the
    first value that is not null from the row on. Inside a segment a window computes it; each segment leaves one state, a
    window over the states of a key gives what came before each segment, and that is joined in. Only segments that go on
    with a key have such a row, at most one for each range, so the table is broadcast whatever the input. With segments the
    result is written, so that a chain of scans reads each step once.
    """
    ahead = {name: v[0] == "next" for name, v in values.items()}
    key = [*by, SEGMENT]

    def window(name: str):
        w = Window.partitionBy(*key).orderBy(*([F.desc(c) for c in order] if ahead[name] else order))
        return w.rowsBetween(Window.unboundedPreceding, -1) if len(values[name]) > 2 and values[name][2] else w

    run = {"last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max}
    out = df.withColumns({name: run[v[0]](v[1]).over(window(name)) for name, v in values.items()})
    if df.select(SEGMENT).where(f"{SEGMENT} > 0").isEmpty():
        return out

    def state(name: str) -> Column:
        kind, value = values[name][:2]
        if kind in ("sum", "max"):
            return run[kind](value)
        edge = F.max_by if kind == "last" else F.min_by
        return edge(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order)))

    states = df.groupBy(*key).agg(*[state(name).alias(name) for name in values])
    before = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"{name}__": run[v[0]](F.col(name)).over(after if ahead[name] else before) for name, v in values.items()}
    several = F.count("*").over(Window.partitionBy(*by)) > 1
    carried = materialize(states.withColumns({**carried, "several__": several}).where("several__").select(*key, *carried))
    joined = out.join(F.broadcast(carried), key, "left")

    def together(name: str) -> Column:
        own, old = F.col(name), F.col(f"{name}__")
        if values[name][0] == "sum":
            return F.coalesce(own + old, own, old)
        return F.greatest(own, old) if values[name][0] == "max" else F.coalesce(own, old)

    return materialize(joined.withColumns({name: together(name) for name in values}).select(out.columns))
