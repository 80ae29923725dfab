"""Fused positions: live fixes, places on a recorded trace while the feed is silent, and blends back to the next fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.feeds import TRACE, lerp, micros, project_to_trace, trace_segments
from roadloom.sources.scratch import materialize

#: Ticks that one row stands for at most before they are listed.
PIECE = 1024


def trace_place(rows: DataFrame, trace: DataFrame, bucket_s: float = 600.0) -> DataFrame:
    """rows (line_no, direction, clock, ..) with trace_lat, trace_lng at that trace time; past_end where the trace is over.

    An equi-join on the trace and a time bucket, so a trace with many rows is spread over tasks. Rows without a trace go.
    """
    r = rows.join(_ends(trace), [*TRACE]).withColumn("past_end", F.col("clock") > F.col("s_end"))
    r = r.withColumn("clock", F.greatest(F.lit(0.0), F.least("clock", "s_end"))).withColumn("slot", F.floor(F.col("clock") / bucket_s).cast("long"))
    return r.join(_slotted(trace, bucket_s), [*TRACE, "slot"]).where(_on_segment()).select(*rows.columns, "past_end", *_places())


def _ends(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*TRACE).agg(F.max("trace_time_s").alias("s_end"))


def _slotted(trace: DataFrame, bucket_s: float) -> DataFrame:
    """Segments under every time bucket that they touch."""
    seg = trace_segments(trace).where("trace_time_s2 is not null")
    slot = lambda c: F.floor(F.col(c) / bucket_s).cast("long")
    return seg.select(*TRACE, F.col("trace_time_s").alias("s1"), F.col("trace_time_s2").alias("s2"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), "lat2", "lng2", F.explode(F.sequence(slot("trace_time_s"), slot("trace_time_s2"))).alias("slot"))


def _on_segment() -> Column:
    return (F.col("s1") <= F.col("clock")) & ((F.col("clock") < F.col("s2")) | ((F.col("clock") == F.col("s_end")) & (F.col("s2") == F.col("s_end"))))


def _places() -> list[Column]:
    ratio = (F.col("clock") - F.col("s1")) / (F.col("s2") - F.col("s1"))
    return [lerp(F.col("lat1"), F.col("lat2"), ratio).alias("trace_lat"), lerp(F.col("lng1"), F.col("lng2"), ratio).alias("trace_lng")]


def _pieces(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """rows with ticks first..last cut into pieces (k0, k1) of PIECE at most, dealt out evenly: what is small before its
    ticks are listed is not small after."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cut = rows.withColumns({"first": first, "last": last}).withColumn("k0", F.explode(F.when(F.col("last") >= F.col("first"), F.sequence("first", "last", F.lit(PIECE).cast("long")))))
    return cut.withColumn("k1", F.least("last", F.col("k0") + PIECE - 1)).drop("first", "last").repartition(parts, "fix_id", "k0")


def trace_ticks(rows: DataFrame, trace: DataFrame, tick_s: float, bucket_s: float = 600.0) -> DataFrame:
    """rows (line_no, direction, s, begin, k0, k1, ..) as a row for each tick k0..k1, with tick and the columns of trace_place
    at the clock s + tick - begin.

    Ranges of ticks meet the segments of their buckets; ticks are listed after that, so none is moved or looked up alone.
    """
    clock = lambda k: F.col("s") + k * F.lit(tick_s) - F.col("begin")
    held = lambda c: F.greatest(F.lit(0.0), F.least(c, F.col("s_end")))
    slot = lambda c: F.floor(c / bucket_s).cast("long")
    r = rows.join(F.broadcast(_ends(trace)), [*TRACE])
    r = r.withColumn("slot", F.explode(F.sequence(slot(held(clock(F.col("k0")))), slot(held(clock(F.col("k1")))))))
    j = r.join(_slotted(trace, bucket_s), [*TRACE, "slot"])
    low, high = F.greatest(F.col("s1"), F.col("slot") * bucket_s), F.least(F.col("s2"), (F.col("slot") + 1) * bucket_s)
    near = lambda c: F.floor((c - F.col("s") + F.col("begin")) / tick_s)
    a = F.when(low <= 0, F.col("k0")).otherwise(F.greatest("k0", near(low) - 1))
    b = F.when(high >= F.col("s_end"), F.col("k1")).otherwise(F.least("k1", near(high) + 2))
    j = j.withColumns({"a": a, "b": b}).where("a <= b").withColumn("k", F.explode(F.sequence("a", "b"))).withColumn("tick", F.col("k") * F.lit(tick_s))
    j = j.withColumn("past_end", F.col("s") + F.col("tick") - F.col("begin") > F.col("s_end")).withColumn("clock", held(F.col("s") + F.col("tick") - F.col("begin")))
    return j.where((slot(F.col("clock")) == F.col("slot")) & _on_segment()).select(*rows.columns, "tick", "past_end", *_places())


def _blend_starts(chains: DataFrame, blend_s: float) -> DataFrame:
    """fix_id, from_lat, from_lng of the fixes in chains of overlapping blends, from the first one's shown position.

    Fixes of a chain follow each other within blend_s, each blend starting where the one before it had got to.
    """
    chain = chains.groupBy("line_no", "chain").agg(F.array_sort(F.collect_list(F.struct("t", "fix_id", "goal_lat", "goal_lng", "shown_lat", "shown_lng"))).alias("c"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        r = (x.t - last.t) / blend_s
        at = lambda a, b: a + (b - a) * r
        row = F.struct(x.t.alias("t"), x.fix_id.alias("fix_id"), x.goal_lat.alias("goal_lat"), x.goal_lng.alias("goal_lng"), at(last.shown_lat, last.goal_lat).alias("shown_lat"), at(last.shown_lng, last.goal_lng).alias("shown_lng"))
        return F.concat(done, F.array(row))

    folded = F.aggregate(F.expr("slice(c, 2, size(c) - 1)"), F.expr("slice(c, 1, 1)"), step)
    return chain.select(F.explode(folded).alias("x")).select(F.col("x.fix_id").alias("fix_id"), F.col("x.shown_lat").alias("from_lat"), F.col("x.shown_lng").alias("from_lng"))


def fuse_positions(fixes: DataFrame, trace: DataFrame, tick_s: float = 1.0, stale_s: float = 15.0, blend_s: float = 3.0, align_m: float = 300.0, after_s: float = 60.0) -> DataFrame:
    """line_no, tick (epoch seconds), fix_id, state, lat, lng, live_age_s, past_end: one row a line and tick that shows something.

    fixes: fix_id (unique), line_no, direction, lat, lng, observed_at of one vehicle a line, repeats dropped. Up to stale_s
    after a fix the line is live. Then, if the fix lies within align_m of its trace, it moves along the trace from the
    first tick that was stale; otherwise it is hidden and gives no row. A fix that ends an interpolation is blended in
    over blend_s, to its place on the trace where that is near enough; the ticks after the one that ends the blend show the
    fix itself. Ticks end after_s behind the last fix of a line.
    """
    trace = materialize(trace.select(*TRACE, "trace_time_s", "lat", "lng", "speed_kmh"))
    near = project_to_trace(fixes.select("fix_id", "line_no", "direction", "lat", "lng"), trace)
    near = near.where(F.col("distance_m") <= align_m).select("fix_id", "trace_direction", F.col("trace_time_s").alias("s"), "trace_lat", "trace_lng")
    w = Window.partitionBy("line_no").orderBy("t", "fix_id")
    f = fixes.select("fix_id", "line_no", "lat", "lng", (micros("observed_at") / 1e6).alias("t")).join(near, "fix_id", "left")
    f = f.withColumn("begin", (F.floor((F.col("t") + stale_s) / tick_s) + 1) * F.lit(tick_s)).withColumn("next_t", F.lead("t").over(w))
    f = f.withColumn("prev", F.lag(F.struct("t", "s", "begin", "trace_direction")).over(w))
    f = f.withColumn("chain", F.sum(F.when(F.col("t") - F.col("prev.t") < blend_s, 0).otherwise(1)).over(w))
    f = f.withColumn("goal_lat", F.coalesce("trace_lat", "lat")).withColumn("goal_lng", F.coalesce("trace_lng", "lng"))
    f = materialize(f)
    before = (F.ceil(F.col("t") / tick_s) - 1) * F.lit(tick_s)  # the last tick that showed the fix before this one
    heads = f.where((before >= F.col("prev.begin")) & F.col("prev.s").isNotNull() & (F.col("t") - F.col("prev.t") >= blend_s))
    heads = trace_place(heads.select("line_no", F.col("prev.trace_direction").alias("direction"), (F.col("prev.s") + before - F.col("prev.begin")).alias("clock"), "fix_id", "chain"), trace)
    shown = heads.select("line_no", "chain", F.col("trace_lat").alias("head_lat"), F.col("trace_lng").alias("head_lng"))
    chained = f.select("line_no", "chain", "fix_id", "t", "goal_lat", "goal_lng").join(shown, ["line_no", "chain"]).withColumnsRenamed({"head_lat": "shown_lat", "head_lng": "shown_lng"})
    blends = f.join(_blend_starts(chained, blend_s), "fix_id", "left")

    last = F.when(F.col("next_t").isNull(), F.floor((F.col("t") + after_s) / tick_s)).otherwise(F.ceil(F.col("next_t") / tick_s) - 1)
    first, stale = F.ceil(F.col("t") / tick_s), F.floor((F.col("t") + stale_s) / tick_s)  # about the last tick that is live
    ticks = _pieces(blends, first, F.least(last, stale + 1)).withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("tick", F.col("k") * F.lit(tick_s))
    ticks = ticks.withColumn("age", F.col("tick") - F.col("t"))
    blended, live = F.col("from_lat").isNotNull(), F.col("age") <= stale_s
    r = F.least(F.lit(1.0), F.col("age") / blend_s)
    blending = blended & (F.col("age") < blend_s + tick_s)  # the tick that ends the blend shows its goal
    pos = lambda c: F.when(~blending, F.col(c)).otherwise(F.col(f"from_{c}") + (F.col(f"goal_{c}") - F.col(f"from_{c}")) * r)
    out = ("line_no", "tick", "fix_id", "state", "lat", "lng", F.round("age", 1).alias("live_age_s"), "past_end")
    fresh = ticks.where(live).withColumn("state", F.when(blended & (F.col("age") < blend_s), "reconciling").otherwise("live"))
    fresh = fresh.withColumn("lat_", pos("lat")).withColumn("lng_", pos("lng")).withColumn("lat", F.col("lat_")).withColumn("lng", F.col("lng_")).withColumn("past_end", F.lit(False))
    silent = f.where("s is not null").select("line_no", F.col("trace_direction").alias("direction"), "s", "begin", "fix_id", "t", "next_t")
    silent = trace_ticks(_pieces(silent, F.greatest(first, stale), last).drop("next_t"), trace, tick_s).withColumn("age", F.col("tick") - F.col("t")).where(~live)
    silent = silent.withColumnsRenamed({"trace_lat": "lat", "trace_lng": "lng"}).withColumn("state", F.lit("interpolated"))
    return fresh.select(*out).unionByName(silent.select(*out))
