"""Live feeds and recorded traces: directions, vehicles, trace clocks, projection and interpolation on a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import is_turnaround, norm_line
from roadloom.operators.near import ring_nearest
from roadloom.operators.timeseries import between_marks
from roadloom.sources.scratch import materialize

TRACE = ("line_no", "direction")


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def lerp(a: Column, b: Column, ratio: Column) -> Column:
    """Between a and b, the ratio clamped to 0..1; where one side is null the other one serves for both."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    return F.coalesce(a, b) * (1 - r) + F.coalesce(b, a) * r


def derive_direction(items: DataFrame) -> DataFrame:
    """Vehicles of each payload and line with their direction and its first and last stop index.

    The turnaround is the smallest marked stop index; 0 counts as none. Rows without a vehicle are stops: they
    count for the indices and are dropped after. One payload of one line is a window, so no group grows with history.
    """
    w = Window.partitionBy("payload_id", "line_no")
    df = items.withColumn("line_no", norm_line(F.col("line_no")))
    df = df.withColumn("route_count", F.max("stop_index").over(w))
    df = df.withColumn("turnaround", F.nullif(F.min(F.when(is_turnaround(F.col("marker")), F.col("stop_index"))).over(w), F.lit(0)))
    df = df.where("vehicle_no is not null")
    direction = F.when(F.col("turnaround").isNull() | F.col("stop_index").isNull(), "full_route").when(F.col("stop_index") <= F.col("turnaround"), "outbound").otherwise("inbound")
    df = df.withColumn("direction", direction)
    start = F.when(F.col("direction") == "inbound", F.col("turnaround")).otherwise(1)
    end = F.when(F.col("direction") == "outbound", F.col("turnaround")).otherwise(F.col("route_count"))
    return df.withColumn("start_index", start).withColumn("end_index", end)


def progress(given: Column, stop_index: Column, route_count: Column) -> Column:
    """The given percentage, else the share of stops passed, within 0..100."""
    share = F.when(route_count > 0, stop_index / route_count * 100)
    return F.coalesce(given, F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))))  # least skips nulls


def resolve_line(candidates: DataFrame) -> DataFrame:
    """The smallest line id whose public number equals the asked one, else the smallest of all."""
    exact = F.min(F.when(norm_line(F.col("public_no")) == norm_line(F.col("asked")), F.col("line_id")))
    return candidates.groupBy("asked").agg(F.coalesce(exact, F.min("line_id")).alias("line_id"))


def select_vehicle(items: DataFrame) -> DataFrame:
    """line_no and the vehicle that stands for it: the smallest id of the first payload with a vehicle."""
    first = F.min(F.struct("payload_id", "vehicle_no")).alias("first")
    return items.where("vehicle_no is not null").groupBy(norm_line(F.col("line_no")).alias("line_no")).agg(first).select("line_no", F.col("first.vehicle_no").alias("vehicle_no"))


def drop_repeats(fixes: DataFrame, key: str, order: list[str], time: str) -> DataFrame:
    """Fixes whose time and 7-digit position differ from those of the fix before."""
    w = Window.partitionBy(key).orderBy(*order)
    sig = F.struct(F.col(time), F.round("lat", 7), F.round("lng", 7))
    return fixes.withColumn("sig", sig).withColumn("before", F.lag("sig").over(w)).where("not (sig <=> before)").drop("sig", "before")


def usable_points(points: DataFrame) -> DataFrame:
    return points.where("not coalesce(point_class = 'duplicate' or startswith(point_class, 'rejected'), false)")


def trace_clock(points: DataFrame) -> DataFrame:
    """Usable points with the seconds since their trace began; of points at one time the first stays."""
    keys = [*TRACE, "trace_id"]
    rest = [c for c in points.columns if c not in (*keys, "recorded_at", "point_id")]
    one = usable_points(points).groupBy(*keys, "recorded_at").agg(F.min(F.struct("point_id", *rest)).alias("p")).select(*keys, "recorded_at", "p.*")
    start = F.min(micros("recorded_at")).over(Window.partitionBy(*keys))
    return one.withColumn("trace_time_s", (micros("recorded_at") - start) / 1e6)


def select_trace(clocked: DataFrame) -> DataFrame:
    """The points of one trace for each line and direction: the longest, then the one with most points, then by id."""
    size = clocked.groupBy(*TRACE, "trace_id").agg(F.max("trace_time_s").alias("s"), F.count("*").alias("n")).where("n >= 2")
    best = size.groupBy(*TRACE).agg(F.min(F.struct(-F.col("s"), -F.col("n"), F.col("trace_id"))).alias("b")).select(*TRACE, F.col("b.trace_id").alias("trace_id"))
    return clocked.join(best, [*TRACE, "trace_id"], "left_semi")


def pick_trace(fixes: DataFrame, trace: DataFrame) -> DataFrame:
    """Fixes with trace_direction: their own, else the only one of the line, else full_route, else null."""
    known = trace.groupBy("line_no").agg(F.collect_set("direction").alias("known"))
    own = F.when(F.array_contains("known", F.col("direction")), F.col("direction"))
    other = F.when(F.size("known") == 1, F.col("known")[0]).when(F.array_contains("known", "full_route"), "full_route")
    return fixes.join(known, "line_no", "left").withColumn("trace_direction", F.coalesce(own, other)).drop("known")


def trace_segments(trace: DataFrame) -> DataFrame:
    """Consecutive points of each trace as segments; the last point makes none unless it is the only one."""
    w = Window.partitionBy(*TRACE).orderBy("trace_time_s")
    ahead = [F.lead(c).over(w).alias(f"{c}2") for c in ("trace_time_s", "lat", "lng", "speed_kmh")]
    df = trace.select(*TRACE, "trace_time_s", "lat", "lng", "speed_kmh", F.lag("lat").over(w).isNull().alias("first"), *ahead)
    return df.where("trace_time_s2 is not null or first")


def project_to_trace(fixes: DataFrame, trace: DataFrame, size: float = 0.01) -> DataFrame:
    """Fixes with the trace time, point and metres of the nearest place on their trace; the earliest segment wins a tie.

    A fix meets the segments of one selected trace in the cells around it only (see near.ring_nearest). Fixes of one trace at
    one place are looked up once. Equal fixes give one row; one without a place gives none.
    """
    names = {"lat": "lat1", "lng": "lon1", "lat2": "lat2", "lng2": "lon2", "direction": "trace_direction", "trace_time_s": "s1", "trace_time_s2": "s2", "first": "first"}
    seg = trace_segments(trace).select("line_no", *[F.col(a).alias(b) for a, b in names.items()])
    seg = seg.withColumns({"lat2": F.coalesce("lat2", "lat1"), "lon2": F.coalesce("lon2", "lon1")})
    picked = materialize(pick_trace(fixes.where("lat is not null and lng is not null").distinct(), trace).where("trace_direction is not null"))
    place = ["line_no", "trace_direction", "lat", "lng"]
    asked = materialize(picked.select(*place).distinct().withColumn("query_id", F.monotonically_increasing_id()))
    ky, kx = F.lit(111000.0), F.greatest(F.lit(1.0), F.cos(F.radians("lat")) * 111000.0)
    asked = asked.withColumn("kx", kx)

    def prepare(pairs: DataFrame) -> DataFrame:
        sides = {"ax": (F.col("lon1") - F.col("lng")) * F.col("kx"), "ay": (F.col("lat1") - F.col("lat")) * ky, "dx": (F.col("lon2") - F.col("lon1")) * F.col("kx"), "dy": (F.col("lat2") - F.col("lat1")) * ky}
        j = pairs.withColumns(sides).withColumn("long", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
        ratio = F.when(F.col("long") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / F.col("long")))).otherwise(0.0)
        j = j.withColumn("ratio", ratio)
        flat = F.sqrt(F.pow(F.col("ax") + F.col("ratio") * F.col("dx"), 2) + F.pow(F.col("ay") + F.col("ratio") * F.col("dy"), 2))
        single = F.sqrt(F.pow("ay", 2) + F.pow((F.col("lon1") - F.col("lng")) * 91000.0, 2))
        return j.withColumn("far", F.round(F.when(F.col("s2").isNull(), single).otherwise(flat), 6))

    ratio = F.col("ratio")
    at = F.struct(F.col("far").alias("distance_m"), "s1", "trace_direction", lerp(F.col("s1"), F.col("s2"), ratio).alias("trace_time_s"), lerp(F.col("lat1"), F.col("lat2"), ratio).alias("trace_lat"), lerp(F.col("lon1"), F.col("lon2"), ratio).alias("trace_lng"))
    least = F.least(F.lit(91000.0), F.col("kx"))
    found = ring_nearest(asked, seg, ["line_no", "trace_direction"], at, "distance_m", least, size, prepare=prepare)
    return picked.join(asked.join(found, "query_id").select(*place, "best"), place).select(*fixes.columns, *[f"best.{c}" for c in ("distance_m", "trace_direction", "trace_time_s", "trace_lat", "trace_lng")])


def trace_at(ticks: DataFrame, trace: DataFrame, by: str = "trace_time_s", most: int | None = None) -> DataFrame:
    """ticks (line_no, direction, trace_time_s, ..) with the place on the trace at that time; the ends hold beyond it."""
    cols = ("lat", "lng", "speed_kmh")
    p = trace.select(*TRACE, F.col(by).alias("t"), F.struct(F.col(by).alias("t"), *cols).alias("mark"))
    k = ticks.select(*TRACE, F.col(by).alias("t"), F.struct(*ticks.columns).alias("row"))
    df = between_marks(k, p, [*TRACE], most).where("lo is not null or hi is not null")
    span = F.col("hi.t") - F.col("lo.t")
    ratio = F.when(span > 0, (F.col("t") - F.col("lo.t")) / span).otherwise(0.0)
    return df.select("row.*", *[lerp(F.col(f"lo.{c}"), F.col(f"hi.{c}"), F.coalesce(ratio, F.lit(0.0))).alias(f"trace_{c}") for c in cols])


def feed_status(items: DataFrame, trace: DataFrame, now: Column | None = None, stale_s: float = 15.0) -> DataFrame:
    """Each line: its vehicle, samples, last time, and whether a trace is ready; with `now` also its state and a warning.

    waiting: no vehicle was ever seen; live: its last fix is at most stale_s old; interpolated: older, but the line has a
    trace; hidden: it has none. The warning says why a line is not live, or that its vehicle is not in the last payload.
    """
    lines = items.groupBy(norm_line(F.col("line_no")).alias("line_no")).agg(F.count("*").alias("samples"), F.count("vehicle_no").alias("vehicle_rows"), F.max("gps_time").alias("last_at"))
    ready = trace.select("line_no").distinct().withColumn("history_ready", F.lit(True))
    out = lines.join(select_vehicle(items), "line_no", "left").join(ready, "line_no", "left").withColumn("history_ready", F.coalesce("history_ready", F.lit(False)))
    if now is None:
        return out
    own = items.select(norm_line(F.col("line_no")).alias("line_no"), "vehicle_no", "payload_id", "gps_time").join(out.select("line_no", F.col("vehicle_no").alias("chosen")), "line_no")
    mine = F.col("vehicle_no") == F.col("chosen")
    seen = own.groupBy("line_no").agg(F.max(F.when(mine, F.col("gps_time"))).alias("fix_at"), F.max("payload_id").alias("newest"), F.max(F.when(mine, F.col("payload_id"))).alias("held"))
    out = out.join(seen, "line_no", "left")
    age = (micros(now) - micros("fix_at")) / 1e6
    state = F.when(F.col("fix_at").isNull(), "waiting").when(age <= stale_s, "live").when(F.col("history_ready"), "interpolated").otherwise("hidden")
    warning = F.when(F.col("state") == "hidden", "no collected route history").when(F.col("fix_at").isNotNull() & (F.col("held") < F.col("newest")), "selected vehicle absent")
    return out.withColumn("state", state).withColumn("warning", warning).drop("fix_at", "newest", "held")


def feed_overview(status: DataFrame) -> DataFrame:
    """One row of feed_status: samples, lines, those with a trace, and lines by state."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("waiting", "live", "interpolated", "hidden")]
    return status.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"), F.count("*").alias("lines"), F.count_if("history_ready").alias("history_lines"), *states, F.count("warning").alias("warnings"))


def to_observation(df: DataFrame) -> DataFrame:
    """Telemetry source by state, and an external id: the vehicle, else line:<number>."""
    source = F.when(F.col("state").isin("live", "reconciling"), "BIMS_LIVE").otherwise("BIMS_REPLAY")
    return df.withColumn("telemetry_source", source).withColumn("external_id", F.coalesce("vehicle_no", F.concat(F.lit("line:"), "line_no")))


def freshness(fixes: DataFrame, now: Column, limit_s: float = 15.0) -> DataFrame:
    """Seconds since the last fix of each line to one digit, and whether it is live (the limit included)."""
    age = (micros(now) - F.max(micros("observed_at"))) / 1e6
    df = fixes.groupBy("line_no").agg(age.alias("age"))
    return df.select("line_no", F.round("age", 1).alias("live_age_s"), F.when(F.col("age") <= limit_s, "live").otherwise("stale").alias("state"))
