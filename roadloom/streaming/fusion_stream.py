"""The stream form of the fused positions: one state a line, ticks as event time passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.operators.feeds import TRACE, derive_direction, micros
from roadloom.functions.scalars import norm_line

_OUT = "line_no string, tick double, fix_id long, vehicle_no string, state string, lat double, lng double, live_age_s double, past_end boolean, warning string"
#: The vehicle of the line, its last fix, the blend that goes on, the interpolation, the last tick, and the trace as bytes of doubles.
_STATE = """vehicle string, fix_id long, t double, lat double, lng double, s double, place_lat double, place_lng double, from_lat double, from_lng double,
begin double, tick double, warning string, trace binary"""
_NAMES = [x.split()[0] for x in _STATE.replace("\n", " ").split(",")]


def trace_lines(trace: DataFrame) -> DataFrame:
    """(line_no, traces): for each line a map of its directions to the points of the trace in order. One selected trace a direction: some thousand points."""
    points = F.array_sort(F.collect_list(F.struct(F.col("trace_time_s").alias("s"), "lat", "lng")))
    by = trace.groupBy(*TRACE).agg(points.alias("points"))
    return by.groupBy("line_no").agg(F.map_from_entries(F.collect_list(F.struct("direction", "points"))).alias("traces"))


def observations(stream: DataFrame) -> DataFrame:
    """Vehicle rows of feed items (a payload's own rows lie together in a file) as fixes: line, direction, vehicle, place, time.

    derive_direction looks at one payload, so it runs on each micro-batch as it comes: use inside foreachBatch.
    """
    d = derive_direction(stream).withColumn("line_no", norm_line(F.col("line_no")))
    ok = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    return d.where(ok).select(F.col("item_id").alias("fix_id"), "line_no", "direction", "vehicle_no", "payload_id", "lat", "lng", F.col("gps_time").cast("timestamp").alias("observed_at"))


def _project(points: np.ndarray, lat: float, lng: float) -> tuple[float, float, float, float]:
    """(metres, trace time, lat, lng) of the nearest place; the earliest segment wins a tie."""
    s, la, ln = points.T
    if len(s) == 1:
        return round(math.hypot((la[0] - lat) * 111000.0, (ln[0] - lng) * 91000.0), 6), s[0], la[0], ln[0]
    ky, kx = 111000.0, max(1.0, math.cos(math.radians(lat)) * 111000.0)
    ax, ay = (ln[:-1] - lng) * kx, (la[:-1] - lat) * ky
    dx, dy = np.diff(ln) * kx, np.diff(la) * ky
    size = dx * dx + dy * dy
    r = np.where(size > 0, np.clip(-(ax * dx + ay * dy) / np.where(size > 0, size, 1.0), 0.0, 1.0), 0.0)
    d = np.round(np.hypot(ax + r * dx, ay + r * dy), 6)
    i = int(np.argmin(d))
    at = lambda v: v[i] * (1 - r[i]) + v[i + 1] * r[i]
    return float(d[i]), float(at(s)), float(at(la)), float(at(ln))


def _place(points: np.ndarray, clock: float) -> tuple[float, float, bool]:
    s, la, ln = points.T
    past = clock > s[-1]
    clock = min(max(clock, 0.0), s[-1])
    return float(np.interp(clock, s, la)), float(np.interp(clock, s, ln)), bool(past)


class _Line:
    """What is known of a line, and the rows of its ticks."""

    def __init__(self, key: str, values: tuple | None, tick_s: float, stale_s: float, blend_s: float, align_m: float, after_s: float):
        self.key, self.out = key, []
        self.v = dict(zip(_NAMES, values)) if values else dict.fromkeys(_NAMES)
        self.tick_s, self.stale_s, self.blend_s, self.align_m, self.after_s = tick_s, stale_s, blend_s, align_m, after_s
        raw = self.v["trace"]
        self.points = np.frombuffer(bytes(raw), np.float64).reshape(-1, 3) if raw else None

    def last_tick(self) -> float:
        return math.floor((self.v["t"] + self.after_s) / self.tick_s) * self.tick_s

    def ticks(self, until: float) -> None:
        """Emit the ticks after the last one up to `until`."""
        v = self.v
        if v["fix_id"] is None:
            return
        k, end = round(v["tick"] / self.tick_s) + 1, math.floor(until / self.tick_s + 1e-9)
        for i in range(k, end + 1):
            tick = i * self.tick_s
            age = tick - v["t"]
            if age <= self.stale_s:
                blend = v["from_lat"] is not None and age < self.blend_s + self.tick_s
                lat, lng = self.blended(tick) if blend else (v["lat"], v["lng"])
                self.put(tick, "reconciling" if blend and age < self.blend_s else "live", lat, lng, age, False, v["warning"])
            elif v["s"] is not None:
                lat, lng, past = _place(self.points, v["s"] + tick - v["begin"])
                self.put(tick, "interpolated", lat, lng, age, past, "collected route history ended" if past else v["warning"])
        v["tick"] = max(v["tick"], end * self.tick_s)

    def put(self, tick, state, lat, lng, age, past, warning):
        v = self.v
        self.out.append((self.key, tick, v["fix_id"], v["vehicle"], state, lat, lng, round(age, 1), past, warning))

    def goal(self) -> tuple[float, float]:
        v = self.v
        return (v["place_lat"], v["place_lng"]) if v["s"] is not None else (v["lat"], v["lng"])

    def blended(self, at: float) -> tuple[float, float]:
        v, (a, b) = self.v, self.goal()
        r = min(1.0, (at - v["t"]) / self.blend_s)
        return v["from_lat"] + (a - v["from_lat"]) * r, v["from_lng"] + (b - v["from_lng"]) * r

    def accept(self, row) -> None:
        v, t = self.v, row.t
        start = None
        if v["fix_id"] is not None:
            if (t, round(row.lat, 7), round(row.lng, 7)) == (v["t"], round(v["lat"], 7), round(v["lng"], 7)) or t < v["t"]:
                return  # a repeated fix does not refresh the age
            shown = math.ceil(t / self.tick_s) - 1
            self.ticks(shown * self.tick_s)
            if v["from_lat"] is not None and t - v["t"] < self.blend_s:
                start = self.blended(t)
            elif v["s"] is not None and shown * self.tick_s >= v["begin"] and t - v["t"] >= self.blend_s:
                start = _place(self.points, v["s"] + shown * self.tick_s - v["begin"])[:2]
        points = np.array([(p["s"], p["lat"], p["lng"]) for p in row.points], np.float64).reshape(-1, 3) if row.points is not None and len(row.points) else None
        self.points = points
        near = _project(points, row.lat, row.lng) if points is not None else None
        hit = near is not None and near[0] <= self.align_m
        warning = None if hit else "no collected route history" if near is None else f"collected route is {round(near[0])} m from the live fix"
        v.update(
            fix_id=int(row.fix_id), t=t, lat=row.lat, lng=row.lng, s=near[1] if hit else None, place_lat=near[2] if hit else None, place_lng=near[3] if hit else None,
            from_lat=start[0] if start else None, from_lng=start[1] if start else None, begin=(math.floor((t + self.stale_s) / self.tick_s) + 1) * self.tick_s,
            tick=(math.ceil(t / self.tick_s) - 1) * self.tick_s, warning=warning, trace=points.tobytes() if points is not None else None,
        )


def fuse_stream(fixes: DataFrame, trace: DataFrame, tick_s: float = 1.0, stale_s: float = 15.0, blend_s: float = 3.0, align_m: float = 300.0, after_s: float = 60.0, late: str = "15 seconds") -> DataFrame:
    """fuse_positions of a stream of fixes (fix_id, line_no, direction, vehicle_no, payload_id, lat, lng, observed_at), as it goes on.

    Of a line's first payload the smallest vehicle is its own from then on; fixes of others are left out. Equal fixes in a
    row count once. Ticks come out once event time has passed them by `late`: with the line's next fix or by its timer,
    which ends after_s behind the last fix; a fix that comes later gives the ticks between.
    trace: selected points (line_no, direction, trace_time_s, lat, lng). The state of a line is its last fix and trace.
    """
    own = F.element_at("traces", F.col("direction"))
    only = F.when(F.size("traces") == 1, F.get(F.map_values("traces"), F.lit(0)))
    points: Column = F.coalesce(own, only, F.element_at("traces", F.lit("full_route")))
    options = (tick_s, stale_s, blend_s, align_m, after_s)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = _Line(key[0], tuple(state.get) if state.exists else None, *options)
        now = state.getCurrentWatermarkMs() / 1000
        if not state.hasTimedOut:
            rows = pd.concat(list(parts))
            seen = rows[rows["vehicle_no"].notna()]
            if line.v["vehicle"] is None and len(seen):
                line.v["vehicle"] = seen[seen["payload_id"] == seen["payload_id"].min()]["vehicle_no"].min()
            for row in rows[rows["vehicle_no"] == line.v["vehicle"]].sort_values(["t", "fix_id"], kind="stable").itertuples():
                line.accept(row)
        if line.v["fix_id"] is not None:
            line.ticks(min(math.ceil(now / tick_s - 1) * tick_s, line.last_tick()))
        state.update(tuple(line.v[n] for n in _NAMES))
        if line.v["fix_id"] is not None and line.v["tick"] < line.last_tick():
            state.setTimeoutTimestamp(int(max(now, line.v["tick"] + tick_s) * 1000) + 1)
        yield pd.DataFrame(line.out, columns=[x.split()[0] for x in _OUT.split(", ")])

    rows = fixes.withWatermark("observed_at", late).join(trace_lines(trace), "line_no", "left")
    payload = F.col("payload_id") if "payload_id" in fixes.columns else F.lit(0)
    rows = rows.select("line_no", "fix_id", "vehicle_no", payload.cast("long").alias("payload_id"), "lat", "lng", (micros("observed_at") / 1e6).alias("t"), points.alias("points"), "observed_at")
    return rows.groupBy("line_no").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
