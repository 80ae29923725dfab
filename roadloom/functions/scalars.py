"""Scalar rules of the feeds, tags and media clocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default km/h of the routable road classes; others get 30.
BASE_KMH = {
    "motorway": 100, "motorway_link": 60, "trunk": 80, "trunk_link": 50,
    "primary": 60, "primary_link": 40, "secondary": 50, "secondary_link": 35,
    "tertiary": 40, "tertiary_link": 30, "unclassified": 30, "residential": 25,
    "living_street": 15, "service": 15, "track": 15,
}


def norm_line(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def norm_direction(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low == "", "").when(low.isin("out", "outbound"), "outbound").when(low.isin("in", "inbound"), "inbound").otherwise("full_route")


def num(c: Column) -> Column:
    """Numeric text without thousands commas; what is no number is null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def ars_id(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", F.lit(None)).when(t.rlike("^[0-9]+$") & (F.length(t) < 5), F.lpad(t, 5, "0")).otherwise(t)


def plausible(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.between(lo, hi), c)


def limit_tag(c: Column) -> Column:
    """First token of a limit tag without its unit; null where it is no number."""
    v = F.regexp_replace(F.split(F.trim(F.lower(c)), r"\s+")[0], "[mt]", "").try_cast("double")
    return F.when(~F.isnan(v), v)


def base_speed(highway: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in BASE_KMH.items() for x in (k, float(v))])
    return F.coalesce(table[highway], F.lit(30.0))


def is_turnaround(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "0", "false", "n", "no")


def ts_utc(c: Column) -> Column:
    """The instant of ISO-8601 text: Z or an offset as given, without either UTC; null where it is none."""
    t = F.trim(c)
    zoned = t.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$") & t.rlike(r"[Tt ]")
    whole = F.when(zoned, t).otherwise(F.concat(t, F.when(t.rlike(r"[Tt ]"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), whole))


def pts_to_us(c: Column) -> Column:
    """Microseconds of a 90 kHz clock, in whole numbers."""
    return F.call_function("div", c.cast("long") * 1000000, F.lit(90000))


def classify_result(c: Column) -> Column:
    ok = c.isNull() | c.isin("", "00", "000", "0000", "NORMAL_CODE") | c.rlike("-000$")
    return F.when(ok, "ok").when(c == "22", "quota").when(c.isin("20", "30", "31"), "auth").otherwise("error")


def risk_level(distance: Column, caution: float | Column, danger: float | Column) -> Column:
    """UNKNOWN without a distance; the limits are numbers, or columns such as the warning distance of a class."""
    return F.when(distance.isNull(), "UNKNOWN").when(distance < danger, "DANGER").when(distance < caution, "CAUTION").otherwise("NORMAL")


def norm_bbox(x1: Column, y1: Column, x2: Column, y2: Column, fmt: str = "xyxy", width: float | None = None, height: float | None = None) -> Column:
    """Corner form in 0..1; null for an empty box. fmt: xyxy or xywh; with width and height the input is in pixels."""
    if fmt == "xywh":
        x2, y2 = x1 + x2, y1 + y2
    if width:
        x1, x2, y1, y2 = x1 / width, x2 / width, y1 / height, y2 / height
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    box = F.struct(one(x1).alias("x1"), one(y1).alias("y1"), one(x2).alias("x2"), one(y2).alias("y2"))
    return F.when((one(x2) > one(x1)) & (one(y2) > one(y1)), box)


def ground_distance(u: Column, v: Column, pitch: Column, roll: Column, height: float | Column | None, width_px=1280.0, height_px=720.0, fx=920.0, fy=690.0, cx=640.0, cy=360.0, lo=0.1, hi=200.0, digits: int | None = None) -> Column:
    """Struct of distance and status: the pinhole ray through (u, v), rotated by roll, then pitch, meets the ground.

    Without a camera height (None, or a column that is null) the status is calibration_missing. digits rounds the distance.
    """
    height = height if isinstance(height, Column) else F.lit(height).cast("double")
    rx, ry, p, r = (u * width_px - cx) / fx, (v * height_px - cy) / fy, F.radians(pitch), F.radians(roll)
    x, y = F.cos(r) * rx - F.sin(r) * ry, F.sin(r) * rx + F.cos(r) * ry
    gy, gz = F.cos(p) * y + F.sin(p), F.cos(p) - F.sin(p) * y
    s = height / gy
    d = F.hypot(s * x, s * gz)
    status = (
        F.when(height.isNull(), "calibration_missing").when(pitch.isNull() | roll.isNull(), "imu_unavailable").when(u.isNull() | v.isNull(), "anchor_unavailable")
        .when(gy <= 1e-6, "invalid_ray").when(~d.between(lo, hi), "distance_out_of_range").otherwise("ok")
    )
    return F.struct(F.when(status == "ok", d if digits is None else F.bround(d, digits)).alias("distance"), status.alias("status"))
