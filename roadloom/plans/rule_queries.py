"""Registered queries of rules, lookups, bundles and streams replayed as batches, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import geo, media, scalars
from roadloom.operators import feeds as fd
from roadloom.operators import history as h
from roadloom.operators import roadnet as road
from roadloom.operators import timeseries as ts
from roadloom.plans.queries import _EDGES, _LEGS, _MEASURED, _NEARWAY, hav, query, r6
from roadloom.streaming import sinks, windows


@query("""select event_id, case event_id % 5 when 0 then 'outbound' when 1 then 'inbound' when 2 then 'full_route' when 3 then '' else 'full_route' end as direction,
case when event_id % 4 = 3 then null else event_id * 1000 + 0.5e0 end as value, event_id * 3003 * 1000000 // 90000 as us, case event_id % 6 when 0 then 'ok' when 1 then 'ok' when 2 then 'quota' when 3 then 'auth' when 4 then 'error' else 'ok' end as result,
epoch_us(ts) // 1000000 as at_s from events""")
def feed_rules(v):
    """Directions, numbers, media clocks, result codes and times as feeds write them."""
    e = v("events")
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(i).cast("string") for i in x]), (F.col("event_id") % n + 1).cast("int"))
    text = F.when(F.col("event_id") % 4 == 3, "none").otherwise(F.concat(F.format_number(F.col("event_id") * 1000, 0), F.lit(".5 ")))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), pick(2, "Z", ""))
    return e.select(
        "event_id", scalars.norm_direction(pick(5, " OUT", "inbound ", "circle", "", "x")).alias("direction"), scalars.num(text).alias("value"), scalars.pts_to_us(F.col("event_id") * 3003).alias("us"),
        scalars.classify_result(pick(6, "00", "INFO-000", "22", "30", "99", None)).alias("result"), F.unix_seconds(scalars.ts_utc(iso)).alias("at_s"))


@query("""select frame_seq, case when frame_seq % 9 = 0 then null else round(x1 + 0.0, 6) end as x1, case when frame_seq % 9 = 0 then null else round(least(1.0, y1 + (y2 - y1)), 6) end as y2,
frame_seq % 7 <> 0 as has_point, round(frame_seq * 12.3456 / 1000, 3) as km, round(frame_seq * 7.5 / 60, 2) as minutes from frame_item""", "frame_item")
def frame_rules(v):
    """Boxes from pixels, points and summaries; a box without width is none."""
    wide = F.when(F.col("frame_seq") % 9 == 0, 0.0).otherwise(F.col("x2") - F.col("x1"))
    box = scalars.norm_bbox(F.col("x1") * 1280, F.col("y1") * 720, wide * 1280, (F.col("y2") - F.col("y1")) * 720, "xywh", 1280.0, 720.0)
    point = media.make_point(F.when(F.col("frame_seq") % 7 != 0, F.col("x1")), F.col("y1"))
    s = media.route_summary(F.col("frame_seq") * 12.3456, F.col("frame_seq") * 7.5, F.array("x1", "y1"))
    f = v("frame_item").withColumns({"box": box, "point": point, "s": s})
    return f.select("frame_seq", r6("box.x1").alias("x1"), r6("box.y2").alias("y2"), F.col("point").isNotNull().alias("has_point"), F.col("s.km").alias("km"), F.col("s.minutes").alias("minutes"))


@query("""select way_id, case when way_id % 3 = 0 then null when maxwidth is null and maxheight is null then null else least(coalesce(try_cast(replace(split_part(maxwidth, ' ', 1), 'm', '') as double), 1e9), coalesce(try_cast(replace(split_part(maxheight, ' ', 1), 'm', '') as double), 1e9)) end as limit_m,
coalesce(hgv = 'no', false) or way_id % 8 = 0 as closed from osm_way""", "osm_way")
def list_tags(v):
    """Tags of merged ways are lists: the least limit counts, and one closed part closes all."""
    limits = F.when(F.col("way_id") % 3 != 0, F.array("maxwidth", "maxheight"))
    access = F.array("hgv", F.when(F.col("way_id") % 8 == 0, "no"))
    return v("osm_way").select("way_id", media.limit_tags(limits).alias("limit_m"), media.tag_is(access, "no").alias("closed"))


@query("""select detection_event_id, case when distance_m is null then 'UNKNOWN' when distance_m < 2 then 'DANGER' when distance_m < case class_name when 'person' then 8.0 when 'car' then 5.0 else 3.0 end then 'CAUTION' else 'NORMAL' end as risk from detection_event""", "detection_event")
def risk_levels(v):
    """Risk by the warning distance of the class."""
    limits = v("detection_event").sparkSession.createDataFrame([("person", 8.0), ("car", 5.0), ("bicycle", 3.0)], "class_name string, caution_m double")
    e = h.enrich(v("detection_event"), F.broadcast(limits), "class_name")
    return e.select("detection_event_id", scalars.risk_level(F.col("distance_m"), F.col("caution_m"), 2.0).alias("risk"))


@query("select v.vehicle_id, vehicle_code, position_id from vehicle v join vehicle_position p on p.vehicle_id = v.vehicle_id where external_id = 'X7'", "vehicle", "vehicle_position")
def vehicle_lookup(v):
    """One vehicle by its external id, with its positions; an unknown id gives none."""
    one = h.lookup(v("vehicle"), F.col("external_id") == "X7").select("vehicle_id", "vehicle_code")
    return h.enrich(one, v("vehicle_position").select("vehicle_id", "position_id"), "vehicle_id", "inner")


@query("with g as (select *, cast(floor(frame_seq / 250.0e0) as bigint) as epoch from frame_item), m as (select max(epoch) - 1 as e from g) select frame_seq from g, m where epoch = e and frame_seq % 250 > 100", "frame_item")
def resumed_frames(v):
    """Frames of the last whole epoch behind the last one shown."""
    f = v("frame_item").withColumn("epoch", F.floor(F.col("frame_seq") / 250))
    last = (f.agg(F.max("epoch")).first()[0] or 1) - 1
    return ts.resume_frames(f, last, last * 250 + 100).select("frame_seq")


@query("select position_id, vehicle_id, round(lat, 6) as lat, round(lng, 6) as lng from vehicle_position where lat between 35.1 and 35.2 and lng between 128.9 and 129.0 order by recorded_at desc, position_id desc limit 500", "vehicle_position")
def boxed_positions(v):
    rows = h.in_box(v("vehicle_position"), (35.1, 128.9, 35.2, 129.0), order=(F.desc("recorded_at"), F.desc("position_id")), limit=500)
    return rows.select("position_id", "vehicle_id", r6("lat").alias("lat"), r6("lng").alias("lng"))


@query("""select 'anchors' as part, session_id, capture_timestamp_ns as at from video_time_anchor where capture_timestamp_ns between 30000000000 and 60000000000
union all select 'detections', session_id, capture_timestamp_ns from detection_event where capture_timestamp_ns between 30000000000 and 60000000000
union all select 'reads', session_id, capture_timestamp_ns from qr_read where capture_timestamp_ns between 30000000000 and 60000000000""", "video_time_anchor", "detection_event", "qr_read")
def replay_parts(v):
    """Anchors, detections and reads of one window, as its bundle has them."""
    parts = h.replay_bundle(F.lit(30_000_000_000), F.lit(60_000_000_000), anchors=v("video_time_anchor"), detections=v("detection_event"), reads=v("qr_read"))
    rows = [df.select(F.lit(name).alias("part"), "session_id", F.col("capture_timestamp_ns").alias("at")) for name, df in parts.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query(f"""with {_MEASURED}, q as (select position_id, case when position_id % 5 = 0 then vehicle_id + 1 else vehicle_id end as vehicle_id, trip_id, trip_id * 10 + 1 + case when position_id % 7 = 0 then 10 else trip_id % 2 end as route_id from vehicle_position)
select q.position_id, q.route_id, round(distance_m, 6) as distance_m from q join vehicle_position p on p.position_id = q.position_id and p.vehicle_id = q.vehicle_id join m on m.position_id = q.position_id and m.route_id = q.route_id""", "vehicle_position", "route_point")
def guarded_measures(v):
    """Requests name vehicle, trip, route and position; those whose parts don't belong together give nothing."""
    p = v("vehicle_position")
    asked = p.select("position_id", F.when(F.col("position_id") % 5 == 0, F.col("vehicle_id") + 1).otherwise(F.col("vehicle_id")).alias("vehicle_id"), "trip_id",
                     (F.col("trip_id") * 10 + 1 + F.when(F.col("position_id") % 7 == 0, 10).otherwise(F.col("trip_id") % 2)).alias("route_id"))
    return h.measured_on(asked, p, v("route_point").where("is_current")).select("position_id", "route_id", r6("distance_m").alias("distance_m"))


@query(f"""with {_MEASURED}, o as (select m.*, epoch_us(recorded_at) as tm, distance_m >= 5000 as off from m), f as (select *, lag(off) over w as po, max(case when off then tm end) over (partition by trip_id order by recorded_at, position_id rows between unbounded preceding and 1 preceding) as pt from o window w as (partition by trip_id order by recorded_at, position_id)),
i as (select *, sum(case when off and not (coalesce(po, false) or coalesce(tm - pt <= 7200000000, false)) then 1 else 0 end) over (partition by trip_id order by recorded_at, position_id) as island from f)
select trip_id, cast(island as bigint) as island, count(*) as samples, round(max(distance_m), 6) as max_m from i where off group by trip_id, island""", "vehicle_position", "route_point")
def cooled_episodes(v):
    """Episodes less than two hours apart are one."""
    e = h.deviation_episodes(v("vehicle_position"), v("route_point"), 5000.0, 7200.0)
    return e.select("trip_id", F.col("island").cast("long").alias("island"), "samples", r6("max_m").alias("max_m"))


@query(f"""with {_LEGS.replace('epoch_us(recorded_at - pt)', '(epoch_us(recorded_at) - epoch_us(pt))')}, {_MEASURED.replace('s as (', 'sgm as (').replace('join s on p.trip_id = s.trip_id', 'join sgm s on p.trip_id = s.trip_id')},
dr as (select vehicle_id, coalesce(sum(leg_m), 0) as m from g group by 1), tr as (select vehicle_id, count(case when trip_status = 'COMPLETED' then 1 end) as n from trip group by 1),
ri as (select vehicle_id, count(*) as n, avg(distance_m) as m from detection_event where distance_m < 5 group by 1), de as (select vehicle_id, count(*) as n, avg(distance_m) as m from m join vehicle_position p on p.position_id = m.position_id where distance_m >= 500 group by 1)
select dr.vehicle_id, coalesce(ri.n, 0) as risk_events, round(ri.m, 6) as mean_risk_m, coalesce(de.n, 0) as deviations, round(de.m, 5) as mean_deviation_m, round(dr.m, 4) as driven_m, coalesce(tr.n, 0) as completed_trips
from dr left join tr on tr.vehicle_id = dr.vehicle_id left join ri on ri.vehicle_id = dr.vehicle_id left join de on de.vehicle_id = dr.vehicle_id""", "vehicle_position", "route_point", "detection_event", "trip")
def vehicle_stats(v):
    s = h.fleet_stats(v("vehicle_position"), v("detection_event"), h.deviations(v("vehicle_position"), v("route_point"), 500.0), v("trip"))
    return s.select("vehicle_id", "risk_events", r6("mean_risk_m").alias("mean_risk_m"), "deviations", F.round("mean_deviation_m", 5).alias("mean_deviation_m"), F.round("driven_m", 4).alias("driven_m"), "completed_trips")


@query("""with f as (select concat('m', cast(event_id % 3 as string)) as model_version, case when event_id % 10 = 0 then null else value end as latency_ms from events)
select model_version, count(*) as frames, count(latency_ms) as inferred, quantile_disc(latency_ms, 0.5) as median_ms, quantile_disc(latency_ms, 0.9) as p90_ms, quantile_disc(latency_ms, 0.99) as p99_ms, max(latency_ms) as worst_ms from f group by 1""")
def model_latency(v):
    f = v("events").select(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model_version"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("latency_ms"))
    return h.inference_diagnostics(f)


@query("select severity, class_name, count(*) as alerts from alert a left join detection_event d on d.detection_event_id = a.detection_event_id group by 1, 2", "alert", "detection_event")
def alert_classes(v):
    return h.severity_counts(v("alert"), v("detection_event"))


_FEED = """l as (select upper(regexp_replace(line_no, '[ ]+', '', 'g')) as line, vehicle_no, payload_id, gps_time from feed_item),
c as (select line, min(vehicle_no) as chosen from (select *, min(payload_id) over (partition by line) as first from l where vehicle_no is not null) q where payload_id = first group by 1),
s as (select l.line as line_no, count(*) as samples, max(case when vehicle_no = chosen then gps_time end) as fix_at, max(payload_id) as newest, max(case when vehicle_no = chosen then payload_id end) as held,
l.line in (select line_no from trace_point where point_class = 'ok') as ready from l left join c on c.line = l.line group by 1, l.line),
t as (select *, case when fix_at is null then 'waiting' when (epoch_us(timestamp '2024-01-30 00:00:00') - epoch_us(fix_at)) / 1e6 <= 86400 then 'live' when ready then 'interpolated' else 'hidden' end as state from s),
u as (select *, case when state = 'hidden' then 'no collected route history' when fix_at is not null and held < newest then 'selected vehicle absent' end as warning from t)"""


def _status(v):
    return fd.feed_status(v("feed_item"), fd.usable_points(v("trace_point")), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 86400.0)


@query(f"with {_FEED} select line_no, state, warning from u", "feed_item", "trace_point")
def feed_states(v):
    return _status(v).select("line_no", "state", "warning")


@query(f"with {_FEED} select cast(sum(samples) as bigint) as samples, count(*) as lines, count(case when ready then 1 end) as history_lines, count(case when state = 'waiting' then 1 end) as waiting, count(case when state = 'live' then 1 end) as live, count(case when state = 'interpolated' then 1 end) as interpolated, count(case when state = 'hidden' then 1 end) as hidden, count(warning) as warnings from u", "feed_item", "trace_point")
def feed_totals(v):
    return fd.feed_overview(_status(v))


@query("""with s as (select *, row_number() over (partition by session_id, floor(source_timestamp_ns / 100000000.0e0) order by source_timestamp_ns desc, frame_seq desc) > 1 as skipped from frame_item),
r as (select *, max(case when not skipped then frame_seq end) over (partition by session_id order by source_timestamp_ns, frame_seq) as k from s)
select frame_seq, case when k is null then 0 else 1 + cast(k % 2 as int) end as items, case when k is null then null else k end as item_of, case when skipped then null else round(frame_seq / 10.0e0, 3) end as distance_m from r""", "frame_item")
def carried_items(v):
    """Skipped frames show the items of the frame they carry, without its distances."""
    item = F.struct(F.col("frame_seq").alias("of"), F.round(F.col("frame_seq") / 10, 3).alias("distance_m"))
    f = v("frame_item").withColumn("items", F.when(F.col("frame_seq") % 2 == 0, F.array(item)).otherwise(F.array(item, item)))
    c = ts.conflate(f, 100_000_000, items="items")
    first = F.get("items", F.lit(0))
    return c.select("frame_seq", F.coalesce(F.size("items"), F.lit(0)).alias("items"), first.of.alias("item_of"), first.distance_m.alias("distance_m"))


@query("""select k.start as slot_s, vehicle_id, count(*) as n from (select user_id as vehicle_id, epoch_us(ts) // 1000000 as s from events) e, (select unnest(range(0, 5)) as i) o, lateral (select (s // 60 - i) * 60 as start) k group by 1, 2""")
def event_rate_windows(v):
    """The sliding windows of the stream over a table: each event counts in the five that hold it."""
    e = v("events").select(F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"))
    return windows.event_rates(e).select(F.unix_seconds("window.start").alias("slot_s"), "vehicle_id", "n")


@query("""with c as (select source_id, epoch_us(sampled_at) // 3600000000 as slot, frames_inferred as f, sampled_at from stage_counter)
select source_id, slot * 3600 as slot_s, max(f) as frames_end, min(f) as frames_start from c group by source_id, slot""", "stage_counter")
def counter_windows(v):
    c = v("stage_counter").withColumn("sampled_at", F.col("sampled_at").cast("timestamp"))
    w = windows.metric_windows(c, size="1 hour")
    return w.select("source_id", F.unix_seconds("window.start").alias("slot_s"), "frames_end", "frames_start")


@query("select distinct external_id, epoch_us(recorded_at) as at_us from vehicle_position p join vehicle v on v.vehicle_id = p.vehicle_id where vehicle_status <> 'OFFLINE'", "vehicle_position", "vehicle")
def known_positions(v):
    """Positions of known vehicles, each observed time once: the sink's rule over a table."""
    p = v("vehicle_position").select(F.concat(F.lit("X"), F.col("vehicle_id").cast("string")).alias("external_id"), F.col("recorded_at").cast("timestamp").alias("observed_at"))
    fresh = sinks.fresh_positions(p, v("vehicle").where("vehicle_status <> 'OFFLINE'"))
    return fresh.select("external_id", F.unix_micros("observed_at").alias("at_us"))


@query(f"""with {_EDGES}, ps as (select g.way_id, g.segment, seq, lat, lon from g join osm_node o on o.node_id = g.node_id union all select g.way_id, g.segment + 1, seq, lat, lon from g join osm_node o on o.node_id = g.node_id where vx = 1),
pc as (select way_id, segment, count(case when lat is distinct from plat or lon is distinct from plon then 1 end) as points from (select *, lag(lat) over w as plat, lag(lon) over w as plon from ps window w as (partition by way_id, segment order by seq)) q group by 1, 2)
select a.way_id, cast(a.segment as bigint) as segment, reverse, points from a join pc on pc.way_id = a.way_id and pc.segment = a.segment""", "osm_way_ref", "osm_way", "osm_node")
def edge_lines(v):
    """The points of every edge, in its own direction; two that lie at one place count once."""
    lines = road.edge_lines(v("osm_node"), v("osm_way"), v("osm_way_ref"))
    return lines.select("way_id", F.col("segment").cast("long").alias("segment"), "reverse", F.size("line").cast("long").alias("points"))


@query(f"""with {_NEARWAY}, o as (select way_id, facility_id, {hav('f.lat', 'f.lon', 'n.lat', 'n.lon')} as d from (select r.way_id, min(n.lat) as lat, min(n.lon) as lon from osm_way_ref r join osm_way y on r.way_id = y.way_id and highway in {"('motorway', 'primary', 'residential', 'service', 'track')"} join osm_node n on n.node_id = r.node_id group by 1 having count(*) = 1) n, facility f),
z as (select facility_id, way_id, d from m where d < 60 union all select facility_id, way_id, d from o where d < 60)
select facility_id, way_id, round(d, 6) as distance_m from (select *, row_number() over (partition by facility_id order by round(d, 6), way_id) as rn from z) q where rn = 1""", "osm_way_ref", "osm_way", "osm_node", "facility")
def nearest_way_single_points(v):
    return road.nearest_way(v("facility"), v("osm_node"), v("osm_way"), v("osm_way_ref"), single_points=True)


@query("select position_id, lat between -90 and 90 and lng between -180 and 180 and position_id % 13 <> 0 as valid from vehicle_position", "vehicle_position")
def valid_points(v):
    lat = F.when(F.col("position_id") % 13 != 0, F.col("lat"))
    return v("vehicle_position").select("position_id", geo.valid_point(lat, F.col("lng")).alias("valid"))
