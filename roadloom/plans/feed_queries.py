"""Registered queries of feeds, traces, turn bans, replays and upkeep, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars
from roadloom.operators import feeds as fd
from roadloom.operators import history as h
from roadloom.operators import roadnet as road
from roadloom.operators import timeseries as ts
from roadloom.plans.queries import _CENTERS, _EDGES, _LAST, _MAY, _MEASURED, _NEAR, _NEARWAY, _PROFILES, _SPEED, _centers, hav, query, r6

_LINE = "upper(regexp_replace(line_no, '[ ]+', '', 'g'))"
_DIR = f"""w as (select *, {_LINE} as line, max(stop_index) over (partition by payload_id, line_no) as route_count,
nullif(min(case when marker = 'Y' then stop_index end) over (partition by payload_id, line_no), 0) as turnaround from feed_item),
d as (select *, case when turnaround is null then 'full_route' when stop_index <= turnaround then 'outbound' else 'inbound' end as direction from w where vehicle_no is not null)"""


@query(f"with {_DIR} select item_id, line as line_no, direction, case when direction = 'inbound' then turnaround else 1 end as start_index, case when direction = 'outbound' then turnaround else route_count end as end_index from d", "feed_item")
def line_direction(v):
    return fd.derive_direction(v("feed_item")).select("item_id", "line_no", "direction", "start_index", "end_index")


@query(f"with {_DIR} select item_id, round(case when route_count > 0 then greatest(0, least(100, stop_index / route_count * 100)) end, 6) as pct from d", "feed_item")
def route_progress(v):
    d = fd.derive_direction(v("feed_item"))
    return d.select("item_id", r6(fd.progress(F.lit(None).cast("double"), F.col("stop_index"), F.col("route_count"))).alias("pct"))


@query("select asked, coalesce(min(case when upper(replace(public_no, ' ', '')) = asked then line_id end), min(line_id)) as line_id from line_candidate group by asked", "line_candidate")
def line_resolution(v):
    return fd.resolve_line(v("line_candidate"))


_CHOSEN = f"c as (select line, vehicle_no from (select {_LINE} as line, vehicle_no, row_number() over (partition by {_LINE} order by payload_id, vehicle_no) as rn from feed_item where vehicle_no is not null) q where rn = 1)"


@query(f"with {_CHOSEN} select line as line_no, vehicle_no from c", "feed_item")
def selected_vehicle(v):
    return fd.select_vehicle(v("feed_item"))


@query("""with w as (select *, lag(gps_time) over w as pt, lag(lat) over w as plat, lag(lng) over w as plng, row_number() over w as rn from feed_item where vehicle_no is not null window w as (partition by vehicle_no order by gps_time, item_id))
select item_id, vehicle_no from w where rn = 1 or gps_time is distinct from pt or round(lat, 7) is distinct from round(plat, 7) or round(lng, 7) is distinct from round(plng, 7)""", "feed_item")
def changed_fixes(v):
    return fd.drop_repeats(v("feed_item").where("vehicle_no is not null"), "vehicle_no", ["gps_time", "item_id"], "gps_time").select("item_id", "vehicle_no")


@query("select vehicle_no, item_id from (select *, row_number() over (partition by vehicle_no order by gps_time desc, item_id desc) as rn from feed_item where vehicle_no is not null) q where rn = 1", "feed_item")
def playback_snapshot(v):
    return h.latest(v("feed_item").where("vehicle_no is not null"), ["vehicle_no"], ["gps_time", "item_id"]).select("vehicle_no", "item_id")


_CLOCK = """o as (select *, row_number() over (partition by line_no, direction, trace_id, recorded_at order by point_id) as rn from trace_point where point_class = 'ok'),
k as (select line_no, direction, trace_id, point_id, lat, lng, speed_kmh, (epoch_us(recorded_at) - min(epoch_us(recorded_at)) over (partition by line_no, direction, trace_id)) / 1e6 as s from o where rn = 1)"""
_TRACE = f"""{_CLOCK}, z as (select line_no, direction, trace_id, max(s) as s, count(*) as n from k group by 1, 2, 3 having count(*) >= 2),
b as (select line_no, direction, trace_id from (select *, row_number() over (partition by line_no, direction order by s desc, n desc, trace_id) as rn from z) q where rn = 1),
tr as (select k.* from k join b using (line_no, direction, trace_id))"""


def _trace(v):
    return fd.select_trace(fd.trace_clock(v("trace_point")))


@query(f"with {_CLOCK} select point_id, trace_id, round(s, 3) as trace_time_s from k", "trace_point")
def trace_clock(v):
    return fd.trace_clock(v("trace_point")).select("point_id", "trace_id", F.round("trace_time_s", 3).alias("trace_time_s"))


@query(f"with {_TRACE} select line_no, direction, min(trace_id) as trace_id, count(*) as points, max(s) as seconds from tr group by 1, 2", "trace_point")
def chosen_trace(v):
    return _trace(v).groupBy("line_no", "direction").agg(F.min("trace_id").alias("trace_id"), F.count("*").alias("points"), F.max("trace_time_s").alias("seconds"))


_PICK = """n as (select line_no, count(distinct direction) as n, min(direction) as sole from tr group by line_no), u as (select distinct line_no, direction from tr),
pk as (select f.*, case when u.direction is not null then f.direction when n = 1 then sole when g.direction is not null then 'full_route' end as td from feed_fix f left join n on f.line_no = n.line_no
left join u on u.line_no = f.line_no and u.direction = f.direction left join u g on g.line_no = f.line_no and g.direction = 'full_route')"""


@query(f"with {_TRACE}, {_PICK} select fix_id, td as trace_direction from pk", "feed_fix", "trace_point")
def fix_trace(v):
    return fd.pick_trace(v("feed_fix"), _trace(v)).select("fix_id", "trace_direction")


_PROJ = f"""{_TRACE}, {_PICK}, sg as (select line_no, direction, s as s1, lat as lat1, lng as lng1, lead(s) over w as s2, lead(lat) over w as lat2, lead(lng) over w as lng2 from tr window w as (partition by line_no, direction order by s)),
x as (select fix_id, s1, s2, lat1, lng1, lat2, lng2, (lng1 - lng) * greatest(1, cos(radians(lat)) * 111000.0) as ax, (lat1 - lat) * 111000.0 as ay, (lng2 - lng1) * greatest(1, cos(radians(lat)) * 111000.0) as dx, (lat2 - lat1) * 111000.0 as dy from pk join sg on sg.line_no = pk.line_no and sg.direction = pk.td where s2 is not null),
y as (select *, case when dx * dx + dy * dy > 0 then greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) else 0.0 end as r from x),
pj as (select fix_id, round(sqrt(pow(ax + r * dx, 2) + pow(ay + r * dy, 2)), 6) as distance_m, s1, s1 * (1 - r) + s2 * r as s, lat1 * (1 - r) + lat2 * r as lat, lng1 * (1 - r) + lng2 * r as lng from y)"""


@query(f"with {_PROJ} select fix_id, distance_m, round(s, 2) as trace_time_s, round(lat, 6) as lat, round(lng, 6) as lng from (select *, row_number() over (partition by fix_id order by distance_m, s1) as rn from pj) q where rn = 1", "feed_fix", "trace_point")
def fix_on_trace(v):
    p = fd.project_to_trace(v("feed_fix"), _trace(v))
    return p.select("fix_id", "distance_m", F.round("trace_time_s", 2).alias("trace_time_s"), r6("trace_lat").alias("lat"), r6("trace_lng").alias("lng"))


@query(f"""with {_TRACE}, t as (select fix_id, line_no, direction, (fix_id * 977.0e0) % 2500000 as s from feed_fix),
a as (select t.*, p.s as s0, p.lat as lat0, p.speed_kmh as v0 from t asof left join tr p on t.line_no = p.line_no and t.direction = p.direction and t.s >= p.s),
c as (select a.*, q.s as s1, q.lat as lat1, q.speed_kmh as v1 from a asof left join tr q on a.line_no = q.line_no and a.direction = q.direction and a.s <= q.s),
r as (select *, coalesce(case when s1 > s0 then (s - s0) / (s1 - s0) else 0.0 end, 0.0) as r from c where s0 is not null or s1 is not null)
select fix_id, round(coalesce(lat0, lat1) * (1 - r) + coalesce(lat1, lat0) * r, 6) as lat, round(coalesce(v0, v1) * (1 - r) + coalesce(v1, v0) * r, 5) as kmh from r""", "feed_fix", "trace_point")
def place_at_time(v):
    ticks = v("feed_fix").select("fix_id", "line_no", "direction", ((F.col("fix_id") * F.lit(977.0)) % 2500000).alias("trace_time_s"))
    return fd.trace_at(ticks, _trace(v)).select("fix_id", r6("trace_lat").alias("lat"), F.round("trace_speed_kmh", 5).alias("kmh"))


@query(f"""with {_CHOSEN}, l as (select {_LINE} as line, count(*) as samples, count(vehicle_no) as vehicle_rows from feed_item group by 1)
select l.line as line_no, samples, vehicle_rows, vehicle_no, l.line in (select line_no from trace_point where point_class = 'ok') as history_ready from l left join c on c.line = l.line""", "feed_item", "trace_point")
def feed_status(v):
    return fd.feed_status(v("feed_item"), fd.usable_points(v("trace_point"))).select("line_no", "samples", "vehicle_rows", "vehicle_no", "history_ready")


@query("""with a as (select line_no, (epoch_us(timestamp '2024-01-30 12:00:00') - max(epoch_us(observed_at))) / 1e6 as age from feed_fix group by line_no)
select line_no, round(age, 1) as live_age_s, case when age <= 15 then 'live' else 'stale' end as state from a""", "feed_fix")
def line_freshness(v):
    return fd.freshness(v("feed_fix"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("""select item_id, case when item_id % 4 in (1, 2) then 'BIMS_LIVE' else 'BIMS_REPLAY' end as telemetry_source, coalesce(vehicle_no, concat('line:', line_no)) as external_id from feed_item""", "feed_item")
def observations(v):
    state = F.element_at(F.array(*[F.lit(s) for s in ("hidden", "live", "reconciling", "interpolated")]), (F.col("item_id") % 4 + 1).cast("int"))
    return fd.to_observation(v("feed_item").withColumn("state", state)).select("item_id", "telemetry_source", "external_id")


@query("select f.frame_seq, k.frame_seq as keyframe_seq from frame_item f asof left join (select session_id, frame_seq from frame_item where frame_seq % 12 = 5) k on f.session_id = k.session_id and f.frame_seq >= k.frame_seq", "frame_item")
def keyframe_before(v):
    f = v("frame_item").select("session_id", "frame_seq")
    return ts.keyframe_at(f, f.withColumn("keyframe", F.col("frame_seq") % 12 == 5), ["session_id"]).select("frame_seq", "keyframe_seq")


_PAIR = """f as materialized (select session_id, frame_seq, source_timestamp_ns as m, source_timestamp_ns + 5000000 as r from frame_item), e as materialized (select session_id, seq as event_id, coalesce(source_timestamp_ns, -1) as m, capture_timestamp_ns + (seq % 9) * 40000000 - case when seq % 3 > 0 then 20000000 else 0 end as tm from qr_read),
x as materialized (select session_id, event_id, min(frame_seq) as frame_seq from (select e.session_id, f.frame_seq, min(e.event_id) as event_id from e join f on e.session_id = f.session_id and e.m = f.m group by 1, 2) q group by 1, 2),
ff as materialized (select * from f anti join x using (frame_seq)), fe as materialized (select * from e anti join x using (event_id)),
c1 as materialized (select fe.session_id, event_id, frame_seq, abs(tm - r) as d from fe join ff on fe.session_id = ff.session_id and r between tm - 250000000 and tm + 250000000)"""
#: Rounds of the pairing in SQL; the data need four.
_ROUNDS = 6
_PAIR += "".join(f""",
n{i} as materialized (select * from (select *, row_number() over (partition by session_id, event_id order by d, frame_seq) as a, row_number() over (partition by session_id, frame_seq order by d, event_id) as b from c{i}) q where a = 1 and b = 1),
c{i + 1} as materialized (select * from c{i} anti join n{i} using (event_id) anti join (select frame_seq from n{i}) k using (frame_seq))""" for i in range(1, _ROUNDS + 1))
_PAIRED = "select event_id, frame_seq, true as exact from x" + "".join(f" union all select event_id, frame_seq, false from n{i}" for i in range(1, _ROUNDS + 1))


@query(f"with {_PAIR} {_PAIRED}", "frame_item", "qr_read")
def event_frames(v):
    f = v("frame_item").selectExpr("session_id", "frame_seq", "source_timestamp_ns as media_ts", "source_timestamp_ns + 5000000 as received")
    e = v("qr_read").selectExpr("session_id", "seq as event_id", "coalesce(source_timestamp_ns, -1) as media_ts", "capture_timestamp_ns + (seq % 9) * 40000000 as received", "case when seq % 3 > 0 then 20000000 else -1 end as latency")
    return ts.pair_events(f, e).select("event_id", "frame_seq", "exact")


@query("""with s as (select *, row_number() over (partition by session_id, floor(source_timestamp_ns / 100000000.0e0) order by source_timestamp_ns desc, frame_seq desc) > 1 as skipped from frame_item)
select frame_seq, skipped, max(case when not skipped then frame_seq end) over (partition by session_id order by source_timestamp_ns, frame_seq) as result_seq from s""", "frame_item")
def conflated_frames(v):
    return ts.conflate(v("frame_item"), 100_000_000).select("frame_seq", "skipped", "result_seq")


@query(f"""with {_NEAR}, s as (select *, max(case when decode_success then seq end) over (partition by session_id order by seq) as hs, max(case when decode_success then seq end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as ps from qr_read),
j as (select s.session_id, s.decode_success as ok, o.seq is not null and s.capture_timestamp_ns - o.capture_timestamp_ns <= 200000000 as held, s.decode_success and s.source_timestamp_ns < p.source_timestamp_ns - 2000000 as back from s left join qr_read o on o.seq = s.hs left join qr_read p on p.seq = s.ps),
q as (select session_id, count(*) as reads, count(case when ok then 1 end) as valid, count(case when not ok and held then 1 end) as carried, count(case when not ok and not held then 1 end) as missing, count(case when back then 1 end) as rewinds from j group by 1),
i as (select session_id, count(*) as frames, count(case when timestamp_ns is null then 1 end) as without_imu from l where rn = 1 group by 1)
select q.session_id, reads, valid, carried, missing, rewinds, frames, without_imu, round(valid / reads * 100, 6) as valid_pct from q left join i on q.session_id = i.session_id""", "qr_read", "frame_item", "imu_sample")
def qr_coverage(v):
    joined = ts.nearest_asof(v("frame_item"), v("imu_sample"), ["session_id"], "source_timestamp_ns", "timestamp_ns", 50_000_000)
    return ts.qr_report(v("qr_read"), joined).withColumn("valid_pct", r6("valid_pct"))


_BAN = """m as (select r.rel_id, restriction, max(case when role = 'from' and mtype = 'way' then nullif(ref, 0) end) as from_way, max(case when role = 'via' and mtype = 'node' then nullif(ref, 0) end) as via_node, max(case when role = 'to' and mtype = 'way' then nullif(ref, 0) end) as to_way
from relation r left join relation_member b on r.rel_id = b.rel_id group by 1, 2), g as (select way_id from osm_way where highway <> 'footway'),
t as (select * from m where from_way is not null and via_node is not null and to_way is not null and (from_way in (select way_id from g) or to_way in (select way_id from g)))"""


def _ways(v):
    return v("osm_way").where("highway <> 'footway'").select("way_id")


@query(f"with {_BAN} select rel_id, from_way, via_node, to_way, restriction from t where restriction like 'no\\_%' escape '\\'", "relation", "relation_member", "osm_way")
def turn_bans(v):
    return road.extract_turn_bans(v("relation"), v("relation_member"), _ways(v))


@query(f"with {_BAN} select (select count(*) from m where from_way is null or via_node is null or to_way is null) as incomplete, count(case when restriction like 'no\\_%' escape '\\' then 1 end) as usable, count(case when restriction like 'only%' then 1 end) as skipped_only from t", "relation", "relation_member", "osm_way")
def turn_ban_report(v):
    return road.turn_report(v("relation"), v("relation_member"), _ways(v))


_FAC = f"""{_NEARWAY}, nw as (select facility_id, way_id, round(d, 6) as d from (select *, row_number() over (partition by facility_id order by round(d, 6), way_id) as rn from m where d < 60) q where rn = 1),
fo as (select nw.way_id, nw.facility_id, d, case when height_m between 1.5 and 6 then height_m end as maxheight, case when width_m between 1.5 and 30 then width_m end as maxwidth from nw join facility f on f.facility_id = nw.facility_id)"""


@query(f"with {_FAC} select way_id, facility_id, maxheight, maxwidth from (select *, row_number() over (partition by way_id order by d, facility_id) as rn from fo where maxheight is not null or maxwidth is not null) q where rn = 1", "osm_way_ref", "osm_way", "osm_node", "facility")
def facility_overrides(v):
    m = road.nearest_way(v("facility"), v("osm_node"), v("osm_way"), v("osm_way_ref"))
    f = v("facility").select("facility_id", scalars.plausible(F.col("height_m"), 1.5, 6.0).alias("maxheight"), scalars.plausible(F.col("width_m"), 1.5, 30.0).alias("maxwidth"))
    return road.match_facilities(f, m, ["maxheight", "maxwidth"])


_OV = "select s_suppkey * 4 as way_id, case when s_suppkey % 3 > 0 then cast(s_suppkey % 5 as string) end as maxheight, case when s_suppkey % 2 = 0 then '12t' end as maxweight, s_suppkey % 5 = 0 as by_hand from supplier"


def _overrides(v):
    return v("supplier").selectExpr("s_suppkey * 4 as way_id", "case when s_suppkey % 3 > 0 then cast(s_suppkey % 5 as string) end as maxheight", "case when s_suppkey % 2 = 0 then '12t' end as maxweight", "s_suppkey % 5 = 0 as by_hand")


@query(f"with o as ({_OV}) select w.way_id, highway, coalesce(o.maxheight, w.maxheight) as maxheight, coalesce(o.maxweight, w.maxweight) as maxweight from osm_way w left join o on o.way_id = w.way_id", "osm_way")
def overridden_ways(v):
    return road.apply_overrides(v("osm_way"), _overrides(v).drop("by_hand")).select("way_id", "highway", "maxheight", "maxweight")


@query(f"""with o as ({_OV}), p as (select o.way_id, by_hand, lat, lon, row_number() over (partition by o.way_id order by seq) - 1 as i, count(*) over (partition by o.way_id) as n from o join osm_way_ref r on r.way_id = o.way_id join osm_node d on d.node_id = r.node_id)
select way_id, by_hand, round(lat, 6) as lat, round(lon, 6) as lon from p where i = n // 2 and lat between 35.05 and 35.25 and lon between 128.85 and 129.15 order by by_hand desc, way_id limit 500""", "osm_way_ref", "osm_node")
def override_map(v):
    o = road.override_layer(_overrides(v), v("osm_node"), v("osm_way_ref"), (35.05, 128.85, 35.25, 129.15))
    return o.select("way_id", "by_hand", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(f"""with {_EDGES}, t as (select highway, profile, sum(dist_m / (least({_SPEED}, top) / 3.6)) as s from a, {_PROFILES} where {_MAY} group by 1, 2)
select highway, {", ".join(f"round(max(case when profile = '{p}' then s end), 3) as {p}" for p in ("car", "truck_small", "truck_semi", "truck_special"))} from t group by highway""", "osm_way_ref", "osm_way", "osm_node")
def profile_comparison(v):
    e = road.build_edges(v("osm_node"), v("osm_way"), v("osm_way_ref"))
    return road.compare_profiles(e).select("highway", *[F.round(p[0], 3).alias(p[0]) for p in road.PROFILES])


@query(f"""with {_EDGES}, w as (select src, dst, way_id, min(dist_m / ({_SPEED} / 3.6)) as w from a group by 1, 2, 3),
o as (select s_suppkey as source, dst as node, way_id, w as c from supplier join w on src = s_suppkey),
t as (select o.source, w.dst as node, o.c + w.w as c from o join w on w.src = o.node where not exists (select 1 from turn_ban b where b.from_way = o.way_id and b.via_node = o.node and b.to_way = w.way_id))
select source, node, round(min(c), 5) as seconds from (select source, node, c from o union all select * from t union all select s_suppkey, s_suppkey, 0.0e0 from supplier) q group by 1, 2""", "osm_way_ref", "osm_way", "osm_node", "turn_ban")
def shortest_with_bans_two_hops(v):
    e = road.build_edges(v("osm_node"), v("osm_way"), v("osm_way_ref")).withColumn("seconds", F.col("dist_m") / (scalars.base_speed(F.col("highway")) / 3.6))
    p = road.shortest_paths(v("supplier").select(F.col("s_suppkey").alias("node_id")), e, v("turn_ban"), 2, ways=False)
    return p.select("source", "node", F.round("seconds", 5).alias("seconds"))


@query(f"""with {_CENTERS}, l as (select *, {_LAST.format('vehicle_id')} from vehicle_position), d as (select center_id, vehicle_id, {hav('clat', 'clng', 'lat', 'lng')} as m from l, c where rn = 1)
select center_id, vehicle_id, rank from (select *, row_number() over (partition by center_id order by m, vehicle_id) as rank from d where m <= 8000) q where rank <= 3""", "vehicle_position", "facility")
def nearest_vehicles(v):
    return h.nearest_vehicles(v("vehicle_position"), _centers(v), 3, 8000.0).select("center_id", "vehicle_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {_MEASURED} select position_id, round(distance_m, 6) as distance_m from m where distance_m >= 500 and recorded_at between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-09 00:00:00'", "vehicle_position", "route_point")
def trip_deviations(v):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    d = h.between(h.deviations(v("vehicle_position"), v("route_point"), 500.0), "recorded_at", at("2024-01-05 00:00:00"), at("2024-01-09 00:00:00"), "recorded_at", "position_id")
    return d.select("position_id", r6("distance_m").alias("distance_m"))


@query("select detection_event_id, frame_id, class_name from detection_event where capture_timestamp_ns between 3000000000 and 90000000000 order by capture_timestamp_ns, frame_id, detection_event_id", "detection_event")
def replay_events(v):
    d = h.between(v("detection_event"), "capture_timestamp_ns", F.lit(3_000_000_000), F.lit(90_000_000_000), "capture_timestamp_ns", "frame_id", "detection_event_id")
    return d.select("detection_event_id", "frame_id", "class_name")


@query("with o as (select *, capture_timestamp_ns - min(capture_timestamp_ns) over (partition by session_id) as offset_ns from detection_event) select session_id, detection_event_id, frame_id, class_name, offset_ns from o where offset_ns between 3000000000 and 9000000000", "detection_event")
def replay_events_by_session(v):
    return h.replay_sessions(v("detection_event"), 3_000_000_000, 9_000_000_000).select("session_id", "detection_event_id", "frame_id", "class_name", "offset_ns")


@query("""with e as (select *, row_number() over (partition by trip_id order by recorded_at, position_id) as a, row_number() over (partition by trip_id order by recorded_at desc, position_id desc) as b from vehicle_position)
select t.trip_id, t.trip_status, x.lat as origin_lat, x.lng as origin_lng, y.lat as destination_lat, y.lng as destination_lng from trip t left join e x on x.trip_id = t.trip_id and x.a = 1 left join e y on y.trip_id = t.trip_id and y.b = 1""", "trip", "vehicle_position")
def trip_detail(v):
    return h.trip_detail(v("trip"), v("vehicle_position")).select("trip_id", "trip_status", "origin_lat", "origin_lng", "destination_lat", "destination_lng")


@query("""with e as (select trip_id, count(case when class_name = 'person' then 1 end) as person_events, min(distance_m) as nearest_m from detection_event group by 1), a as (select trip_id, count(*) as alerts from alert where trip_id is not null group by 1), p as (select trip_id, count(*) as points from vehicle_position group by 1)
select t.trip_id, trip_status, points, person_events, nearest_m, alerts from trip t left join e on e.trip_id = t.trip_id left join a on a.trip_id = t.trip_id left join p on p.trip_id = t.trip_id""", "trip", "vehicle_position", "detection_event", "alert")
def trip_facts(v):
    return h.trip_facts(v("trip"), v("vehicle_position"), v("detection_event"), v("alert")).select("trip_id", "trip_status", "points", "person_events", "nearest_m", "alerts")


@query(f"select (select count(*) from (select *, {_LAST.format('vehicle_id')} from vehicle_position) q where rn = 1 and speed_kmh > 0) as moving, (select count(*) from detection_event where distance_m < 5) as risk_events, (select count(*) from alert where alert_status = 'UNCONFIRMED') as unhandled", "vehicle_position", "detection_event", "alert")
def dashboard(v):
    return h.dashboard(v("vehicle_position"), v("alert"), v("detection_event"))


@query("select class_name, count(*) as events, quantile_disc(confidence, 0.25) as p25, quantile_disc(confidence, 0.5) as p50, quantile_disc(confidence, 0.75) as p75, min(distance_m) as nearest_m from detection_event group by 1", "detection_event")
def vision_diagnostics(v):
    return h.vision_diagnostics(v("detection_event")).select("class_name", "events", *[r6(c).alias(c) for c in ("p25", "p50", "p75")], "nearest_m")


@query("select goal_id, case when goal_status <> 'COMPLETED' and target_eta < timestamp '1998-01-01 00:00:00' then 'DELAYED' else goal_status end as goal_status from transport_goal", "transport_goal")
def delayed_goals(v):
    return h.mark_delayed(v("transport_goal"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("goal_id", "goal_status")


@query("""with c as (select user_id as vehicle_id, max(case when event_type = 'error' then 'MAINTENANCE' end) as s from events group by 1), d as (select vehicle_id from vehicle_position group by 1 having max(speed_kmh) < 60)
select v.vehicle_id, vehicle_code, coalesce(s, vehicle_status) as vehicle_status from vehicle v left join c on c.vehicle_id = v.vehicle_id where v.vehicle_id not in (select vehicle_id from d)""", "vehicle", "vehicle_position")
def patched_vehicles(v):
    c = v("events").groupBy(F.col("user_id").alias("vehicle_id")).agg(F.max(F.when(F.col("event_type") == "error", "MAINTENANCE")).alias("vehicle_status"))
    slow = v("vehicle_position").groupBy("vehicle_id").agg(F.max("speed_kmh").alias("top")).where("top < 60")
    return h.remove(h.patch(v("vehicle"), c, "vehicle_id"), slow, "vehicle_id").select("vehicle_id", "vehicle_code", "vehicle_status")
