"""Joins and repairs of samples on different clocks. Every window is within one recording, or a segment of a long one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.scans import SEGMENT, scan, segmented
from roadloom.sources.scratch import discard, materialize


def nearest_asof(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, tolerance: int, bucket: int | None = None) -> DataFrame:
    """left with the right columns nearest in time, within tolerance; a tie takes the earlier sample; else nulls.

    One shuffle by `by` and a time bucket of at least the tolerance; a right row is also sent to the bucket before and after.
    """
    size = max(bucket or 20 * tolerance, tolerance + 1)
    b = lambda c: F.floor(F.col(c) / size).cast("long")
    values = [c for c in right.columns if c not in (*by, right_on)]
    r = right.select(*by, F.col(right_on).alias("t"), F.struct(F.col(right_on).alias("t"), *values).alias("sample"), F.lit(0).alias("side"), F.explode(F.sequence(b(right_on) - 1, b(right_on) + 1)).alias("slot"))
    l = left.select(*by, F.col(on).alias("t"), F.struct(*left.columns).alias("row"), F.lit(1).alias("side"), b(on).alias("slot"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(*by, "slot").orderBy("t", "side")
    back = F.last("sample", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(*by, "slot").orderBy(F.desc("t"), "side")
    ahead = F.last("sample", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    df = both.withColumn("back", back).withColumn("ahead", ahead).where("side = 1")
    before, after = F.col("t") - F.col("back.t"), F.col("ahead.t") - F.col("t")
    best = F.when(F.col("back").isNull() | (after < before), F.col("ahead")).otherwise(F.col("back"))
    df = df.withColumn("best", best).withColumn("best", F.when(F.abs(F.col("best.t") - F.col("t")) <= tolerance, F.col("best")))
    return df.select("row.*", F.col("best.t").alias(f"{right_on}_matched"), *[F.col(f"best.{v}").alias(v) for v in values])


def timeline(reads: DataFrame, frames: DataFrame, imu: DataFrame, by: list[str], on: str = "source_timestamp_ns", frame_ns: int = 50_000_000, imu_ns: int = 50_000_000) -> DataFrame:
    """reads with frame_index, frame_ns, frame_delta_ns of the nearest frame of the recording, imu_ns, imu_delta_ns and the
    samples of the one nearest to that frame, and status.

    dataset_timestamp_unavailable: no frame within frame_ns of the time `on` (or it is unknown); imu_unavailable: no sample
    within imu_ns of the frame; else ok. frames: by.., frame_index, timestamp_ns; imu: by.., timestamp_ns, ..
    """
    own = frames.select(*by, "frame_index", F.col("timestamp_ns").alias("frame_ns"))
    a = nearest_asof(reads, own, by, on, "frame_ns", frame_ns).withColumnRenamed("frame_ns_matched", "frame_ns")
    samples = imu.withColumnRenamed("timestamp_ns", "imu_ns")
    b = nearest_asof(a, samples, by, "frame_ns", "imu_ns", imu_ns).withColumnRenamed("imu_ns_matched", "imu_ns")
    status = F.when(F.col("frame_ns").isNull(), "dataset_timestamp_unavailable").when(F.col("imu_ns").isNull(), "imu_unavailable").otherwise("ok")
    return b.withColumns({"frame_delta_ns": F.abs(F.col("frame_ns") - F.col(on)), "imu_delta_ns": F.abs(F.col("imu_ns") - F.col("frame_ns")), "status": status})


def between_marks(rows: DataFrame, marks: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """rows (by.., t, row) with lo and hi, the marks (by.., t, mark) at or before and at or after t; a mark at t is both."""
    both = marks.withColumn("side", F.lit(0)).unionByName(rows.withColumn("side", F.lit(1)), allowMissingColumns=True)
    held = F.when(F.col("mark").isNotNull(), F.struct("t", "mark"))
    df = scan(segmented(both, by, ["t", "side"], most), by, ["t", "side"], lo=("last", held), hi=("next", held)).where("side = 1")
    df = df.withColumn("hi", F.when(F.col("lo.t") == F.col("t"), F.col("lo")).otherwise(F.col("hi")))
    return df.select(*by, "t", "row", F.col("lo.mark").alias("lo"), F.col("hi.mark").alias("hi"))


def to_video_pts(events: DataFrame, anchors: DataFrame, by: list[str], on: str = "capture_timestamp_ns", pts: str = "video_pts_us", most: int | None = None) -> DataFrame:
    """Capture time to video time on the line between the two anchors around it; null outside the anchors."""
    a = anchors.select(*by, F.col(on).alias("t"), F.struct(F.col(on).alias("t"), F.col(pts).alias("p")).alias("mark"))
    e = events.select(*by, F.col(on).alias("t"), F.struct(*events.columns).alias("row"))
    df = between_marks(e, a, by, most)
    span = F.col("hi.t") - F.col("lo.t")
    at = F.when(span == 0, F.col("lo.p")).otherwise(F.col("lo.p") + (F.col("t") - F.col("lo.t")) * (F.col("hi.p") - F.col("lo.p")) / span)
    return df.select("row.*", at.cast("double").alias("pts_us"))


def qr_resolve(reads: DataFrame, by: str = "session_id", carry_ns: int = 200_000_000, most: int | None = None) -> DataFrame:
    """Decoded values carry on for up to 200 ms of capture time: ok, qr_stale or qr_missing.

    Where either capture time is unknown, a step of seq counts as 33,333,333 ns; without that too nothing is carried.
    """
    got = F.coalesce(F.col("decode_success") & F.col("source_timestamp_ns").isNotNull(), F.lit(False))
    seen = F.when(got, F.struct("source_timestamp_ns", "capture_timestamp_ns", "seq"))
    df = scan(segmented(reads, [by], ["seq"], most), [by], ["seq"], held=("last", seen)).drop(SEGMENT)
    age = F.coalesce(F.col("capture_timestamp_ns") - F.col("held.capture_timestamp_ns"), (F.col("seq") - F.col("held.seq")) * 33_333_333)
    status = F.when(got, "ok").when(age <= carry_ns, "qr_stale").otherwise("qr_missing")
    df = df.withColumn("status", status)
    return df.withColumn("resolved_ns", F.when(F.col("status") != "qr_missing", F.col("held.source_timestamp_ns"))).drop("held")


def rewind_epoch(reads: DataFrame, by: str = "session_id", slack_ns: int = 2_000_000, most: int | None = None) -> DataFrame:
    """A new epoch begins where a decoded value falls more than 2 ms below the decoded one before it."""
    read = F.when(F.col("decode_success"), F.col("source_timestamp_ns"))
    df = scan(segmented(reads, [by], ["seq"], most), [by], ["seq"], before=("last", read, True))
    step = F.when(F.col("decode_success") & (F.col("source_timestamp_ns") < F.col("before") - slack_ns), 1).otherwise(0)
    return scan(df.withColumn("step", step), [by], ["seq"], epoch=("sum", F.col("step"))).drop("step", "before", SEGMENT)


def _unwrapped(df: DataFrame, value: str, bits: int, by: str, order: str) -> DataFrame:
    full, half = 1 << bits, 1 << (bits - 1)
    df = scan(df, [by], [order], before=("last", F.struct(F.col(value).alias("v")), True))
    d = F.col(value) - F.col("before.v")
    turn = F.when(d < -half, full).when(d > half, -full).otherwise(0)
    df = scan(df.withColumn("turn", turn.cast("long")), [by], [order], turns=("sum", F.col("turn")))
    return df.withColumn("unwrapped", F.col(value) + F.col("turns")).drop("turn", "turns", "before")


def unwrap(df: DataFrame, value: str, bits: int, by: str, order: str, most: int | None = None) -> DataFrame:
    """A counter of `bits` bits made monotone over its wraps, forward and backward."""
    return _unwrapped(segmented(df, [by], [order], most), value, bits, by, order).drop(SEGMENT)


def sequence_gaps(packets: DataFrame, by: str = "session_id", order: str = "arrival", most: int | None = None) -> DataFrame:
    """16-bit sequence numbers: behind the last accepted is late; ahead of the expected opens an epoch."""
    df = _unwrapped(segmented(packets, [by], [order], most), "seq16", 16, by, order)
    df = scan(df, [by], [order], best=("max", F.col("unwrapped"), True)).withColumn("late", F.coalesce(F.col("unwrapped") <= F.col("best"), F.lit(False)))
    gap = F.coalesce(~F.col("late") & (F.col("unwrapped") > F.col("best") + 1), F.lit(False))
    return scan(df.withColumn("gap", gap), [by], [order], epoch=("sum", F.col("gap").cast("long"))).drop("best", SEGMENT)


def stage_metrics(counters: DataFrame, every: str = "1 hour") -> DataFrame:
    """Frames per second and mean model ms of each source and interval, from the last counters in it and before it."""
    slot = F.date_trunc("hour", "sampled_at") if every == "1 hour" else F.window(F.col("sampled_at").cast("timestamp"), every).start
    last = F.max(F.struct("frames_inferred", "model_ms_total", "sampled_at")).alias("x")
    df = counters.groupBy("source_id", slot.alias("slot")).agg(last).select("source_id", "slot", "x.*")
    w = Window.partitionBy("source_id").orderBy("slot")
    df = df.withColumn("frames", F.greatest(F.lit(0), F.col("frames_inferred") - F.lag("frames_inferred").over(w))).withColumn("ms", F.greatest(F.lit(0.0), F.col("model_ms_total") - F.lag("model_ms_total").over(w)))
    s = (F.unix_micros(F.col("sampled_at").cast("timestamp")) - F.unix_micros(F.lag("sampled_at").over(w).cast("timestamp"))) / 1e6
    df = df.withColumn("elapsed_s", s).where("elapsed_s is not null")
    return df.select("source_id", "slot", "frames", "elapsed_s", F.when(F.col("elapsed_s") > 0, F.col("frames") / F.col("elapsed_s")).alias("fps"), F.when(F.col("frames") > 0, F.col("ms") / F.col("frames")).otherwise(F.lit(0.0)).alias("mean_ms"))


def keyframe_at(requests: DataFrame, frames: DataFrame, by: list[str], seq: str = "frame_seq", most: int | None = None) -> DataFrame:
    """requests with the newest keyframe at or before their sequence number; null before the first."""
    k = frames.where("keyframe").select(*by, F.col(seq).alias("t"), F.col(seq).alias("mark"))
    r = requests.select(*by, F.col(seq).alias("t"), F.struct(*requests.columns).alias("row"))
    return between_marks(r, k, by, most).select("row.*", F.col("lo").alias("keyframe_seq"))


def pair_events(frames: DataFrame, events: DataFrame, tolerance: int = 250_000_000) -> DataFrame:
    """event_id, frame_seq, exact: one frame for an event, by equal media time, else the nearest free one in tolerance.

    frames: session_id, frame_seq, media_ts, received; events: session_id, event_id, media_ts, received, latency (taken
    off when not negative). Nearest pairs are mutual: an event's nearest free frame whose nearest event it is. Rounds go on
    among the events and frames that are left until no pair is added, so an event takes its next frame where the
    nearest is another's. A round's nearest ones are partial aggregates, so candidates are not sorted or sent for them.
    """
    hit = events.alias("e").join(frames.alias("f"), (F.col("e.session_id") == F.col("f.session_id")) & (F.col("e.media_ts") == F.col("f.media_ts")))
    exact = materialize(hit.groupBy("e.session_id", "f.frame_seq").agg(F.min("e.event_id").alias("event_id")).groupBy("session_id", "event_id").agg(F.min("frame_seq").alias("frame_seq")))
    free_f = frames.join(exact, ["session_id", "frame_seq"], "left_anti")
    free_e = events.join(exact, ["session_id", "event_id"], "left_anti").withColumn("at", F.col("received") - F.when(F.col("latency") >= 0, F.col("latency")).otherwise(0))
    slot = lambda c: F.floor(c / tolerance).cast("long")
    f = free_f.select("session_id", "frame_seq", F.col("received").alias("f_at"), slot(F.col("received")).alias("slot"))
    e = free_e.select("session_id", "event_id", "at", F.explode(F.sequence(slot(F.col("at")) - 1, slot(F.col("at")) + 1)).alias("slot"))
    near = e.join(f, ["session_id", "slot"]).withColumn("d", F.abs(F.col("at") - F.col("f_at"))).where(F.col("d") <= tolerance)
    near = materialize(near.select("session_id", "event_id", "frame_seq", "d"))
    nearest = lambda own, other: near.groupBy("session_id", own).agg(F.min(F.struct("d", other)).alias("x")).select("session_id", own, f"x.{other}")
    pairs = exact.select("session_id", "event_id", "frame_seq", F.lit(True).alias("exact"))
    while not near.isEmpty():
        new = materialize(nearest("event_id", "frame_seq").join(nearest("frame_seq", "event_id"), ["session_id", "event_id", "frame_seq"]))
        pairs = pairs.unionByName(new.withColumn("exact", F.lit(False)))
        before, near = near, near.join(new.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti").join(new.select("session_id", "frame_seq"), ["session_id", "frame_seq"], "left_anti")
        near = materialize(near)
        discard(before)
    return pairs


def conflate(frames: DataFrame, slot_ns: int, by: str = "session_id", seq: str = "frame_seq", time: str = "source_timestamp_ns", items: str | None = None, dropped: tuple[str, ...] = ("distance_m",)) -> DataFrame:
    """The newest frame of each inference slot is kept; others are skipped and carry the last kept frame before them.

    items: an array of structs, what was found in a frame. A skipped frame shows those of the frame it carries (none
    before the first), with the fields `dropped` null, as a distance holds for its own frame only.
    """
    newest = F.row_number().over(Window.partitionBy(by, "slot").orderBy(F.desc(time), F.desc(seq)))
    df = frames.withColumn("slot", F.floor(F.col(time) / slot_ns).cast("long")).withColumn("skipped", newest > 1)
    w = Window.partitionBy(by).orderBy(time, seq)
    df = df.withColumn("result_seq", F.last(F.when(~F.col("skipped"), F.col(seq)), ignorenulls=True).over(w))
    if items is None:
        return df
    kind = {f.name: f.dataType for f in frames.schema[items].dataType.elementType.fields}

    def bare(x: Column) -> Column:
        for c in dropped:
            x = x.withField(c, F.lit(None).cast(kind[c])) if c in kind else x
        return x

    kept = F.last(F.when(~F.col("skipped"), F.coalesce(F.col(items), F.array().cast(frames.schema[items].dataType))), ignorenulls=True).over(w)
    return df.withColumn(items, F.when(F.col("skipped"), F.transform(kept, bare)).otherwise(F.col(items)))


def qr_report(reads: DataFrame, joined: DataFrame, by: str = "session_id") -> DataFrame:
    """Valid, carried and missing reads, rewinds and frames with and without an IMU sample, by recording."""
    q = rewind_epoch(qr_resolve(reads, by), by).groupBy(by).agg(
        F.count("*").alias("reads"), F.count_if(F.col("status") == "ok").alias("valid"), F.count_if(F.col("status") == "qr_stale").alias("carried"),
        F.count_if(F.col("status") == "qr_missing").alias("missing"), F.max("epoch").alias("rewinds"))
    j = joined.groupBy(by).agg(F.count("*").alias("frames"), F.count_if(F.col("timestamp_ns_matched").isNull()).alias("without_imu"))
    return q.join(j, by, "left").withColumn("valid_pct", F.col("valid") / F.col("reads") * 100)


def resume_frames(frames: DataFrame, epoch: int, after: int) -> DataFrame:
    """Frames of the epoch with a sequence number above the last one shown, in order."""
    return frames.where((F.col("epoch") == epoch) & (F.col("frame_seq") > after)).orderBy("frame_seq")
