"""Frames and decoded events of a session paired as they come: the choice of timeseries.pair_events, settled by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "session_id long, event_id long, frame_seq long, exact boolean"
FRAME, EVENT = 0, 1
#: Stands for an unknown media time.
NONE = np.iinfo(np.int64).min


def _exact(rows: np.ndarray, ripe: int, hold: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Of every media time whose rows are all ripe the least event and the least frame; what is left, and which of it still waits for its media time."""
    out, keep, waits = [], np.ones(len(rows), bool), np.zeros(len(rows), bool)
    known = np.flatnonzero(rows[:, 2] != NONE)
    known = known[np.argsort(rows[known, 2], kind="stable")]
    for at in np.split(known, np.flatnonzero(np.diff(rows[known, 2])) + 1):
        kinds = rows[at, 0]
        if not ((kinds == FRAME).any() and (kinds == EVENT).any()):
            continue
        if rows[at, 3].max() + hold < ripe:
            pair = [at[kinds == k][np.argmin(rows[at[kinds == k], 1])] for k in (EVENT, FRAME)]
            out.append((rows[pair[0], 1], rows[pair[1], 1], True))
            keep[pair] = False
        else:
            waits[at] = True
    return out, rows[keep], waits[keep]


def _candidates(events: np.ndarray, frames: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(event, frame, distance) of all pairs within the tolerance, in the order in which they would be chosen."""
    order = np.argsort(frames[:, 3], kind="stable")
    at = frames[order, 3]
    low, high = np.searchsorted(at, events[:, 3] - tolerance, "left"), np.searchsorted(at, events[:, 3] + tolerance, "right")
    e = np.repeat(np.arange(len(events)), high - low)
    f = order[np.arange(len(e)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    d = np.abs(events[e, 3] - frames[f, 3])
    best = np.lexsort((frames[f, 1], events[e, 1], d))
    return e[best], f[best], d[best]


def settle(rows: np.ndarray, ripe: int, tolerance: int, hold: int) -> tuple[list, np.ndarray]:
    """Pairs that no later row can change, and the rows (kind, id, media, at) that are still open; later rows have at >= ripe.

    Pairs are looked at from the nearest on, ties by event, then frame. One is final when both its rows are ripe by the
    larger of tolerance and hold and no nearer pair of either is open; else it is open, and so are its two rows. A ripe row
    without an open pair has none to come and goes.
    """
    out, rows, waits = _exact(rows, ripe, hold)
    is_ripe = (rows[:, 3] + max(tolerance, hold) < ripe) & ~waits
    is_event = rows[:, 0] == EVENT
    events, frames, ripe_e, ripe_f = rows[is_event], rows[~is_event], is_ripe[is_event], is_ripe[~is_event]
    used_e, used_f, open_e, open_f = (np.zeros(len(x), bool) for x in (events, frames, events, frames))
    for e, f, _ in zip(*_candidates(events, frames, tolerance)):
        if used_e[e] or used_f[f]:
            continue
        if open_e[e] or open_f[f] or not (ripe_e[e] and ripe_f[f]):
            open_e[e] = open_f[f] = True
        else:
            used_e[e] = used_f[f] = True
            out.append((events[e, 1], frames[f, 1], False))
    return out, np.concatenate([x[~used & (is_open | ~done)] for x, used, is_open, done in ((events, used_e, open_e, ripe_e), (frames, used_f, open_f, ripe_f))])


def pair_stream(frames: DataFrame, events: DataFrame, tolerance: int = 250_000_000, hold: int = 1_000_000_000, late: str = "1 second") -> DataFrame:
    """session_id, event_id, frame_seq, exact: the pairs of timeseries.pair_events, each as soon as it is final.

    frames: session_id, frame_seq, media_ts, received; events: session_id, event_id, media_ts, received, latency; times in
    nanoseconds, `received` also being event time. Rows of one media time must lie within `hold` of each other. A session's
    state is its open rows: those of the last `late` and the larger of tolerance and hold, and what they may still take.
    Rows behind the watermark are left out, as is usual; a timer settles a session that gets no more rows.
    """
    media = F.coalesce(F.col("media_ts").cast("long"), F.lit(int(NONE)))
    at = F.col("received") - F.when(F.col("latency") >= 0, F.col("latency")).otherwise(0)
    f = frames.select("session_id", F.lit(FRAME).cast("long").alias("kind"), F.col("frame_seq").cast("long").alias("id"), media.alias("media"), F.col("received").cast("long").alias("at"))
    e = events.select("session_id", F.lit(EVENT).cast("long").alias("kind"), F.col("event_id").cast("long").alias("id"), media.alias("media"), at.cast("long").alias("at"))
    rows = f.unionByName(e).where("session_id is not null and at is not null").withColumn("seen", F.timestamp_micros(F.expr("at div 1000")))
    wait_ms = max(tolerance, hold) // 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(bytes(state.get[0]), np.int64).reshape(-1, 4) if state.exists else np.zeros((0, 4), np.int64)
        if not state.hasTimedOut:
            held = np.concatenate([held, *[p[["kind", "id", "media", "at"]].to_numpy(np.int64) for p in parts]])
        now = state.getCurrentWatermarkMs()
        pairs, left = settle(held, now * 1_000_000, tolerance, hold)
        state.update((left.tobytes(),))
        if len(left):
            state.setTimeoutTimestamp(int(max(now, left[:, 3].min() // 1_000_000 + wait_ms)) + 2)
        yield pd.DataFrame([(key[0], *p) for p in pairs], columns=["session_id", "event_id", "frame_seq", "exact"])

    keyed = rows.withWatermark("seen", late).groupBy("session_id")
    return keyed.applyInPandasWithState(run, _OUT, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
