"""Stateful streams: packet epochs, bounded retention and deviation episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.operators.history import line_distance_m, route_lines

_PACKET = "session_id long, arrival long, seq16 int, late boolean, gap boolean, epoch long"
_HELD = "session_id long, pts_90k long, epoch long, discarded boolean"


def _packets(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Late packets keep the last accepted number; one ahead of the expected opens an epoch."""
    last, epoch = state.get if state.exists else (None, 0)
    rows = pd.concat(list(parts)).sort_values("arrival", kind="stable")
    out = []
    for arrival, seq in zip(rows["arrival"], rows["seq16"]):
        delta = 0 if last is None else (int(seq) - last - 1 + 0x8000) % 0x10000 - 0x8000
        late, gap = delta < 0, delta > 0
        if not late:
            last, epoch = int(seq), epoch + int(gap)
        out.append((key[0], arrival, seq, late, gap, epoch))
    state.update((last, epoch))
    yield pd.DataFrame(out, columns=["session_id", "arrival", "seq16", "late", "gap", "epoch"])


def packet_epochs(stream: DataFrame) -> DataFrame:
    """Packets (session_id, arrival, seq16) with late, gap and epoch; the state of a session is two numbers."""
    rows = stream.select("session_id", "arrival", F.col("seq16").cast("int").alias("seq16")).where("session_id is not null and seq16 is not null")
    return rows.groupBy("session_id").applyInPandasWithState(_packets, _PACKET, "last int, epoch long", "append", GroupStateTimeout.NoTimeout)


def retain(stream: DataFrame, seconds: float = 30.0, most_bytes: int | None = None) -> DataFrame:
    """Units (session_id, pts_90k[, bytes]) with their epoch: a history longer than `seconds`, or with a cap heavier than
    most_bytes, is discarded and a new epoch opens.

    discarded marks the unit that was one too many; the new epoch begins behind it. The state is three numbers a session.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        oldest, epoch, held = state.get if state.exists else (None, 0, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values("pts_90k", kind="stable")
        for pts, size in zip(rows["pts_90k"].tolist(), rows["bytes"].tolist()):
            oldest, held = pts if oldest is None else oldest, held + size
            over = (pts - oldest) / 90000 > seconds or most_bytes is not None and held > most_bytes
            out.append((key[0], pts, epoch, over))
            if over:
                oldest, epoch, held = None, epoch + 1, 0
        state.update((oldest, epoch, held))
        yield pd.DataFrame(out, columns=["session_id", "pts_90k", "epoch", "discarded"])

    size = F.coalesce(F.col("bytes"), F.lit(0)) if "bytes" in stream.columns else F.lit(0)
    rows = stream.select("session_id", "pts_90k", size.cast("long").alias("bytes")).where("session_id is not null and pts_90k is not null")
    return rows.groupBy("session_id").applyInPandasWithState(run, _HELD, "oldest long, epoch long, held long", "append", GroupStateTimeout.NoTimeout)


def deviation_stream(stream: DataFrame, routes: DataFrame, threshold: float, gap: str = "60 seconds", late: str = "30 seconds") -> DataFrame:
    """Episodes of positions at or over threshold metres off their trip's route: a session window for each trip."""
    d = line_distance_m(F.col("lat"), F.col("lng"))
    off = stream.withWatermark("recorded_at", late).join(route_lines(routes.where("is_current")), "trip_id").withColumn("distance_m", d).where(F.col("distance_m") >= threshold)
    g = off.groupBy("trip_id", F.session_window("recorded_at", gap).alias("w")).agg(F.count("*").alias("samples"), F.max("distance_m").alias("max_m"), F.min("recorded_at").alias("started_at"), F.max("recorded_at").alias("ended_at"))
    return g.drop("w")
