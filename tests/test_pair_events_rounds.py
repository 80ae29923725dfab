"""Pairing in rounds: only mutual nearest ones are taken, and the candidates of earlier rounds go."""

import os

from roadloom.operators.timeseries import pair_events
from roadloom.sources.scratch import shared_dir


def test_rounds_leave_no_candidates_behind(spark):
    gap, at, events, frames = 12_000_000, 0, [], []
    for i in range(4):  # e1 f1 e2 f2 .. ever closer, so each round adds the last pair that is left
        events.append((1, i, -1 - i, at, -1))
        frames.append((1, i, i, at + gap))
        at, gap = at + gap + gap - 1_000_000, gap - 2_000_000
    e = spark.createDataFrame(events, "session_id long, event_id long, media_ts long, received long, latency long")
    f = spark.createDataFrame(frames, "session_id long, frame_seq long, media_ts long, received long")
    before = set(os.listdir(shared_dir(spark))) if os.path.exists(shared_dir(spark)) else set()
    got = {(r.event_id, r.frame_seq, r.exact) for r in pair_events(f, e).collect()}
    assert got == {(i, i, False) for i in range(4)}
    assert len(set(os.listdir(shared_dir(spark))) - before) <= 6  # exact pairs, four rounds, and what is left
