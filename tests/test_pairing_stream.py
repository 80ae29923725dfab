"""The pairs of a stream equal those of the batch, in one and in five micro-batches, and in any cut of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators.timeseries import pair_events
from roadloom.streaming.pairing import EVENT, FRAME, NONE, pair_stream, settle

MS = 1_000_000
FRAMES, EVENTS = "session_id long, frame_seq long, media_ts long, received long", "session_id long, event_id long, media_ts long, received long, latency long"


def made(seed, n=150):
    r = random.Random(seed)
    frames = [(s, i, i * 33, 10_000 * MS + i * 33 * MS + r.randrange(20) * MS) for s in (1, 2) for i in range(n) if r.random() < 0.9]
    events = [(s, 1000 + i, i * 33 if r.random() < 0.3 else None if r.random() < 0.5 else -i, 10_000 * MS + i * 33 * MS + r.randrange(-300, 300) * MS, r.choice([-1, 0, 40]) * MS) for s in (1, 2) for i in range(n) if r.random() < 0.5]
    return frames, events


@pytest.mark.parametrize("seed", range(8))
def test_settled_step_by_step_as_at_once(seed):
    frames, events = made(seed)
    rows = [(FRAME, f[1], f[2], f[3]) for f in frames if f[0] == 1] + [(EVENT, e[1], NONE if e[2] is None else e[2], e[3] - max(0, e[4])) for e in events if e[0] == 1]
    rows.sort(key=lambda x: x[3])
    want, left = settle(np.array(rows, np.int64), 10**15, 250 * MS, 1000 * MS)
    assert not len(left)
    got, held, most = [], np.zeros((0, 4), np.int64), 0
    for i in range(0, len(rows), 7):
        held = np.concatenate([held, np.array(rows[i : i + 7], np.int64)])
        pairs, held = settle(held, rows[i + 7][3] if i + 7 < len(rows) else 10**15, 250 * MS, 1000 * MS)
        got, most = got + pairs, max(most, len(held))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and not len(held) and most < len(rows) / 2


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch(spark, tmp_path, batches):
    frames, events = made(99, 60)
    want = sorted(map(tuple, pair_events(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(events, EVENTS)).collect()))
    last = [(9, 1, 1, 10**14), (9, 2, 2, 2 * 10**14)]
    rows = sorted([(x[3], 0, x) for x in frames + last[:1]] + [(x[3], 1, x) for x in events])
    size = -(-len(rows) // batches)
    for i in range(batches + 1):
        part = rows[i * size : (i + 1) * size] if i < batches else [(0, 0, last[1])]
        for kind, schema, name in ((0, FRAMES, "f"), (1, EVENTS, "e")):
            spark.createDataFrame([x for _, k, x in part if k == kind], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    source = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = pair_stream(source("f", FRAMES), source("e", EVENTS))
    q = out.writeStream.format("memory").queryName(f"pairs{batches}").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table(f"pairs{batches}").where(F.col("session_id") < 9).collect())) == want and want
