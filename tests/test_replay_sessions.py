"""A replay window lies in every session, so its rows grow with the table."""

from roadloom.operators import history
from roadloom.plans import feed_queries  # noqa: F401
from roadloom.plans.queries import QUERIES


def test_window_in_every_session(spark):
    df = spark.createDataFrame([(s, s * 10**12 + i * 10**9) for s in range(5) for i in range(6)], "session_id long, capture_timestamp_ns long")
    got = sorted((r.session_id, r.offset_ns) for r in history.replay_sessions(df, 10**9, 2 * 10**9).collect())
    assert got == [(s, i * 10**9) for s in range(5) for i in (1, 2)]


def test_rows_grow_with_the_table(spark):
    n = [QUERIES["replay_events_by_session"](spark, f"/root/testdata/{sf}").count() for sf in ("sf0.01", "sf0.1")]
    assert n[1] > 5 * n[0] > 0
