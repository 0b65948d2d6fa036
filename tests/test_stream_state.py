"""Streams that are stopped, broken and go on: the same rows as without."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import limits
from tessera.plans.registry import table
from tessera.plans.streams import _in_files
from tessera.sources.work import scratch_path
from tessera.streaming import limits as stream_limits
from tessera.streaming import sinks


def test_limiter_state_survives_a_restart(spark, sf):
    """Stopped after its first micro-batch and run again: the batch replay's starts and waits."""
    folder, stream = scratch_path(spark, "limiter"), _in_files(spark, sf, "events", "ts", 3)
    limited = stream_limits.limited(stream, 3, 500.0)
    parts = {"starts": lambda batch: batch}
    sinks.run(limited, folder, parts, stop_before=1)
    early = sinks.read(spark, folder, "starts").count()
    sinks.run(limited, folder, parts)
    got = sinks.read(spark, folder, "starts")
    want = limits.replay(table(spark, sf, "events"), 3, 500.0)
    assert 0 < early < got.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("stop", [0, 1, 3])
def test_stopped_and_unstopped_runs_give_the_same(spark, sf, stop):
    stream, folder = _in_files(spark, sf, "events", "event_id", 4), scratch_path(spark, "stopped")
    sinks.run(stream, folder, {"e": lambda batch: batch}, stop_before=stop)
    if stop:
        before = sinks.read(spark, folder, "e").count()
        sinks.counted("e", spark, folder, 100)
    sinks.run(stream, folder, {"e": lambda batch: batch})
    got, want = sinks.read(spark, folder, "e"), table(spark, sf, "events")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.select("event_id").collect())
    sinks.counted("e", spark, folder, 100)
    if stop and before >= 100:
        assert sinks.snapshot(spark, folder, "e", before).count() == before
    assert sinks.snapshot(spark, folder, "e", want.count()).count() == want.count()


def test_both_sinks_have_each_row_once_after_a_break(spark, sf):
    stream, folder = _in_files(spark, sf, "events", "event_id", 4), scratch_path(spark, "broken")
    parts = {"low": lambda batch: batch.where("value < 50"), "high": lambda batch: batch.where("value >= 50")}
    sinks.run(stream, folder, parts, broken_after="low")
    assert sinks.read(spark, folder, "low").count() > 0
    sinks.run(stream, folder, parts)
    for name, where in (("low", F.col("value") < 50), ("high", F.col("value") >= 50)):
        want = table(spark, sf, "events").where(where)
        assert sorted(r.event_id for r in sinks.read(spark, folder, name).collect()) == sorted(r.event_id for r in want.collect())
