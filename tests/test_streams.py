"""The streaming fold of run events: duplicates, late rows, restart from the checkpoint, forgotten runs, known steps."""

import datetime as dt
import json

import pytest

from quillspark.streaming import events


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


@pytest.fixture
def world(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen: list = []

    def feed(name, *rows):
        """A file of events, then all that is new until the stream has nothing left."""
        lines = [json.dumps({"run_id": r, "mode": "x", "payload": json.dumps({"name": f"{n}", "phase": p}), "ts": at(m).isoformat()}) for r, n, p, m in rows]
        (tmp_path / f"in/{name}.json").write_text("\n".join(lines))

    def run(checkpoint="ck", known=None):
        e = events.event_stream(spark, f"file://{tmp_path}/in")
        e = e.selectExpr("run_id", "get_json_object(payload, '$.name') AS node", "get_json_object(payload, '$.phase') AS phase", "ts")
        out = events.run_steps(e, known=known)
        q = out.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/{checkpoint}").foreachBatch(lambda d, i: seen.extend((r.run_id, r.node, r.started_at and r.started_at.minute, r.completed_at and r.completed_at.minute, r.status) for r in d.collect())).trigger(availableNow=True).start()
        q.awaitTermination(180)
        found, seen[:] = sorted(seen), []
        return found

    return feed, run


def test_fold(spark, world):
    feed, run = world
    feed("a", ("r", "plan", "start", 1), ("r", "plan", "start", 1), ("r", "plan", "end", 3), ("r", "query", "start", 4), ("r", "query", "other", 4))
    assert run() == [("r", "plan", 1, 3, "completed"), ("r", "query", 4, None, "running")]
    # Restart: the state is there; an end before its start, a repeated event, another run.
    feed("b", ("r", "query", "end", 6), ("r", "plan", "end", 2), ("s", "plan", "end", 40))
    assert run() == [("r", "plan", 1, 3, "completed"), ("r", "query", 4, 6, "completed"), ("s", "plan", None, 40, "completed")]
    # The watermark is at 30: run r is forgotten, an event of minute 5 is too late, one of minute 35 starts anew.
    feed("c", ("r", "plan", "start", 5), ("r", "late", "start", 35), ("s", "plan", "start", 39))
    assert run() == [("r", "late", 35, None, "running"), ("s", "plan", 39, 40, "completed")]


def test_known_steps(spark, world):
    feed, run = world
    known = spark.createDataFrame([("r", "plan", at(1), None), ("q", "plan", at(1), at(2))], "run_id string, node string, started_at timestamp, completed_at timestamp")
    feed("a", ("r", "plan", "end", 3))
    assert run("other", known) == [("r", "plan", 1, 3, "completed")]
