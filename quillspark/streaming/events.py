"""Run events as a stream: normalised names, duplicates dropped, step state and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_name(c: Column) -> Column:
    return F.trim(F.split_part(c, F.lit("|"), F.lit(1)))


def node_name(c: Column) -> Column:
    return F.regexp_replace(event_name(c), "^graph:", "")


def event_node(c: Column) -> Column:
    """The node of an event (JSON): from its metadata, else its name; null where there is none."""
    return F.coalesce(*[F.when(F.get_json_object(c, p) != "", F.get_json_object(c, p)) for p in ("$.metadata.langgraph_node", "$.name")])


def step_of(node: Column, steps: dict[str, list[str]]) -> Column:
    """The step that a node belongs to (``steps``: step to its nodes, the last one counts); null for others."""
    pairs = {n: step for step, nodes in steps.items() for n in nodes}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), node) if pairs else F.lit(None).cast("string")


def event_output(c: Column) -> Column:
    """The output object of an event's data (JSON), else the data; an empty object without either."""
    is_object = lambda x: F.startswith(F.ltrim(x), F.lit("{"))
    out, data = F.get_json_object(c, "$.data.output"), F.get_json_object(c, "$.data")
    return F.when(is_object(out), out).when(is_object(data), data).otherwise("{}")


def message_text(c: Column) -> Column:
    """The text of a message's content (JSON): a string, or the texts of a list of parts, a line each."""
    parts = F.from_json(c, "array<string>")
    text = F.transform(parts, lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise(x))
    whole = F.coalesce(F.get_json_object(F.concat(F.lit('{"c":'), c, F.lit("}")), "$.c"), c)
    joined = F.array_join(F.filter(text, lambda x: x != ""), "\n")
    return F.trim(F.coalesce(F.when(F.startswith(F.ltrim(c), F.lit("[")), joined).otherwise(whole), F.lit("")))


def event_stream(spark, folder: str, schema: str = "run_id string, mode string, payload string, ts timestamp") -> DataFrame:
    """A stream of run events from JSON lines that arrive in a folder; the checkpoint of its query resumes it."""
    return spark.readStream.schema(schema).json(folder)


def unique_events(events: DataFrame, keys: list[str], delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """First event of each key within the watermark; works on streams and tables."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def step_state(events: DataFrame) -> DataFrame:
    """run_id, node, started_at, completed_at, status of events (run_id, node, phase: start or end, ts)."""
    when = lambda phase, f: f(F.when(F.col("phase") == phase, F.col("ts")))
    d = events.groupBy("run_id", "node").agg(when("start", F.min).alias("started_at"), when("end", F.max).alias("completed_at"))
    return d.withColumn("status", F.when(F.col("completed_at").isNotNull(), "completed").otherwise("running"))


def progress(steps: DataFrame, relevant: int) -> DataFrame:
    """run_id, percent: completed steps among the relevant ones, half for a running one; below 100 while any runs."""
    done, busy = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "running")
    raw = F.round(100 * (done + F.when(busy > 0, 0.5).otherwise(0.0)) / relevant).cast("int")
    return steps.groupBy("run_id").agg(F.when(busy > 0, F.least(raw, F.lit(99))).otherwise(F.least(raw, F.lit(100))).alias("percent"))


STEP = "node string, started_at timestamp, completed_at timestamp"
STEPS = f"run_id string, {STEP}, status string"
#: A run without events for so long is forgotten.
FORGET_MS = 600_000


class RunFold(StatefulProcessor):
    """Steps of a run: per node the earliest start and the latest end, whatever order events come in and however often.
    A timer drops the run when the watermark has left its last event behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "node string", "started_at timestamp, completed_at timestamp")
        self.last = handle.getValueState("last", "ms long")

    def _merge(self, node: str, start, end) -> tuple:
        at = self.steps.getValue((node,)) if self.steps.containsKey((node,)) else (None, None)
        new = tuple(f((x for x in pair if x is not None), default=None) for f, pair in ((min, (at[0], start)), (max, (at[1], end))))
        self.steps.updateValue((node,), new)
        return new

    def _wait(self, ms: int) -> None:
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or ms > before:
            if before is not None:
                self.handle.deleteTimer(before + FORGET_MS)
            self.last.update((ms,))
            self.handle.registerTimer(ms + FORGET_MS)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """What is known of a run from elsewhere: a row a step."""
        for b in initialState if hasattr(initialState, "__next__") else [initialState]:
            for r in b.itertuples():
                start, end = (None if pd.isna(x) else x.to_pydatetime() for x in (r.started_at, r.completed_at))
                self._merge(r.node, start, end)
                self._wait(int((end or start).timestamp() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed, latest = {}, None
        for b in rows:
            d = b[b["phase"].isin(["start", "end"]) & b["node"].notna() & b["ts"].notna()]
            for (node, phase), ts in d.groupby(["node", "phase"])["ts"]:
                start, end = (ts.min().to_pydatetime(), None) if phase == "start" else (None, ts.max().to_pydatetime())
                changed[node] = self._merge(node, start, end)
            if len(d):
                latest = d["ts"].max() if latest is None else max(latest, d["ts"].max())
        if latest is not None:
            self._wait(int(latest.timestamp() * 1000))
            yield pd.DataFrame({"run_id": key[0], "node": list(changed), "started_at": [v[0] for v in changed.values()], "completed_at": [v[1] for v in changed.values()], "status": ["completed" if v[1] else "running" for v in changed.values()]}).astype({"started_at": "datetime64[ns]", "completed_at": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.steps.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def run_steps(events: DataFrame, delay: str = "10 minutes", known: DataFrame | None = None) -> DataFrame:
    """Streaming ``step_state``: a row for each step that a micro-batch has changed. Events (run_id, node, phase, ts) may
    repeat and come in any order within the watermark; later ones, and those without node or time, are left out. ``known``
    (run_id, node, started_at, completed_at): steps from before, where a new checkpoint begins. Needs the RocksDB state
    store (``session`` sets it)."""
    d = events.withWatermark("ts", delay).select("run_id", "node", "phase", "ts")
    first = None if known is None else known.select("run_id", "node", "started_at", "completed_at").groupBy("run_id")
    return d.groupBy("run_id").transformWithStateInPandas(RunFold(), STEPS, "Update", "EventTime", initialState=first)
