"""Certified heavy hitters over Structured Streaming.

Two forms: exact windowed counts with a watermark, wholly by Spark's operators;
and summaries with capacity control, where each micro-batch's closed windows run
the batch pipeline and the controller's small state lives on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import strict_threshold
from ..operators import reduce, sketches
from ..plans.control import Controller, Policy
from ..plans.methods import frontier


def read_events(spark: SparkSession, path: str, schema: str = "ts timestamp, part int, pos long, key string, weight long", files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(start, key, cnt) of tumbling event-time windows; events later than the watermark are dropped."""
    w = F.window("ts", width)
    kept = events.filter("weight > 0").withWatermark("ts", late)
    return kept.groupBy(w.alias("w"), "key").agg(F.sum("weight").alias("cnt")).select(F.col("w.start").alias("start"), "key", "cnt")


def batch_heavy_hitters(closed: DataFrame, n: int) -> DataFrame:
    """Heavy hitters of counts of closed windows, for foreachBatch."""
    mass = closed.groupBy("start").agg(F.sum("cnt").alias("mass")).withColumn("threshold", strict_threshold(F.col("mass"), n))
    return closed.join(mass, "start").filter("cnt >= threshold")


def heavy_hitter_stream(events: DataFrame, width: str, late: str, n: int, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a query that gives each closed window's heavy hitters to sink(frame, batch id)."""

    def one(batch: DataFrame, number: int) -> None:
        sink(batch_heavy_hitters(batch, n), number)

    counts = windowed_counts(events, width, late)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(one).trigger(**(trigger or {"availableNow": True})).start()


_SUMMARY = "window long, part int, n_local long, q_local long, key string, est long, eps long"
_STATE = "mass long, keys array<string>, counts array<long>, errors array<long>, touched array<long>, clock long"


def streaming_summaries(events: DataFrame, width_seconds: int, late: str, q: int) -> DataFrame:
    """Space-Saving reports of each (window, part), kept as bounded state and emitted when the watermark closes the window.

    events have ts, part, pos, key, weight. The order inside a micro-batch is pos;
    micro-batches are in arrival order. Events of a window that the watermark has
    closed are dropped.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, part = group
        summary = sketches.SpaceSaving(q)
        if state.exists:
            restore(summary, state.get)
        if state.hasTimedOut:
            state.remove()
            rows = [(window, part, summary.mass, summary.q, *r) for r in summary.report()]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _SUMMARY.split(", ")])
            return
        end = int((window + 1) * width_seconds * 1000)
        if end <= state.getCurrentWatermarkMs():
            return
        for frame in frames:
            for key, weight in frame.sort_values("pos")[["key", "weight"]].itertuples(index=False):
                summary.update(key, int(weight))
        state.update(save(summary))
        state.setTimeoutTimestamp(end)

    kept = events.filter("weight > 0").withWatermark("ts", late)
    at = kept.withColumn("window", F.floor(F.unix_seconds("ts") / width_seconds).cast("long"))
    return at.groupBy("window", "part").applyInPandasWithState(run, _SUMMARY, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def save(s: sketches.SpaceSaving) -> tuple:
    keys = list(s.count)
    return (s.mass, keys, [s.count[k] for k in keys], [s.error[k] for k in keys], [s.touched[k] for k in keys], s.clock)


def restore(s: sketches.SpaceSaving, saved: tuple) -> None:
    s.mass, keys, counts, errors, touched, s.clock = saved
    s.count, s.error, s.touched = (dict(zip(keys, x)) for x in (counts, errors, touched))
    s.heap = sorted(zip(counts, touched, keys))
    s.largest_error = max(errors, default=0)


@dataclass
class AdaptiveRun:
    """foreachBatch state of an adaptive run: each batch holds whole windows, which it reduces in order.

    A window that comes again, or after a later one, raises: it would be reduced
    in pieces. Feed it from a stream that emits closed windows.
    """

    policy: Policy
    sink: Callable[[DataFrame, int], None]
    q: int = 0
    last: int | None = None
    controller: Controller = field(init=False)
    history: list[tuple[int, int, float]] = field(default_factory=list)

    def __post_init__(self):
        self.controller = Controller(self.policy)
        self.q = self.q or self.policy.clamp(self.policy.n)

    def __call__(self, batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for window in sorted(r[0] for r in held.select("window").distinct().collect()):
                if self.last is not None and window <= self.last:
                    raise ValueError(f"window {window} comes after window {self.last}")
                self.step(held.filter(F.col("window") == window), window)
                self.last = window
        finally:
            held.unpersist()

    def step(self, events: DataFrame, window: int) -> None:
        items = reduce.certify(*reduce.from_sketch(sketches.space_saving(events, self.q)), self.policy.n).persist()
        total = items.select("mass", "threshold").first()
        if total:
            decision = self.controller.next(self.q, frontier(items), total.mass, total.threshold)
            self.history.append((window, self.q, decision.margin))
            self.sink(items, window)
            self.q = decision.q
        items.unpersist()
