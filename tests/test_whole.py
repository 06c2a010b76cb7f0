"""Queries that run over all rows of their table, and operators on fixtures that the tables don't have."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tallyspark import queries
from tallyspark.operators import windows

SMALL = "/root/testdata/sf0.001"


def test_ordered_windows_count_every_event(spark):
    rows = queries.QUERIES["ordered_windows_with_gaps"](spark, SMALL).collect()
    assert sum(r.cnt for r in rows) == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert {r.window for r in rows} == set(range(max(r.window for r in rows) + 1))
    assert any(r.key is None for r in rows)


def test_ordered_windows_keep_real_gaps(spark):
    start = datetime(2024, 3, 1, 1)
    events = [(start + timedelta(hours=h), k) for h, k in [(0, "a"), (1, "a"), (2, "b"), (18, "a"), (43, "b")]]
    df = spark.createDataFrame(events, "ts timestamp, event_type string")
    got = sorted(((r.window, r.key, r.cnt) for r in windows.ordered_counts(df, "ts", "event_type", 6).collect()), key=str)
    assert got == [(0, "a", 2), (0, "b", 1), (1, None, 0), (2, None, 0), (3, "a", 1), (4, None, 0), (5, None, 0), (6, None, 0), (7, "b", 1)]


@pytest.mark.parametrize("swap", [None, (3, 4), (49, 50), (0, 99)])
def test_disorder_is_found_anywhere(spark, swap):
    """Inside a range of positions, across two of them, and far apart."""
    at = [*range(100)]
    if swap:
        at[swap[0]], at[swap[1]] = at[swap[1]], at[swap[0]]
    df = spark.createDataFrame([(i, datetime(2024, 3, 1) + timedelta(minutes=x)) for i, x in enumerate(at)], "pos long, ts timestamp").repartition(7)
    for parts in (1, 2, 10, 1000):
        assert windows.in_order(df, "pos", "ts", parts) == (swap is None)
    if swap:
        with pytest.raises(ValueError):
            windows.ordered_counts(df, "ts", "pos", 6)


def test_systems_summary_counts_every_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.metrics, "systems_summary", lambda times: seen.append(times) or times)
    times = queries.QUERIES["systems_summary"](spark, SMALL)
    rows = times.collect()
    assert sum(r.ms for r in rows) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert {r.repetition for r in rows} <= set(range(5))


def test_phases_cover_all_windows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.metrics, "mass_by_phase", lambda counts, phases, n: seen.append(queries.metrics.by_phase(counts, phases)) or counts.selectExpr("0 AS keys_mean", "0 AS heavy_mean", "0 AS near_mean"))
    queries.QUERIES["phase_masses"](spark, SMALL)
    rows = seen[0].groupBy("phase").sum("cnt").collect()
    assert sum(r[1] for r in rows) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count() and {r.phase for r in rows} == {"before", "early", "late"}
