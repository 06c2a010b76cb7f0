"""Windows over traces: assignment, slices, unions, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: Column, width: float, origin: float | None = None) -> DataFrame:
    """events with window = floor((ts - origin) / width) for ts in epoch seconds, in any order; rows before the origin go.

    Without an origin the first time is it: one more pass that reads only ts.
    """
    if origin is None:
        origin = events.agg(F.min(ts)).first()[0]
        if origin is None:
            origin = 0.0
    at = F.floor((ts - F.lit(origin)) / F.lit(width)).cast("long")
    return events.withColumn("window", at).filter("window >= 0")


def ordered_counts(events: DataFrame, ts: str, key: str, hours: float, origin: str | None = None) -> DataFrame:
    """(window, key, cnt) in windows of hours from the origin, by default UTC midnight of the first event.

    Every window from the first to the last is there: one without events has a row
    of null key and count 0. Events before the origin, or out of order by the
    column pos where there is one, raise.
    """
    first = events.agg(F.min(ts)).first()[0]
    start = F.to_timestamp(F.lit(origin)) if origin else F.date_trunc("day", F.lit(first))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    at = events.withColumn("window", F.floor(seconds / int(hours * 3_600_000_000)).cast("long"))
    bad = at.filter("window < 0").limit(1).count()
    if "pos" in events.columns:
        bad += not in_order(events, "pos", ts)
    if bad:
        raise ValueError("events before the origin or out of order")
    counts = at.groupBy("window", key).agg(F.count("*").alias("cnt"))
    span = counts.agg(F.max("window").alias("last"))
    calendar = span.filter("last is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("window"))
    return calendar.join(counts, "window", "left").select("window", F.col(key).alias("key"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def in_order(rows: DataFrame, by: str, value: str, parts: int = 1024) -> bool:
    """Whether value never falls along `by`. Ranges of `by` are looked through by themselves, and their ends compared."""
    span = rows.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
    if span.a is None:
        return True
    part = F.floor((F.col(by) - F.lit(span.a)) * F.lit(parts) / F.lit(max(1, span.b - span.a + 1))).cast("int")
    cut = rows.select(part.alias("_part"), F.col(by).alias("_by"), F.col(value).alias("_value")).filter("_value is not null")
    before = F.lag("_value").over(Window.partitionBy("_part").orderBy("_by", "_value"))
    if cut.withColumn("_before", before).filter("_before > _value").limit(1).count():
        return False
    ends = cut.groupBy("_part").agg(F.min("_value").alias("low"), F.max("_value").alias("high")).orderBy("_part").collect()  # `parts` rows
    return all(x.high <= y.low for x, y in zip(ends, ends[1:]))


def first_events(events: DataFrame, most: int, order: str = "pos") -> DataFrame:
    """The first `most` events in order."""
    return events.orderBy(order).limit(most)


def positive(events: DataFrame) -> DataFrame:
    """Events of positive weight: the others change no summary."""
    return events.filter("weight > 0")


def slice_windows(counts: DataFrame, start: int, count: int) -> DataFrame:
    """Windows start to start + count - 1, renumbered from 0; source_window has the old number. A missing window raises."""
    part = counts.filter((F.col("window") >= start) & (F.col("window") < start + count))
    if part.select("window").distinct().count() != count:
        raise ValueError(f"windows {start} to {start + count - 1} aren't all there")
    return part.withColumn("source_window", F.col("window")).withColumn("window", F.col("window") - start)


def concat_traces(traces: dict[str, DataFrame]) -> DataFrame:
    """One trace after another with consecutive windows, tagged source_profile and source_window. Counts must be positive."""
    out = None
    for i, (name, t) in enumerate(traces.items()):
        part = t.select("window", "key", "cnt").withColumn("_order", F.lit(i)).withColumn("source_profile", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out.filter("cnt <= 0 or cnt is null").limit(1).count():
        raise ValueError("a count isn't positive")
    # numbering works on the few distinct windows, not on the rows
    labels = out.select("_order", "window").distinct()
    numbered = labels.withColumn("_to", (F.row_number().over(Window.orderBy("_order", "window")) - 1).cast("long"))
    joined = out.join(numbered, ["_order", "window"])
    return joined.select(F.col("_to").alias("window"), "key", "cnt", "source_profile", F.col("window").alias("source_window"))


def collapse_partitions(placed: DataFrame) -> DataFrame:
    """(window, key, cnt) over partitions."""
    return placed.groupBy("window", "key").agg(F.sum("cnt").alias("cnt"))


def reindex_windows(df: DataFrame, label: str = "label") -> DataFrame:
    """Windows from 0 for labels: those of digits first, by number, then the others by text."""
    labels = df.select(label).distinct()
    digits = F.col(label).rlike("^[0-9]+$")
    order = Window.orderBy(F.when(digits, 0).otherwise(1), F.when(digits, F.col(label).cast("decimal(38,0)")), label)
    numbered = labels.withColumn("window", (F.row_number().over(order) - 1).cast("long"))
    return df.drop("window").join(numbered, label)


def validate_counts(counts: DataFrame) -> DataFrame:
    """One row: problems (bad counts, missing or negative windows, repeated keys) and whether the trace is valid."""
    per_key = counts.groupBy("window", "key").agg(F.count("*").alias("rows"), F.min("cnt").alias("least"))
    one = per_key.agg(
        F.count_if((F.col("least") <= 0) | F.col("least").isNull()).alias("bad_counts"),
        F.count_if(F.col("rows") > 1).alias("repeated_keys"),
        F.count_if(F.col("key").isNull()).alias("null_keys"),
        F.coalesce(F.min("window"), F.lit(0)).alias("first_window"),
        (F.coalesce(F.max("window") - F.min("window") + 1, F.lit(0)) - F.count_distinct("window")).alias("missing_windows"),
    )
    ok = (F.col("bad_counts") + F.col("repeated_keys") + F.col("null_keys") + F.col("missing_windows") == 0) & (F.col("first_window") == 0)
    return one.withColumn("valid", ok)


def preserved(counts: DataFrame, placed: DataFrame) -> DataFrame:
    """Keys whose count differs between a trace and its placement: empty when all counts are preserved."""
    b = placed.groupBy("window", "key").agg(F.sum("cnt").alias("placed"))
    a = counts.groupBy("window", "key").agg(F.sum("cnt").alias("cnt"))
    both = a.join(b, ["window", "key"], "full_outer").select("window", "key", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("placed", F.lit(0)).alias("placed"))
    return both.filter("cnt <> placed")
