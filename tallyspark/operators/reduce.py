"""Reduction of local reports to certified global estimates, as joins and aggregations.

parts    (window, part, n_local, q_local, [head_mass])    one row a partition
reports  (window, part, kind, id, est, eps)               kind: "ss", "head" or "plain"

An estimate of an "ss" row overshoots by at most eps, and a key that a full
summary does not report has at most its least counter there. "head" rows are
exact, and "plain" rows carry no certificate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import strict_threshold
from ..functions.held import held


def from_sketch(sketch: DataFrame, kind: str = "ss", hold: bool = True) -> tuple[DataFrame, DataFrame]:
    """parts and reports of a sketch's rows. With hold, the sketch runs once, for all that is made of it."""
    sketch = held(sketch) if hold else sketch
    parts = sketch.groupBy("window", "part").agg(F.max("n_local").alias("n_local"), F.max("q_local").alias("q_local"))
    reports = sketch.select("window", "part", F.lit(kind).alias("kind"), F.col("key").alias("id"), "est", F.coalesce("eps", F.lit(0)).alias("eps"))
    return parts, reports


def certify(parts: DataFrame, reports: DataFrame, n: int, prune: bool = True, reducer: str = "hash", workers: int | None = None) -> DataFrame:
    """One row per (window, id): est, reporters, omega, cert_lb, cert_ub, inflation, hidden, resolution_part, guaranteed, mass, threshold.

    A partition must report an id once. The non-reporters' least counters are the sum over all partitions less that
    over reporters, so no key is paired with the partitions that miss it. With
    prune, keys whose upper bound is below the threshold go.

    reducer "hash" deals ids by hash. "streaming" merges a window's reports in order
    of id, one worker a window. "parallel-streaming" does so over ranges of ids,
    balanced by a sample, in as many as `workers`. Results are the same.
    """
    w = ["window", "part"]
    least = reports.filter("kind = 'ss'").groupBy(*w).agg(F.count("*").alias("held"), F.min("est").alias("least"))
    ceilings = parts.join(least, w, "left").withColumn("floor", F.when((F.col("q_local") > 0) & (F.col("held") >= F.col("q_local")), F.col("least")).otherwise(F.lit(0)))
    totals = ceilings.groupBy("window").agg(F.sum("n_local").alias("mass"), F.sum("floor").alias("floors")).withColumn("threshold", strict_threshold(F.col("mass"), n))
    joined = reports.join(ceilings.select(*w, "n_local", "floor"), w)
    head, ss = F.col("kind") == "head", F.col("kind") == "ss"
    if reducer == "parallel-streaming":
        joined = (joined.repartitionByRange(workers, "window", "id") if workers else joined.repartitionByRange("window", "id")).sortWithinPartitions("window", "id")
    elif reducer == "streaming":
        joined = joined.repartition("window").sortWithinPartitions("window", "id")
    elif reducer != "hash":
        raise ValueError(f"unknown reducer {reducer}")
    # a partition reports an id once, so its rows are counted as they are: one shuffle
    items = joined.groupBy("window", "id").agg(
        F.sum("est").alias("est"),
        F.sum(F.when(head, F.lit(0)).otherwise(F.col("eps"))).alias("inflation"),
        F.count("*").alias("reporters"),
        F.sum("n_local").alias("seen"),
        F.sum("floor").alias("own_floor"),
        F.min("part").alias("resolution_part"),
        F.bool_or(head).alias("head"),
        F.bool_or(ss).alias("ss"),
    )
    both = items.join(totals, "window")
    hidden = F.when(F.col("head") | ~F.col("ss"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("floors") - F.col("own_floor")))
    out = (
        both.withColumn("hidden", hidden)
        .withColumn("cert_lb", F.when(F.col("head"), F.col("est")).otherwise(F.greatest(F.lit(0), F.col("est") - F.col("inflation"))))
        .withColumn("cert_ub", F.when(F.col("head"), F.col("est")).otherwise(F.col("est") + F.col("hidden")))
    )
    if prune:
        out = out.filter(F.col("cert_ub") >= F.col("threshold"))
    return out.select(
        "window",
        "id",
        "est",
        F.col("reporters").cast("long").alias("reporters"),
        (F.col("seen") / F.col("mass")).alias("omega"),
        "cert_lb",
        "cert_ub",
        "inflation",
        F.col("hidden").cast("long").alias("hidden"),
        "resolution_part",
        (F.col("cert_lb") >= F.col("threshold")).alias("guaranteed"),
        "mass",
        "threshold",
    )


def certified_class(items: DataFrame) -> DataFrame:
    """items with class: "heavy", "light" or "ambiguous"."""
    c = F.when(F.col("cert_lb") >= F.col("threshold"), "heavy").when(F.col("cert_ub") < F.col("threshold"), "light").otherwise("ambiguous")
    return items.withColumn("class", c)


def window_summary(parts: DataFrame, reports: DataFrame, n: int) -> DataFrame:
    """(window, mass, threshold, unseen_ub, complete): the most that a key which nobody reports can have, and whether that is below the threshold."""
    least = reports.filter("kind = 'ss'").groupBy("window", "part").agg(F.count("*").alias("held"), F.min("est").alias("least"))
    full = (F.col("q_local") > 0) & (F.col("held") >= F.col("q_local"))
    one = parts.join(least, ["window", "part"], "left").groupBy("window").agg(F.sum("n_local").alias("mass"), F.sum(F.when(full, F.col("least")).otherwise(F.lit(0))).alias("unseen_ub"))
    out = one.withColumn("threshold", strict_threshold(F.col("mass"), n))
    return out.select("window", "mass", "threshold", "unseen_ub", (F.col("unseen_ub") < F.col("threshold")).alias("complete"))


def coordinated(parts: DataFrame, reports: DataFrame, n: int, top: int) -> dict[str, DataFrame]:
    """One pass, three views: published (may reach the threshold), residual (of these, those outside the head), top (the largest estimates).

    Head keys whose exact count is below the threshold aren't published.
    """
    items = certify(parts, reports, n, prune=False)
    head = reports.filter("kind = 'head'").select("window", "id").distinct()
    published = items.filter(F.col("cert_ub") >= F.col("threshold"))
    order = Window.partitionBy("window").orderBy(F.desc("est"), "id")
    ranked = items.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return {"items": items, "published": published, "residual": published.join(head, ["window", "id"], "left_anti"), "top": ranked}


def check_head(reports: DataFrame, generation: int, size: int) -> None:
    """Raises where head rows (slot, head_gen) have another generation or a slot that the dictionary lacks."""
    bad = reports.filter((F.col("head_gen") != generation) | (F.col("slot") >= size) | (F.col("slot") < 0))
    if bad.limit(1).count():
        raise RuntimeError("a head record doesn't fit the installed dictionary")


def reduce_buckets(cells: DataFrame, n: int, depth: int, residuals: DataFrame | None = None, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merges bucketed sketches: (items, summary).

    cells (window, part, bucket, id, est, lb); residuals (window, part, bucket,
    residual); parts (window, part, n_local). Per bucket the `depth` largest ids
    stay. With residuals the upper bound is the lower one plus the bucket's
    residual, at most the mass; without, bounds are 0 and est. summary: unseen_ub
    is the most an id that didn't stay can have; complete if below the threshold.
    Residuals must be known for every (part, bucket) that has cells: else bounds
    would not hold, and it raises where it is read.
    """
    if residuals is not None:
        lacking = F.when(F.col("_known").isNull(), F.raise_error(F.lit("a bucket has cells but no residual")).cast("boolean")).otherwise(F.lit(True))
        there = residuals.select("window", "part", "bucket", F.lit(True).alias("_known")).distinct()
        cells = cells.join(there, ["window", "part", "bucket"], "left").filter(lacking).drop("_known")
    totals = parts.groupBy("window").agg(F.sum("n_local").alias("mass")).withColumn("threshold", strict_threshold(F.col("mass"), n))
    merged = cells.groupBy("window", "bucket", "id").agg(F.sum("est").alias("est"), F.sum("lb").alias("lb"), F.count_distinct("part").alias("reporters"), F.min("part").alias("resolution_part"))
    order = Window.partitionBy("window", "bucket").orderBy(F.desc("est"), "id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).join(totals, "window")
    known = residuals is not None
    if known:
        rest = residuals.groupBy("window", "bucket").agg(F.sum("residual").alias("residual"))
        bounded = ranked.join(rest, ["window", "bucket"], "left").withColumn("residual", F.coalesce("residual", F.lit(0)))
        bounded = bounded.withColumn("cert_lb", F.col("lb")).withColumn("cert_ub", F.least("mass", F.col("lb") + F.col("residual")))
    else:
        bounded = ranked.withColumn("cert_lb", F.lit(0).cast("long")).withColumn("cert_ub", F.col("est"))
    items = bounded.filter(F.col("rank") <= depth).select(
        "window", "id", "bucket", "est", "reporters", "cert_lb", "cert_ub", "resolution_part",
        (F.lit(known) & (F.col("cert_lb") >= F.col("threshold"))).alias("guaranteed"), "mass", "threshold",
    )
    if not known:
        return items, totals.select("window", "mass", "threshold", F.lit(None).cast("long").alias("unseen_ub"), F.lit(False).alias("complete"))
    dropped = bounded.filter(F.col("rank") > depth).groupBy("window").agg(F.max("cert_ub").alias("dropped"))
    largest = rest.groupBy("window").agg(F.max("residual").alias("largest"))
    both = totals.join(largest, "window", "left").join(dropped, "window", "left")
    unseen = F.greatest(F.coalesce("largest", F.lit(0)), F.coalesce("dropped", F.lit(0)))
    return items, both.select("window", "mass", "threshold", unseen.alias("unseen_ub"), (unseen < F.col("threshold")).alias("complete"))


def resolve_keys(items: DataFrame, keys: DataFrame, known: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Published ids with their raw keys: those of `known` (id, key), the installed head's, else fetched from the partition that resolves each.

    keys is (window, part, id, key). With strict, an id without a key raises where
    it is read; else its key is null.
    """
    wanted = items.filter(F.col("est") >= F.col("threshold"))
    found = wanted.join(keys.withColumnRenamed("part", "resolution_part"), ["window", "resolution_part", "id"], "left")
    if known is not None:
        found = found.join(known.select("id", F.col("key").alias("_known")), "id", "left").withColumn("key", F.coalesce("_known", "key")).drop("_known")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no partition resolves "), F.col("id").cast("string")))
        found = found.withColumn("key", F.when(F.col("key").isNull(), lost).otherwise(F.col("key")))
    return found


def coordinator_bytes(parts: DataFrame, reports: DataFrame, items: DataFrame) -> DataFrame:
    """Modelled bytes per window of what a coordinator receives and holds: 20 a record, 4 more for its error, 8 a head record, 32 a header."""
    size = F.when(F.col("kind") == "head", 8).when(F.col("kind") == "ss", 24).otherwise(20)
    ingress = reports.groupBy("window").agg(F.sum(size).alias("records"), F.count_distinct("id").alias("ids"))
    headers = parts.groupBy("window").agg((F.count("*") * 32).alias("headers"))
    kept = items.groupBy("window").agg(F.count("*").alias("items"))
    one = headers.join(ingress, "window", "left").join(kept, "window", "left").na.fill(0)
    return one.select("window", (F.col("headers") + F.col("records")).alias("ingress"), (F.col("ids") * 48).alias("aggregate"), (F.col("items") * 64).alias("result"), (F.col("headers") + F.col("records") + F.col("ids") * 48 + F.col("items") * 64).alias("peak"))


def equivalent(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-10, keys: tuple[str, ...] = ("window",)) -> DataFrame:
    """Rows of two results that aren't the same in all columns within the tolerance: empty when the reducers agree."""
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    differs = F.col("in_a").isNull() | F.col("in_b").isNull()
    for c in columns:
        p, q = F.col(f"a_{c}").cast("double"), F.col(f"b_{c}").cast("double")
        differs = differs | ~F.coalesce(F.abs(p - q) <= tolerance, p.isNull() & q.isNull())
    return x.join(y, list(keys), "full_outer").filter(differs)
