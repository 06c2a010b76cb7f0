"""Quality of estimates against exact counts, certificates, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import linear_quantile, ratio, strict_threshold


def evaluate(exact: DataFrame, method: DataFrame, n: int, k: int | None = None) -> DataFrame:
    """Per window: tp, fp, fn, precision, recall, f1, heavy, aae, are, and with k the overlap of the top k.

    exact (window, id, cnt); method (window, id, est, threshold). A method predicts
    ids whose estimate reaches its own threshold. Errors are over all exact heavy
    hitters, an absent one with estimate 0. No prediction has precision 1; no heavy
    hitter, recall 1; both 0, F1 0.
    """
    mass = F.sum("cnt").over(Window.partitionBy("window"))
    truth = exact.withColumn("_t", strict_threshold(mass, n)).select("window", "id", "cnt", (F.col("cnt") >= F.col("_t")).alias("heavy"))
    said = method.select("window", "id", "est", (F.col("est") >= F.col("threshold")).alias("said"))
    both = truth.join(said, ["window", "id"], "full_outer")
    heavy, claimed = F.coalesce("heavy", F.lit(False)), F.coalesce("said", F.lit(False))
    error = F.abs(F.coalesce("est", F.lit(0)) - F.col("cnt"))
    one = both.groupBy("window").agg(
        F.count_if(heavy & claimed).alias("tp"),
        F.count_if(~heavy & claimed).alias("fp"),
        F.count_if(heavy & ~claimed).alias("fn"),
        F.count_if(heavy).alias("heavy"),
        F.sum(F.when(heavy, error).otherwise(F.lit(0))).alias("abs_error"),
        F.sum(F.when(heavy, error / F.col("cnt")).otherwise(F.lit(0.0))).alias("rel_error"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    out = one.withColumn("precision", precision).withColumn("recall", recall)
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
    out = out.withColumn("aae", ratio(F.col("abs_error"), F.col("heavy"), 0.0)).withColumn("are", ratio(F.col("rel_error"), F.col("heavy"), 0.0))
    if k is not None:
        out = out.join(top_overlap(exact.withColumnRenamed("cnt", "est"), method, k), "window", "left").withColumn("overlap", F.coalesce("overlap", F.lit(1.0)))
    return out


def top_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(window, overlap): shared ids of the two top k over the least of k and both sizes; 1 where that is 0."""
    order = Window.partitionBy("window").orderBy(F.desc("est"), "id")
    first = lambda x: x.select("window", "id", F.row_number().over(order).alias("_r")).filter(F.col("_r") <= k).select("window", "id")
    x, y = first(a), first(b)
    sizes = x.groupBy("window").agg(F.count("*").alias("n")).join(y.groupBy("window").agg(F.count("*").alias("m")), "window", "full_outer")
    shared = x.join(y, ["window", "id"], "left_semi").groupBy("window").agg(F.count("*").alias("shared"))
    least = F.least(F.lit(k), F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))
    return sizes.join(shared, "window", "left").select("window", ratio(F.coalesce("shared", F.lit(0)), least, 1.0).alias("overlap"))


def pooled(windows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro averages over evaluated windows: pooled precision, recall, F1 and errors."""
    one = windows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "heavy", "abs_error", "rel_error")], F.count("*").alias("windows"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    out = one.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
    return out.withColumn("aae", ratio(F.col("abs_error"), F.col("heavy"), 0.0)).withColumn("are", ratio(F.col("rel_error"), F.col("heavy"), 0.0))


def certification(exact: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Per window: candidate recall; count and mass of certified heavy, ambiguous and certified light ids; interval widths over the mass."""
    mass = F.sum("cnt").over(Window.partitionBy("window"))
    heavy = exact.withColumn("_m", mass).filter(F.col("cnt") >= strict_threshold(F.col("_m"), n)).select("window", "id")
    found = heavy.join(items.select("window", "id", F.lit(1).alias("there")), ["window", "id"], "left").groupBy("window").agg(F.count("*").alias("truth"), F.count("there").alias("found"))
    yes, no = F.col("cert_lb") >= F.col("threshold"), F.col("cert_ub") < F.col("threshold")
    maybe = ~yes & ~no
    width = (F.col("cert_ub") - F.col("cert_lb")) / F.col("mass")
    sums = lambda c: F.sum(F.when(c, F.col("est")).otherwise(F.lit(0)))
    one = items.groupBy("window").agg(
        F.count_if(yes).alias("certified_heavy"), F.count_if(maybe).alias("ambiguous"), F.count_if(no).alias("certified_light"),
        sums(yes).alias("heavy_mass"), sums(maybe).alias("ambiguous_mass"), sums(no).alias("light_mass"),
        F.avg(width).alias("width_mean"), F.avg(F.when(maybe, width)).alias("ambiguous_width_mean"), F.max(width).alias("width_max"),
    )
    return one.join(found, "window", "left").withColumn("candidate_recall", ratio(F.col("found"), F.col("truth"), 1.0)).drop("truth", "found").na.fill(1.0, ["candidate_recall"])


def without_warm_up(windows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All windows but the first of each run."""
    return windows.withColumn("_first", F.min("window").over(Window.partitionBy(*by))).filter("window > _first").drop("_first")


# Summaries of runs


def timeline(steps: DataFrame) -> DataFrame:
    """(phase, start, end) from steps (step, phase, duration), end excluded."""
    end = F.sum("duration").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("end", end).withColumn("start", F.col("end") - F.col("duration"))


def by_phase(windows: DataFrame, phases: DataFrame) -> DataFrame:
    """windows with the phase they fall in: a range join with the few phases."""
    return windows.join(F.broadcast(phases.select("phase", "start", "end")), (F.col("window") >= F.col("start")) & (F.col("window") < F.col("end")))


def phase_summary(windows: DataFrame, phases: DataFrame, n: int) -> DataFrame:
    """Means per method and phase of normalized error n * aae / mass, q / n, recall, F1 and violations."""
    return by_phase(windows, phases).groupBy("method", "phase").agg(
        F.avg(F.lit(n) * F.col("aae") / F.col("mass")).alias("normalized_error"), F.avg(F.col("q") / n).alias("q_over_n"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg(F.col("violation").cast("double")).alias("violations"), F.count("*").alias("windows")
    )


def controller_summary(windows: DataFrame, warm_up: bool = False) -> DataFrame:
    """Per method: mean quality and capacity, volatility (sample deviation of q), violations, probes issued and failed. Window 0 counts unless warm_up."""
    rows = without_warm_up(windows, ("method",)) if warm_up else windows
    return rows.groupBy("method").agg(
        F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.avg("aae").alias("aae"), F.avg("q").alias("q_mean"), F.stddev_samp("q").alias("q_volatility"),
        F.avg(F.col("violation").cast("double")).alias("violations"), F.sum(F.col("probe_issued").cast("long")).alias("probes"), F.sum(F.col("probe_failed").cast("long")).alias("failed_probes"),
    )


def acceptance(summary: DataFrame, checks: dict[str, str]) -> DataFrame:
    """One row of named boolean checks over a summary, and whether all hold: checks are SQL aggregates."""
    one = summary.agg(*[F.expr(sql).alias(name) for name, sql in checks.items()])
    every = F.lit(True)
    for name in checks:
        every = every & F.coalesce(F.col(name), F.lit(False))
    return one.withColumn("accepted", every)


def mass_by_phase(counts: DataFrame, phases: DataFrame, n: int, low: float = 0.8) -> DataFrame:
    """Per phase: least and largest mass, mean keys, heavy hitters (mean, least, most) and keys from low of the threshold to it."""
    mass = F.sum("cnt").over(Window.partitionBy("window"))
    t = strict_threshold(F.col("mass"), n)
    rows = counts.withColumn("mass", mass).withColumn("t", t)
    one = rows.groupBy("window").agg(F.first("mass").alias("mass"), F.count("*").alias("keys"), F.count_if(F.col("cnt") * n > F.col("mass")).alias("heavy"), F.count_if((F.col("cnt") >= F.col("t") * low) & (F.col("cnt") <= F.col("t"))).alias("near"))
    return by_phase(one, phases).groupBy("phase").agg(
        F.min("mass").alias("mass_min"), F.max("mass").alias("mass_max"), F.avg("keys").alias("keys_mean"), F.avg("heavy").alias("heavy_mean"), F.min("heavy").alias("heavy_min"), F.max("heavy").alias("heavy_max"), F.avg("near").alias("near_mean")
    )


def quality_summary(windows: DataFrame) -> DataFrame:
    """Per method, without window 0: pooled precision and recall rebuilt from rounded ones, and relative error weighted by heavy hitters."""
    rows = windows.filter("window > 0")
    tp = F.round(F.col("recall") * F.col("heavy"))
    rows = rows.withColumn("_tp", tp).withColumn("_said", F.when(F.col("precision") > 0, F.round(tp / F.col("precision"))).otherwise(F.lit(0.0)))
    one = rows.groupBy("method").agg(F.sum("_tp").alias("tp"), F.sum("_said").alias("said"), F.sum("heavy").alias("heavy"), F.sum(F.col("are") * F.col("heavy")).alias("rel"), F.avg("kib").alias("kib_mean"), F.min("kib").alias("kib_min"), F.max("kib").alias("kib_max"))
    return one.select("method", ratio(F.col("tp"), F.col("said"), 1.0).alias("precision"), ratio(F.col("tp"), F.col("heavy"), 1.0).alias("recall"), ratio(F.col("rel"), F.col("heavy"), 0.0).alias("are"), "kib_mean", "kib_min", "kib_max")


def epsilon_summary(windows: DataFrame) -> DataFrame:
    """Per method and epsilon: mean and nearest-rank p95 of the error, and the share of windows whose error is above epsilon."""
    rows = windows.filter("window > 0")
    return rows.groupBy("method", "epsilon").agg(F.avg("error").alias("error_mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY error)").alias("error_p95"), F.avg((F.col("error") > F.col("epsilon")).cast("double")).alias("over_epsilon"))


def systems_summary(times: DataFrame) -> DataFrame:
    """times (method, m, repetition, window, ms, events): mean, p50 and p95 a repetition without window 0, then median and quartile range over repetitions."""
    rows = times.filter("window > 0")
    each = rows.groupBy("method", "m", "repetition").agg(F.avg("ms").alias("mean"), linear_quantile("ms", 0.5).alias("p50"), linear_quantile("ms", 0.95).alias("p95"), (F.sum("events") / F.sum("ms") / 1000).alias("mevents_s"))
    aggregates = [a for c in ("mean", "p50", "p95", "mevents_s") for a in (F.median(c).alias(c), (linear_quantile(c, 0.75) - linear_quantile(c, 0.25)).alias(f"{c}_iqr"))]
    return each.groupBy("method", "m").agg(*aggregates)


def delta_summary(updates: DataFrame) -> DataFrame:
    """Per m: share of windows that shipped a delta, traffic saved against full heads, and speed-up of applying it."""
    return updates.groupBy("m").agg(F.avg(F.col("selected").cast("double")).alias("delta_selected"), (1 - F.sum("bytes") / F.sum("full_bytes")).alias("traffic_saved"), (F.sum("full_ms") / F.sum("ms")).alias("apply_speed_up"))


def ablation_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("dataset", "n", "head_policy", "method").agg(*[F.avg(c).alias(c) for c in ("f1", "recall", "aae", "are", "kib")], F.count("*").alias("windows"))


def pareto(points: DataFrame, cost: str, quality: str) -> DataFrame:
    """Points that no other beats: a running best over the cost order, instead of comparing all pairs."""
    best = F.max(quality)
    below = points.groupBy(cost).agg(best.alias("_own"))
    before = F.max("_own").over(Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = below.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_own") > F.col("_before"))).select(cost, F.col("_own").alias(quality))
    return points.join(front, [cost, quality], "left_semi")


def ecdf(values: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Each value with the share of values up to it."""
    return values.withColumn("share", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))


def communication(parts: DataFrame, reports: DataFrame) -> DataFrame:
    """Modelled upstream bytes per window and partition: a header of 32, 24 a certified record (20 and its error), 20 a plain one, 8 a head record."""
    size = F.when(F.col("kind") == "head", 8).when(F.col("kind") == "ss", 24).otherwise(20)
    sent = reports.groupBy("window", "part").agg(F.sum(size).alias("records"))
    one = parts.select("window", "part").join(sent, ["window", "part"], "left")
    return one.select("window", "part", (F.lit(32) + F.coalesce("records", F.lit(0))).cast("long").alias("bytes"))


def bucket_communication(m: int, width: int, depth: int, certified: bool) -> int:
    """Modelled bytes of one bucketed report of each of m partitions."""
    return m * (32 + width * depth * 20 + certified * (4 * width * depth + 8 * width))


def validate_run(rows: DataFrame, windows: int, methods: list[str], metrics: list[str]) -> DataFrame:
    """One row of problems in a run's table: missing columns, windows, methods a window, metrics outside 0 to 1."""
    missing = [c for c in ("window", "method", *metrics) if c not in rows.columns]
    if missing:
        return rows.sparkSession.range(1).select(F.array(*map(F.lit, missing)).alias("missing_columns"), F.lit(False).alias("valid"))
    outside = F.lit(0)
    for c in metrics:
        outside = outside + F.count_if(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1))
    per = rows.groupBy("window").agg(F.count_distinct("method").alias("methods"), outside.alias("outside"))
    one = per.agg(F.count("*").alias("windows"), F.count_if(F.col("methods") != len(methods)).alias("bad_windows"), F.coalesce(F.sum("outside"), F.lit(0)).alias("outside"))
    return one.withColumn("valid", (F.col("windows") == windows) & (F.col("bad_windows") == 0) & (F.col("outside") == 0))
