"""Exact counts, strict heavy hitters, rankings and trace statistics, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import linear_quantile, strict_threshold


def local_counts(events: DataFrame) -> DataFrame:
    """(window, part, key, cnt): summed positive weights of each partition. Other weights count for nothing."""
    return events.filter("weight > 0").groupBy("window", "part", "key").agg(F.sum("weight").alias("cnt"))


def global_counts(events: DataFrame) -> DataFrame:
    """(window, key, cnt) over all partitions."""
    return events.filter("weight > 0").groupBy("window", "key").agg(F.sum("weight").alias("cnt"))


def window_mass(counts: DataFrame, n: int) -> DataFrame:
    """(window, mass, threshold): one row a window."""
    return counts.groupBy("window").agg(F.sum("cnt").alias("mass")).withColumn("threshold", strict_threshold(F.col("mass"), n))


def with_threshold(counts: DataFrame, n: int) -> DataFrame:
    """counts with mass and threshold of the window. Totals are one row a window and join by AQE's choice."""
    return counts.join(window_mass(counts, n), "window")


def heavy_hitters(counts: DataFrame, n: int) -> DataFrame:
    """Keys of each window whose count is above mass / n."""
    return with_threshold(counts, n).filter("cnt >= threshold")


def lenient_heavy_hitters(counts: DataFrame, n: int) -> DataFrame:
    """Keys whose count reaches mass / n, equality included: the rule of the placement analysis."""
    return with_threshold(counts, n).filter(F.col("cnt") * n >= F.col("mass"))


def top_k(counts: DataFrame, k: int, by: tuple[str, ...] = ("window",), value: str = "cnt", key: str = "key", key_desc: bool = False) -> DataFrame:
    """The k largest of each group with their rank from 1; ties by key."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), F.desc(key) if key_desc else F.asc(key))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The k keys of largest total count over all windows."""
    return counts.groupBy("key").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "key").limit(k)


def key_frequency(counts: DataFrame, key: str) -> DataFrame:
    """(window, part, cnt) of one key, and its total over partitions as total."""
    mine = counts.filter(F.col("key") == key).groupBy("window", "part").agg(F.sum("cnt").alias("cnt"))
    return mine.withColumn("total", F.sum("cnt").over(Window.partitionBy("window")))


def top_n_churn(counts: DataFrame, n: int) -> DataFrame:
    """(window, shared, replaced, replacement, jaccard) of each window's top n against the window before; ties by key, descending."""
    top = top_k(counts, n, key_desc=True).select("window", "key")
    size = top.groupBy("window").agg(F.count("*").alias("size"))
    before = top.select((F.col("window") + 1).alias("window"), "key")
    shared = top.join(before, ["window", "key"], "left_semi").groupBy("window").agg(F.count("*").alias("shared"))
    was = size.select((F.col("window") + 1).alias("window"), F.col("size").alias("was"))
    both = size.join(was, "window").join(shared, "window", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return both.select(
        "window",
        "shared",
        (F.col("size") - F.col("shared")).alias("replaced"),
        ((F.col("size") - F.col("shared")) / F.col("size")).alias("replacement"),
        (F.col("shared") / (F.col("size") + F.col("was") - F.col("shared"))).alias("jaccard"),
    )


def suitability(counts: DataFrame, n: int, m: int, low: float = 0.8) -> DataFrame:
    """Per window: mass, keys, keys above mass / n, keys from low of that to it, and the mean distinct keys a partition would see."""
    both = with_threshold(counts, n)
    near = (F.col("cnt") * n >= F.col("mass") * low) & (F.col("cnt") * n <= F.col("mass"))
    return both.groupBy("window").agg(
        F.first("mass").alias("mass"),
        F.count("*").alias("keys"),
        F.count_if(F.col("cnt") >= F.col("threshold")).alias("heavy"),
        F.count_if(near).alias("near"),
        (F.sum(F.least("cnt", F.lit(m))) / m).alias("local_distinct"),
    )


def partition_hardness(placed: DataFrame, n: int, m: int) -> DataFrame:
    """How a placement spreads counts (window, part, key, cnt) over m partitions, per window.

    Keys and loads of partitions (mean, p95, largest), partitions that hold a heavy
    or boundary key, the mass-weighted number of partitions of a key, and the share
    of a partition's mass beyond its local rank n, 2n, 4n.
    """
    local = placed.groupBy("window", "part", "key").agg(F.sum("cnt").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("window", "part").orderBy(F.desc("cnt"), "key"))
    ranked = local.withColumn("rank", rank)
    beyond = [F.sum(F.when(F.col("rank") > q * n, F.col("cnt")).otherwise(0)).alias(f"beyond{q}") for q in (1, 2, 4)]
    at_rank = F.coalesce(F.max(F.when(F.col("rank") == n, F.col("cnt"))), F.lit(0)).alias("rank_n")
    parts = ranked.groupBy("window", "part").agg(F.count("*").alias("keys"), F.sum("cnt").alias("load"), at_rank, *beyond)
    of_parts = parts.groupBy("window").agg(
        (F.sum("keys") / m).alias("keys_mean"),
        linear_quantile("keys", 0.95).alias("keys_p95"),
        F.max("keys").alias("keys_max"),
        (F.sum("load") / m).alias("load_mean"),
        linear_quantile("load", 0.95).alias("load_p95"),
        (F.max("load") * m / F.sum("load")).alias("load_max_over_mean"),
        F.avg("rank_n").alias("rank_n_mean"),
        *[(F.sum(f"beyond{q}") / F.sum("load")).alias(f"tail_mass_{q}n") for q in (1, 2, 4)],
    )
    keys = local.groupBy("window", "key").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("support"))
    heavy = F.col("cnt") * n >= F.col("mass")
    boundary = (F.col("cnt") * n >= F.col("mass") * 0.8) & (F.col("cnt") * n < F.col("mass"))
    of_keys = with_threshold(keys, n).groupBy("window").agg(
        F.count_if(heavy).alias("heavy"),
        F.avg(F.when(heavy, F.col("support"))).alias("heavy_support"),
        F.avg(F.when(boundary, F.col("support"))).alias("boundary_support"),
        (F.sum(F.col("cnt") * F.col("support")) / F.sum("cnt")).alias("mass_support"),
    )
    return of_parts.join(of_keys, "window")
