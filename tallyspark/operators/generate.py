"""Synthetic global count windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.allocation import largest_remainder
from ..functions.held import scratch


def _keys():
    return F.concat(F.lit("key_"), F.col("i").cast("string"))


def _topped_up(rows: DataFrame, total: int) -> DataFrame:
    """Floors of a shape, with the residue dealt one each from the first key on."""
    residue = F.lit(total) - F.sum("low").over(Window.partitionBy())
    keys = F.count("*").over(Window.partitionBy())
    more = F.floor(residue / keys) + (F.col("i") <= F.pmod(residue, keys)).cast("long")
    return rows.select(_keys().alias("key"), (F.col("low") + more).cast("long").alias("cnt"))


def uniform(spark: SparkSession, total: int, keys: int) -> DataFrame:
    """(key, cnt): total // keys each, one more for the first keys."""
    rows = spark.range(1, keys + 1).withColumnRenamed("id", "i")
    return rows.select(_keys().alias("key"), (F.lit(total // keys) + (F.col("i") <= total % keys).cast("long")).alias("cnt"))


def zipf(spark: SparkSession, total: int, keys: int, s: float = 1.2, least: int = 0) -> DataFrame:
    """(key, cnt) by 1 / rank ** s."""
    if least * keys > total:
        raise ValueError("least takes more than the total")
    rows = spark.range(1, keys + 1).withColumnRenamed("id", "i").withColumn("w", F.pow(F.col("i").cast("double"), F.lit(-s)))
    low = F.floor(F.col("w") / F.sum("w").over(Window.partitionBy()) * (total - least * keys)).cast("long") + least
    return _topped_up(rows.withColumn("low", low), total)


def normal(spark: SparkSession, total: int, keys: int, n: int, center: float = 0.05, spread: float = 0.031, heavy: bool = True, least: int = 0, steps: int = 30) -> DataFrame:
    """(key, cnt) by a bell over ranks, made narrower until the top key is heavy, or by gifts from the least keys."""
    shaped, at = total - least * keys, np.arange(keys)
    need, width = total // n + 1, max(1e-6, spread * keys)
    for _ in range(steps + 1 if heavy else 1):
        shape = np.exp(-0.5 * ((at - center * keys) / width) ** 2)
        counts = np.floor(shape / shape.sum() * shaped).astype(np.int64) + least
        if counts.max() >= need:
            break
        width = max(1e-6, width * 0.85)
    counts += np.bincount(np.arange(total - counts.sum()) % keys, minlength=keys)
    if heavy and counts.max() < need:
        for top in np.argsort(-counts, kind="stable")[: min(3, keys)]:
            for donor in np.argsort(counts, kind="stable"):
                give = min(int(counts[donor]) - least, need - int(counts[top]))
                if give > 0 and donor != top:
                    counts[donor] -= give
                    counts[top] += give
    return _frame(spark, counts)


def _frame(spark: SparkSession, counts: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(f"key_{i + 1}", int(c)) for i, c in enumerate(counts) if c > 0], "key string, cnt long")


def heavy_and_background(spark: SparkSession, total: int, keys: int, n: int = 200, heavy: int = 20, ratios: tuple[float, float] = (1.05, 2.0)) -> DataFrame:
    """(key, cnt): heavy keys at ratios of the threshold, scaled down if they take more than all; the rest even and below it."""
    threshold = total // n + 1
    top = np.maximum(threshold, np.floor(np.linspace(ratios[1], ratios[0], heavy) * threshold)).astype(np.int64)
    if top.sum() > total:
        top = largest_remainder(total, top)
    rest = largest_remainder(total - int(top.sum()), np.ones(max(1, keys - heavy)))
    over = np.maximum(0, rest - (threshold - 1))
    counts = np.concatenate([top, rest - over])
    counts[: max(1, heavy)] += largest_remainder(int(over.sum()), np.ones(max(1, heavy)))
    return _frame(spark, counts)


def flattened(spark: SparkSession, total: int, n: int = 10, heavy: int = 5, flatness: float = 0.5, seed: int = 0) -> DataFrame:
    """(key, cnt): heavy keys on a line down to the threshold, and a line below it that uses up the rest; keys are dealt by seed."""
    heavy, least = min(heavy, n - 1), total // n + 1
    most = max(least, int(least + flatness * (2 * (total - 1) / heavy - 2 * least)))
    top = np.floor(np.linspace(most, least, heavy)).astype(np.int64)
    rest = total - int(top.sum())
    k = max(1, math.ceil(2 * rest / max(1, least))) if rest > 0 else 0
    line = largest_remainder(rest, np.linspace(least - 1, 1, k)) if k else np.zeros(0, np.int64)
    counts = np.concatenate([top, line[line > 0]])
    return _frame(spark, np.random.default_rng(seed).permutation(counts))


@dataclass(frozen=True)
class Cohort:
    """Keys at a level of mass / n that drift around ratios of it."""

    n: int
    keys: int
    ratios: tuple[float, float]
    above: bool
    amplitude: float = 0.025


@dataclass(frozen=True)
class Boundary:
    """Persistent cohorts around one or several thresholds, over an even background: what a window holds depends on its number alone."""

    total: int
    keys: int
    cohorts: tuple[Cohort, ...]
    period: int = 48
    noise: float = 0.008
    seed: int = 0

    def window(self, w: int) -> np.ndarray:
        rng, counts = np.random.default_rng(self.seed), []
        for c in self.cohorts:
            line = self.total / c.n
            base = rng.permutation(np.linspace(c.ratios[1], c.ratios[0], c.keys))
            phase = rng.random(c.keys)
            jitter = np.random.default_rng([self.seed, w, c.n, c.keys, c.above]).uniform(-self.noise, self.noise, c.keys)
            ratio = base * (1 + c.amplitude * np.sin(2 * np.pi * (w / self.period + phase)) + jitter)
            level = np.maximum(np.floor(line) + 1, np.round(line * ratio)) if c.above else np.minimum(np.floor(line) - 1, np.round(line * ratio))
            counts.append(np.maximum(0, level).astype(np.int64))
        top = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if top.sum() > self.total:
            raise ValueError("the cohorts take more than the total")
        return np.concatenate([top, largest_remainder(self.total - int(top.sum()), np.ones(max(1, self.keys - len(top))))])

    def frame(self, spark: SparkSession, windows: int) -> DataFrame:
        """(window, key, cnt): each window is made where it is needed."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for w in batch["id"].tolist():
                    c = self.window(w)
                    at = np.flatnonzero(c)
                    yield pd.DataFrame({"window": w, "key": [f"key_{i + 1}" for i in at.tolist()], "cnt": c[at]})

        return spark.range(windows).mapInPandas(run, "window long, key string, cnt long")


def head_halo(total: int, keys: int, ns: tuple[int, ...] = (100, 200, 400), heavy: tuple[int, ...] = (3, 6, 12), near: tuple[int, ...] = (4, 8, 16), seed: int = 0) -> Boundary:
    """Cohorts above and below the thresholds of several n at once."""
    cohorts = [Cohort(n, k, (1.03, 1.12), True) for n, k in zip(ns, heavy)] + [Cohort(n, k, (0.85, 0.97), False) for n, k in zip(ns, near)]
    return Boundary(total, keys, tuple(cohorts), seed=seed)


def profile(kind: str, name: str, n: int) -> dict:
    """Parameters of a named skew of a distribution. The published presets."""
    zipfian = {"low_skew": {"s": 1.05}, "medium_skew": {"s": 1.2}, "high_skew": {"s": 1.5}}
    bell = {"narrow": {"spread": 0.02}, "medium": {"spread": 0.031}, "wide": {"spread": 0.06}}
    flat = {"low_skew": {"heavy": max(1, n // 20), "flatness": 0.2}, "medium_skew": {"heavy": max(1, n // 10), "flatness": 0.5}, "high_skew": {"heavy": max(1, n // 5), "flatness": 0.8}}
    return {"zipf": zipfian, "normal": bell, "flattened": flat}.get(kind, {}).get(name, {})


def distribution(spark: SparkSession, kind: str, total: int, keys: int, n: int = 100, name: str | None = None, **params) -> DataFrame:
    """(key, cnt) of a kind of distribution, with a preset's parameters under those given."""
    chosen = (profile(kind, name, n) if name else {}) | params
    if kind == "uniform":
        return uniform(spark, total, keys)
    if kind == "zipf":
        return zipf(spark, total, keys, **chosen)
    if kind == "normal":
        return normal(spark, total, keys, chosen.pop("n", n), **chosen)
    if kind == "flattened":
        return flattened(spark, total, chosen.pop("n", n), **chosen)
    if kind == "heavy_and_background":
        return heavy_and_background(spark, total, keys, chosen.pop("n", n), **chosen)
    raise ValueError(f"unknown distribution {kind}")


# Evolution over windows


def blend(a: DataFrame, b: DataFrame, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, key, cnt) of (1 - share) a + share b, rounded down; zeros go."""
    x, y = a.withColumnRenamed("cnt", "x"), b.withColumnRenamed("cnt", "y")
    mixed = F.floor((1 - share) * F.coalesce("x", F.lit(0)) + share * F.coalesce("y", F.lit(0))).cast("long")
    return x.join(y, [*by, "key"], "full_outer").select(*by, "key", mixed.alias("cnt")).filter("cnt > 0")


@dataclass(frozen=True)
class Step:
    counts: DataFrame
    duration: int
    transition: int = 0


def scenario(steps: list[Step]) -> DataFrame:
    """(window, key, cnt): each step for its duration, after a linear transition from the step before."""
    out, w, before = None, 0, None
    for s in steps:
        frames = [blend(before, s.counts, t / (s.transition + 1)) for t in range(1, s.transition + 1)] if before is not None else []
        for f in [*frames, *[s.counts] * s.duration]:
            one = f.select(F.lit(w).cast("long").alias("window"), "key", "cnt")
            out, w = one if out is None else out.unionByName(one), w + 1
        before = s.counts
    return out


def match_ranks(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """after with its keys renamed to those of equal rank before, in each group of `by`: the assignment of least total change. New ranks keep new names.

    A group's keys are ranked in one task; without groups, that is one window's keys.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cnt"), "key"))
    a = before.select(*by, F.col("key").alias("old"), rank.alias("r"))
    b = after.select(*by, "key", "cnt", rank.alias("r"))
    return b.join(a, [*by, "r"], "left").select(*by, F.coalesce("old", F.concat(F.lit("new_"), F.col("key"))).alias("key"), "cnt")


@dataclass(frozen=True)
class Evolution:
    """How keys change from window to window, while each window's counts are given.

    Keys keep their rank, but: `birth` of the keys are new, in place of cold ones
    that were at most `dying` of the threshold; `drift` of the heavy ones were not
    heavy before; new keys stay under `newborn` of the threshold, except
    `newborn_hot` of them; no key that stays changes by more than `most_change` of
    its count; and `churn` of the top `top` were not there before.
    """

    n: int = 100
    birth: float = 0.0
    dying: float = 0.8
    drift: float | None = None
    newborn: float = 0.9
    newborn_hot: float = 0.0
    most_change: float = 1.0
    churn: float | None = None
    top: int | None = None
    seed: int = 0

    def step(self, keys: np.ndarray, before: np.ndarray, now: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of window w from those of the window before and the counts of its own. No loop over all keys."""
        order = np.lexsort((keys, -before))
        keys, before, counts = keys[order], before[order], np.sort(now)[::-1].astype(np.int64)
        was = int(before.sum()) // self.n + 1
        hot = counts >= int(counts.sum()) // self.n + 1
        slot = np.arange(len(counts))
        owner = np.where(slot < len(keys), slot, -1)  # place of the slot's key before; -1: a new key
        old = np.append(before, 0)  # by place; that of a new key is 0
        cold = np.flatnonzero((owner >= 0) & ~hot & (old[owner] <= was * self.dying))
        owner[cold[::-1][: round(self.birth * len(counts))]] = -1
        if self.drift is not None:
            self._drift(owner, hot, old >= was)
        counts = self._newborn(owner, counts, w)
        counts = self._limited(owner, counts, old)
        names = np.array([f"new_{w}_{i}" for i in range(int((owner < 0).sum()))], object)
        out = np.empty(len(counts), object)
        out[owner >= 0], out[owner < 0] = keys[owner[owner >= 0]], names
        if self.churn is not None:
            self._churned(out, owner, counts)
        return out[counts > 0], counts[counts > 0]

    def _drift(self, owner: np.ndarray, hot: np.ndarray, was_hot: np.ndarray) -> None:
        """Keys of heavy and other slots swapped until drift of the heavy keys were not heavy before."""
        mine = owner >= 0
        fresh = hot & mine & ~was_hot[owner]
        wanted = min(round(self.drift * hot.sum()), int((hot & mine).sum()))
        more = wanted - int(fresh.sum())
        leave = np.flatnonzero(hot & mine & was_hot[owner]) if more > 0 else np.flatnonzero(fresh)
        enter = np.flatnonzero(~hot & mine & (~was_hot[owner] if more > 0 else was_hot[owner]))
        k = min(abs(more), len(leave), len(enter))
        a, b = leave[:k], enter[:k]
        owner[a], owner[b] = owner[b], owner[a].copy()

    def _newborn(self, owner: np.ndarray, counts: np.ndarray, w: int) -> np.ndarray:
        """New keys under their cap; what they lose goes to the others, the largest first."""
        born = np.flatnonzero(owner < 0)
        line = int(counts.sum()) // self.n + 1
        rng = np.random.default_rng([self.seed, w])
        hot = rng.permutation(born[counts[born] >= line])[: int(self.newborn_hot * len(born))]
        cap = np.full(len(counts), max(1, int(line * self.newborn)))
        cap[hot] = max(line + 1, line * 5 // 4)
        out = counts.copy()
        out[born] = np.minimum(out[born], cap[born])
        rest = np.flatnonzero(owner >= 0) if (owner >= 0).any() else born
        out[rest] += largest_remainder(int(counts.sum() - out.sum()), np.ones(len(rest)))[::-1]
        return out

    def _limited(self, owner: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
        """A shift common to all, between each key's bounds, that keeps the mass as far as these let it. New keys may only lose."""
        if self.most_change >= 1 or not len(counts):
            return counts
        stays, was = owner >= 0, old[owner]
        low = np.where(stays, np.floor(was * (1 - self.most_change)), 0).astype(np.int64)
        high = np.where(stays, np.ceil(was * (1 + self.most_change)), counts).astype(np.int64)
        total = min(max(int(counts.sum()), int(low.sum())), int(high.sum()))
        a, b = -int(counts.max()) - 1, int(high.max()) + 1
        while a < b:  # the largest whole shift that doesn't give more than the total
            mid = (a + b + 1) // 2
            a, b = (mid, b) if int(np.clip(counts + mid, low, high).sum()) <= total else (a, mid - 1)
        out = np.clip(counts + a, low, high)
        out[np.flatnonzero(np.clip(counts + a + 1, low, high) > out)[: total - int(out.sum())]] += 1
        return out

    def _churned(self, keys: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> None:
        """Counts swapped across rank `top` until churn of the top is new; the counts as a whole stay."""
        order = np.lexsort((keys, -counts))
        size = min(self.top or self.n, len(counts))
        was = (owner >= 0) & (owner < size)  # places before are ranks before
        head, tail = order[:size], order[size:]
        more = round(self.churn * size) - int((~was[head]).sum())
        leave = head[::-1][was[head[::-1]]] if more > 0 else head[::-1][~was[head[::-1]]]
        enter = tail[~was[tail]] if more > 0 else tail[was[tail]]
        k = min(abs(more), len(leave), len(enter))
        a, b = leave[:k], enter[:k]
        counts[a], counts[b] = counts[b], counts[a].copy()


def _evolved(rule: Evolution, w: int):
    def run(before: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        keys, made = rule.step(before["key"].to_numpy(object), before["cnt"].to_numpy(np.int64), now["cnt"].to_numpy(np.int64), w)
        return pd.DataFrame({"key": keys, "cnt": made})

    return run


def evolve(counts: DataFrame, rule: Evolution) -> DataFrame:
    """(window, key, cnt): the first window as it is, each other one's counts on keys that come from the window before.

    Windows follow each other, so each is a job; a window's keys are in one task,
    in arrays, and never on the driver.
    """
    spark = counts.sparkSession
    path = scratch(spark, "evolved")
    labels = sorted(r[0] for r in counts.filter("cnt > 0").select("window").distinct().collect())
    for w, label in enumerate(labels):
        now = counts.filter((F.col("window") == label) & (F.col("cnt") > 0)).select("key", "cnt")
        if w:
            before = spark.read.parquet(f"{path}/window={labels[w - 1]}")
            now = before.groupBy(F.lit(0).alias("one")).cogroup(now.select("cnt").groupBy(F.lit(0).alias("one"))).applyInPandas(_evolved(rule, w), "key string, cnt long")
        now.write.parquet(f"{path}/window={label}")
    if not labels:
        return counts.select("window", "key", "cnt")
    return spark.read.schema("key string, cnt long, window long").parquet(path).select("window", "key", "cnt")


def gut_hot_keys(counts: DataFrame, n: int, share: float, seed: int = 0) -> DataFrame:
    """A violent drift of (window, key, cnt): a share of each window's heavy keys give all but one of their count to a new key each."""
    mass = counts.groupBy("window").agg(F.sum("cnt").alias("mass"))
    heavy = counts.join(mass, "window").filter(F.col("cnt") * n > F.col("mass")).select("window", "key")
    order = Window.partitionBy("window").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("key")).cast("binary")))
    picked = heavy.withColumn("i", F.row_number().over(order)).withColumn("k", F.count("*").over(Window.partitionBy("window")))
    picked = picked.filter(F.col("i") <= F.round(F.col("k") * share)).select("window", "key", "i")
    both = counts.join(picked, ["window", "key"], "left")
    left = both.select("window", "key", F.when(F.col("i").isNotNull(), F.lit(1)).otherwise(F.col("cnt")).cast("long").alias("cnt"))
    minted = both.filter("i is not null").select("window", F.concat(F.lit("minted_"), F.col("i").cast("string")).alias("key"), (F.col("cnt") - 1).alias("cnt"))
    return left.unionByName(minted).filter("cnt > 0")
