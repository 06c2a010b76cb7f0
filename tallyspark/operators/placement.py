"""Placing the keys of global windows onto partitions.

Every policy keeps each key's count. Those that treat each key by itself are
column expressions, or maps over batches of keys; those whose keys compete for
room in partitions see one window's keys at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.allocation import banded_gaussian, capped, diluted, largest_remainder

PLACED = "window long, part int, key string, cnt long"


def _start(key: Column, salt: str, m: int) -> Column:
    """A partition by the key's hash, the same in any engine that has MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(m))


def round_robin(counts: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """count // m everywhere, and one more on the partitions from a hashed start: no Python, no shuffle."""
    start = _start(F.col("key"), str(seed), m)
    rows = counts.filter("cnt > 0").select("window", "key", "cnt", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"))
    share = F.floor((F.col("cnt") - F.pmod("cnt", F.lit(m))) / m).cast("long") + (F.col("i") < F.pmod("cnt", F.lit(m))).cast("long")
    return rows.select("window", F.pmod(F.col("start") + F.col("i"), F.lit(m)).cast("int").alias("part"), "key", share.alias("cnt")).filter("cnt > 0")


def network_prefix(key: str) -> str:
    """The /16 of an IPv4 address, the /48 of an IPv6 one, else the key."""
    import ipaddress

    try:
        ip = ipaddress.ip_address(key)
    except ValueError:
        return key
    return str(ipaddress.ip_network(f"{ip}/{16 if ip.version == 4 else 48}", strict=False))


def prefix_locality(counts: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """All of a key on the partition of its network prefix."""

    @F.pandas_udf("string")
    def prefix(keys: pd.Series) -> pd.Series:
        return keys.map(network_prefix)

    at = _start(prefix("key"), str(seed), m)
    return counts.filter("cnt > 0").select("window", at.cast("int").alias("part"), "key", "cnt")


def certificate_stress(counts: DataFrame, m: int, n: int, low: float = 0.8, high: float = 1.2, reporters: int = 3, seed: int = 0) -> DataFrame:
    """Keys near mass / n on few partitions, all others round robin."""
    mass = F.sum("cnt").over(Window.partitionBy("window"))
    near = (F.col("cnt") * n >= F.col("mass") * low) & (F.col("cnt") * n <= F.col("mass") * high)
    marked = counts.filter("cnt > 0").withColumn("mass", mass).withColumn("near", near)
    few = round_robin(marked.filter("near").select("window", "key", "cnt"), max(1, min(reporters, m)), seed)
    shift = _start(F.col("key"), f"{seed}|few", m)
    moved = few.withColumn("part", F.pmod(F.col("part") + shift, F.lit(m)).cast("int"))
    return moved.unionByName(round_robin(marked.filter(~F.col("near")).select("window", "key", "cnt"), m, seed))


def rng_of(*tags: object) -> np.random.Generator:
    """A generator that depends on its tags only, on any machine."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b("|".join(map(str, tags)).encode(), digest_size=8).digest(), "big"))


def _per_key(counts: DataFrame, m: int, weigh: Callable[[str, int], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for window, key, cnt in zip(batch["window"], batch["key"], batch["cnt"]):
                share = largest_remainder(int(cnt), weigh(key, int(cnt)))
                out += [(window, p, key, int(share[p])) for p in np.flatnonzero(share).tolist()]
            yield pd.DataFrame(out, columns=["window", "part", "key", "cnt"])

    return counts.filter("cnt > 0").select("window", "key", "cnt").mapInPandas(run, PLACED)


def synthetic_mixture(counts: DataFrame, m: int, seed: int = 0, uniform: float = 0.4, normal: float = 0.3) -> DataFrame:
    """By the key's hash: even, around a centre, or skewed."""

    def weigh(key: str, cnt: int) -> np.ndarray:
        rng = rng_of(seed, "mixture", key)
        kind = rng.random()
        if kind < uniform:
            return np.ones(m)
        if kind < uniform + normal:
            return banded_gaussian(m, rng.uniform(0, m), max(1.0, m / 10))
        return rng.permutation(1 / np.arange(1, m + 1) ** 1.5)

    return _per_key(counts, m, weigh)


@dataclass(frozen=True)
class Locality:
    """Shares of global, regional and local keys, how many partitions are home to them, and how much of a key stays home."""

    # fixed values: the policy's published defaults
    shares: tuple[float, float, float] = (0.15, 0.35, 0.35)
    homes: tuple[float, float, float] = (1.0, 0.20, 0.04)
    strength: tuple[float, float, float] = (0.10, 0.75, 0.90)
    even: float = 0.0
    jitter: float = 0.05

    def weights(self, key: str, m: int, seed: int) -> np.ndarray:
        rng = rng_of(seed, "locality", key)
        total = max(1.0, sum(self.shares))
        kind = int(np.searchsorted(np.cumsum(self.shares) / total, rng.random(), side="right"))
        strength, homes = (self.strength[kind], self.homes[kind]) if kind < 3 else (0.0, 1.0)
        k = max(1, min(m, round(homes * m)))
        base = np.full(m, (1 - strength) / m)
        base[rng.choice(m, k, replace=False)] += strength / k
        return diluted(base * rng.uniform(1 - self.jitter, 1 + self.jitter, m), self.even)


def persistent_locality(counts: DataFrame, m: int, seed: int = 0, locality: Locality | None = None) -> DataFrame:
    """A key keeps its class and homes in all windows."""
    rule = locality or Locality()
    return _per_key(counts, m, lambda key, cnt: rule.weights(key, m, seed))


def imbalance(counts: DataFrame, m: int, seed: int = 0, spread: float = 0.1, dilution: float = 0.2) -> DataFrame:
    """The rarer a key, the narrower the band of partitions that holds it; an even share dilutes the bands."""

    def weigh(key: str, cnt: int) -> np.ndarray:
        rng = rng_of(seed, "imbalance", key)
        rarity = 1 / (1 + math.log1p(cnt))
        return diluted(banded_gaussian(m, rng.beta(2, 5) * m, max(0.5, spread * m * (1 - rarity))), dilution)

    return _per_key(counts, m, weigh)


# Policies whose heavy and boundary keys compete for room. All other keys are placed first, by DataFrame operations;
# of them a window's task sees only what they make of each partition.


@dataclass
class Board:
    """A window's partitions: their load so far, the count that the q-th of the lighter keys has there, and the window's mass."""

    load: np.ndarray
    floor: np.ndarray
    mass: int
    n: int
    seed: int

    @property
    def m(self) -> int:
        return len(self.load)

    def even_targets(self) -> np.ndarray:
        """Final masses of the partitions, adding up to the window's: one level, over which only what already lies higher stands out."""
        low, high = 0, self.mass // self.m
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if np.maximum(self.load, mid).sum() <= self.mass else (low, mid - 1)
        targets = np.maximum(self.load, low)
        targets[np.flatnonzero(self.load <= low)[: self.mass - int(targets.sum())]] += 1
        return targets


def hide(supply: np.ndarray, caps: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shares (key, partition) of the most mass that fits with at most caps[p] of a key and room[p] of all keys in partition p.

    A partition takes from the keys that have most left, down to a common level, so
    that what is left stays as even as can be. That gives the maximum flow: over k
    it is the least of what all but the k largest keys have plus
    min(room[p], k * caps[p]) over the partitions.
    """
    left, out = supply.astype(np.int64).copy(), np.zeros((len(supply), len(caps)), np.int64)
    for p in range(len(caps)):
        cap, most = int(max(0, caps[p])), int(max(0, room[p]))
        taken = lambda level: np.clip(left - level, 0, cap)
        low, high = 0, int(left.max(initial=0))
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if taken(mid).sum() <= most else (mid + 1, high)
        share = taken(low)
        if low > 0:  # one more of some keys down to the next level
            more = np.flatnonzero(taken(low - 1) > share)[: most - int(share.sum())]
            share[more] += 1
        out[:, p] = share
        left -= share
    return out


def fill(supply: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shares of keys laid end to end along the partitions' room: each partition is filled to the end, as far as the keys go."""
    a, b = np.concatenate([[0], np.cumsum(supply)]), np.concatenate([[0], np.cumsum(np.maximum(0, room))])
    return np.maximum(0, np.minimum(a[1:, None], b[None, 1:]) - np.maximum(a[:-1, None], b[None, :-1])).astype(np.int64)


def spread(supply: np.ndarray, m: int) -> np.ndarray:
    """Even shares; the ones over go on from where the key before ended."""
    start = np.concatenate([[0], np.cumsum(supply % m)[:-1]]) if len(supply) else supply
    return supply[:, None] // m + ((np.arange(m)[None, :] - start[:, None]) % m < (supply % m)[:, None])


def at_homes(keys: list[str], supply: np.ndarray, room: np.ndarray, homes: np.ndarray, seed: int) -> np.ndarray:
    """Shares of keys in homes[i] partitions each, the same in all windows, within the room; the rest of a key is left."""
    out, room = np.zeros((len(keys), len(room)), np.int64), np.maximum(0, room).copy()
    for i, key in enumerate(keys):
        rng = rng_of(seed, "home", key)
        mine = rng.choice(len(room), int(min(len(room), max(1, homes[i]))), replace=False)
        weights = np.zeros(len(room))
        weights[mine] = rng.uniform(0.8, 1.2, len(mine))
        out[i], _ = capped(int(supply[i]), weights, np.where(weights > 0, room, 0))
        room -= out[i]
    return out


def to_few(supply: np.ndarray, load: np.ndarray, most: float) -> np.ndarray:
    """Shares that fill up as few partitions as can be, the least loaded first, none beyond `most`; what is then left spreads evenly."""
    order = np.argsort(load, kind="stable")
    out = np.zeros((len(supply), len(load)), np.int64)
    out[:, order] = fill(supply, np.floor(most - load[order]).astype(np.int64))
    return out + spread(supply - out.sum(axis=1), len(load))


def _local_threshold(load: np.ndarray, n: int, scale: float) -> np.ndarray:
    """The most that a key may have in a partition without being reported there."""
    return np.maximum(0, np.ceil(scale * load / n).astype(np.int64) - 1)


LOAD_BOUND = 4.0  # no partition gets more than so many times the mean


def _exact_fill(shares: np.ndarray, supply: np.ndarray, board: Board, targets: np.ndarray) -> np.ndarray:
    """What is left of the keys goes where partitions lack their target."""
    return shares + fill(supply - shares.sum(axis=1), targets - board.load - shares.sum(axis=0))


def _persistent_ambiguity(b: Board, keys: list[str], supply: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Boundary keys mostly in a few lasting homes; heavy keys under 0.85 of the local threshold in three quarters of the partitions."""
    mean, out = b.mass / b.m, np.zeros((len(keys), b.m), np.int64)
    near = ~heavy
    out[near] = at_homes([k for k, x in zip(keys, near) if x], np.round(supply[near] * 0.9).astype(np.int64), np.floor(LOAD_BOUND * mean - b.load).astype(np.int64), np.full(int(near.sum()), round(0.05 * b.m)), b.seed)
    out[near] += spread(supply[near] - out[near].sum(axis=1), b.m)
    load = b.load + out.sum(axis=0)
    caps = _local_threshold(load, b.n, 0.85)
    caps[rng_of(b.seed, "quarter").permutation(b.m)[: b.m // 4]] = 0
    out[heavy] = hide(supply[heavy], caps, np.full(b.m, b.mass))
    out[heavy] += spread(supply[heavy] - out[heavy].sum(axis=1), b.m)
    return out


def _hidden(b: Board, keys: list[str], supply: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The most of the heavy keys' mass under the local thresholds of partitions of fixed sizes; then distractors, and what is left fills the sizes."""
    targets, out = b.even_targets(), np.zeros((len(keys), b.m), np.int64)
    out[heavy] = hide(supply[heavy], _local_threshold(targets, b.n, 1.0), targets - b.load)
    room = targets - b.load - out.sum(axis=0)
    near = ~heavy
    out[near] = at_homes([k for k, x in zip(keys, near) if x], supply[near], room, np.full(int(near.sum()), round(0.1 * b.m)), b.seed)
    return _exact_fill(out, supply, b, targets)


def _constrained_certificate(b: Board, keys: list[str], supply: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Exact partition sizes: boundary keys whole in a fiftieth of the partitions as far as these hold them, heavy keys thin under 0.9 of the threshold."""
    targets, out = b.even_targets(), np.zeros((len(keys), b.m), np.int64)
    near = ~heavy
    out[near] = at_homes([k for k, x in zip(keys, near) if x], supply[near], (targets - b.load) // 2, np.full(int(near.sum()), round(0.02 * b.m)), b.seed)
    out[heavy] = hide(supply[heavy], _local_threshold(targets, b.n, 0.9), targets - b.load - out.sum(axis=0))
    return _exact_fill(out, supply, b, targets)


def _reported_mass_suppression(b: Board, keys: list[str], supply: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Boundary keys in so few partitions that each reports them; heavy keys under the threshold, their overflow with few reporters."""
    mean, out = b.mass / b.m, np.zeros((len(keys), b.m), np.int64)
    near = ~heavy
    homes = np.maximum(1, np.floor(supply[near] * b.n / (1.25 * LOAD_BOUND * mean))).astype(np.int64)  # enough in each, however loaded it gets
    out[near] = at_homes([k for k, x in zip(keys, near) if x], supply[near], np.floor(2 * mean - b.load).astype(np.int64), homes, b.seed)
    out[near] += spread(supply[near] - out[near].sum(axis=1), b.m)
    load = b.load + out.sum(axis=0)
    out[heavy] = hide(supply[heavy], _local_threshold(load, b.n, 0.95), np.floor(LOAD_BOUND * mean - load).astype(np.int64))
    out[heavy] += to_few(supply[heavy] - out[heavy].sum(axis=1), load + out[heavy].sum(axis=0), LOAD_BOUND * mean)
    return out


def _visibility(least: bool, scale: float):
    def place(b: Board, keys: list[str], supply: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """Heavy keys, the marginal ones first, out of sight of the threshold and (least) or (else) of the local ranking; the rest of them with few reporters."""
        mean, out = b.mass / b.m, np.zeros((len(keys), b.m), np.int64)
        threshold, rank = _local_threshold(b.load, b.n, scale), np.maximum(0, b.floor - 1)
        caps = np.minimum(threshold, rank) if least else np.maximum(threshold, rank)
        load = b.load.copy()
        for i in np.argsort(supply, kind="stable"):
            out[[i]] = hide(supply[[i]], caps, np.floor(LOAD_BOUND * mean - load).astype(np.int64))
            load += out[i]
        return out + to_few(supply - out.sum(axis=1), load, LOAD_BOUND * mean)

    return place


@dataclass(frozen=True)
class Adversary:
    """How a window's heavy keys, and boundary keys from `near` times mass / n up, are placed on what the other keys leave."""

    place: Callable[[Board, list[str], np.ndarray, np.ndarray], np.ndarray]
    near: float = 1.0
    background: str = "even"
    q_over_n: float = 1.0


#: Named policies over competing keys.
ADVERSARIES: dict[str, Adversary] = {
    "persistent_ambiguity_adversary": Adversary(_persistent_ambiguity, 0.65, "locality"),
    "hh_hidden_optimal": Adversary(_hidden, 0.8),
    "hh_hidden_exact": Adversary(_hidden),
    "constrained_certificate_adversary": Adversary(_constrained_certificate, 0.5),
    "reported_mass_suppression_adversary": Adversary(_reported_mass_suppression, 0.5),
    "dual_visibility_adversary": Adversary(_visibility(True, 0.7)),
    "filter_aware_visibility_adversary": Adversary(_visibility(False, 0.7)),
}
ALIASES = {
    "persistent_affinity": "persistent_locality", "locality": "persistent_locality",
    "persistent_ambiguity": "persistent_ambiguity_adversary", "ambiguity_adversary": "persistent_ambiguity_adversary",
    "src_prefix_locality": "source_prefix_locality", "prefix_locality": "source_prefix_locality",
    "flow_hidden": "hh_hidden_optimal", "mass_hidden": "hh_hidden_optimal", "flow_hidden_exact": "hh_hidden_exact",
    "cert_ambiguity": "certificate_stress", "ambiguity_stress": "certificate_stress",
    "certificate_adversary": "constrained_certificate_adversary", "cert_adversary": "constrained_certificate_adversary",
    "filter_visibility_adversary": "filter_aware_visibility_adversary", "fva": "filter_aware_visibility_adversary",
}


def adversarial(counts: DataFrame, m: int, n: int, adversary: Adversary, seed: int = 0) -> DataFrame:
    """Light keys by DataFrame operations; then a window's heavy and boundary keys, n / near at most, in one task that sees m partitions.

    A window without heavy keys, or without others, is placed evenly.
    """
    live = counts.filter("cnt > 0").select("window", "key", "cnt")
    mass = live.groupBy("window").agg(F.sum("cnt").alias("mass"))
    heavy, near = F.col("cnt") * n > F.col("mass"), F.col("cnt") * n >= F.col("mass") * adversary.near
    kinds = live.join(mass, "window").withColumn("heavy", heavy).withColumn("rival", heavy | near & F.lit(adversary.near < 1))
    rest = kinds.filter("not rival").select("window", "key", "cnt")
    background = persistent_locality(rest, m, seed) if adversary.background == "locality" else round_robin(rest, m, seed)
    q = max(1, round(adversary.q_over_n * n))
    order = Window.partitionBy("window", "part").orderBy(F.desc("cnt"), "key")
    floors = background.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= q).groupBy("window", "part").agg(F.max(F.when(F.col("rank") == q, F.col("cnt"))).alias("floor"))
    boards = background.groupBy("window", "part").agg(F.sum("cnt").alias("load")).join(floors, ["window", "part"], "left")
    boards = boards.select(F.col("window").alias("of"), "part", "load", "floor")

    def run(rivals: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(rivals):
            return pd.DataFrame(columns=["window", "part", "key", "cnt"])
        rivals = rivals.sort_values(["cnt", "key"], ascending=[False, True])
        keys, supply, is_heavy = rivals["key"].tolist(), rivals["cnt"].to_numpy(np.int64), rivals["heavy"].to_numpy(bool)
        load, floor = np.zeros(m, np.int64), np.zeros(m, np.int64)
        load[parts["part"]], floor[parts["part"]] = parts["load"], parts["floor"].fillna(0)
        board = Board(load, floor, int(rivals["mass"].iloc[0]), n, seed)
        alone = not is_heavy.any() or not len(parts) and is_heavy.all()
        shares = spread(supply, m) if alone else adversary.place(board, keys, supply, is_heavy)
        i, p = np.nonzero(shares)
        return pd.DataFrame({"window": int(rivals["window"].iloc[0]), "part": p.astype(np.int32), "key": [keys[k] for k in i.tolist()], "cnt": shares[i, p]})

    rivals = kinds.filter("rival").select("window", "key", "cnt", "heavy", "mass")
    placed = rivals.groupBy("window").cogroup(boards.groupBy("of")).applyInPandas(run, PLACED)
    return background.unionByName(placed)


def place(counts: DataFrame, m: int, policy: str, n: int = 100, seed: int = 0, **options) -> DataFrame:
    """(window, part, key, cnt) by a named policy."""
    if m <= 0:
        raise ValueError("m must be positive")
    name = ALIASES.get(policy, policy)
    simple = {"round_robin": round_robin, "source_prefix_locality": prefix_locality, "synthetic_mixture": synthetic_mixture, "persistent_locality": persistent_locality, "imbalance": imbalance}
    if name in simple:
        return simple[name](counts, m, seed, **options)
    if name == "certificate_stress":
        return certificate_stress(counts, m, n, seed=seed, **options)
    if name in ADVERSARIES:
        from dataclasses import replace

        return adversarial(counts, m, n, replace(ADVERSARIES[name], **options), seed)
    raise ValueError(f"unknown policy {policy}")


def scheduled(counts: DataFrame, m: int, schedule: list[tuple[int, str]], n: int = 100, seed: int = 0) -> DataFrame:
    """Policies by blocks of windows: (windows, policy) in order, which must cover all windows."""
    last = counts.agg(F.max("window")).first()[0]
    if last is not None and sum(k for k, _ in schedule) <= last:
        raise ValueError("the schedule doesn't cover all windows")
    out, start = None, 0
    for k, policy in schedule:
        part = place(counts.filter((F.col("window") >= start) & (F.col("window") < start + k)), m, policy, n, seed)
        out, start = part if out is None else out.unionByName(part), start + k
    return out
