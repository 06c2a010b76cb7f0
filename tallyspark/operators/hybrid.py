"""An exact head by a shared dictionary, and a Space-Saving tail for the rest."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.held import held
from .sketches import space_saving


@dataclass(frozen=True)
class Head:
    """A generation of the dictionary: ids in order, each one's place its slot."""

    ids: tuple[str, ...] = ()
    generation: int = 0

    @staticmethod
    def install(ids: list[str], capacity: int, generation: int) -> Head:
        """The first `capacity` distinct ids as given, sorted."""
        return Head(tuple(sorted([*dict.fromkeys(ids)][:capacity])), generation)

    def delta(self, base: int, to: int, removed_slots: list[int], added: list[str], capacity: int) -> Head | None:
        """The next generation, or None where the delta doesn't fit: another base, slots that aren't there, ids that are."""
        removed = {self.ids[s] for s in removed_slots if 0 <= s < len(self.ids)}
        kept = [x for x in self.ids if x not in removed]
        fits = base == self.generation and len(removed) == len(removed_slots) and len(set(added)) == len(added) and not set(added) & set(self.ids)
        ids = sorted([*kept, *added])
        return Head(tuple(ids), to) if fits and len(ids) <= capacity else None

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, x) for i, x in enumerate(self.ids)], "slot int, key string")


def tail_floor(q: int, n: int, head_share: float) -> int:
    """The least tail capacity: q, or enough for the mass outside the head."""
    return max(q, math.ceil(n * (1 - head_share)), 1)


def split(events: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact counts of head keys (window, part, slot, key, cnt), and the other events.

    head is (slot, key): one dictionary, bounded by its capacity and broadcast; or
    (window, slot, key) where windows differ, as many as there are windows, and
    joined as Spark sees fit.
    """
    on = ["window", "key"] if "window" in head.columns else ["key"]
    known = head if "window" in head.columns else F.broadcast(head)
    exact = events.filter("weight > 0").join(known, on).groupBy("window", "part", "slot", "key").agg(F.sum("weight").alias("cnt"))
    return exact, events.join(known.select(*on), on, "left_anti")


def hybrid_report(events: DataFrame, head: DataFrame, q_tail: int, generation: int = 0, per_item: bool = True) -> tuple[DataFrame, DataFrame]:
    """(parts, reports) of partitions with an exact head and a tail of q_tail counters."""
    exact, rest = split(events, head)
    tail = held(space_saving(rest, q_tail, per_item))
    part = F.col("part").cast("int").alias("part")
    mass = events.filter("weight > 0").groupBy("window", part).agg(F.sum("weight").alias("n_local"))
    in_head = exact.groupBy("window", part).agg(F.sum("cnt").alias("head_mass"))
    parts = mass.join(in_head, ["window", "part"], "left").select("window", "part", "n_local", F.lit(q_tail).cast("long").alias("q_local"), F.coalesce("head_mass", F.lit(0)).alias("head_mass"), F.lit(generation).cast("long").alias("head_gen"))
    top = exact.select("window", part, F.lit("head").alias("kind"), F.col("key").alias("id"), F.col("cnt").alias("est"), F.lit(0).cast("long").alias("eps"))
    low = tail.select("window", "part", F.lit("ss").alias("kind"), F.col("key").alias("id"), "est", "eps")
    return parts, top.unionByName(low)


def least_head_share(parts: DataFrame) -> DataFrame:
    """(window, share): the least share of a partition's mass in the head; 0 where a partition is empty."""
    share = F.when(F.col("n_local") > 0, F.col("head_mass") / F.col("n_local")).otherwise(F.lit(0.0))
    return parts.groupBy("window").agg(F.min(share).alias("share"))


def select_head(items: DataFrame, policy: str, n: int) -> DataFrame:
    """(window, id) for the next head, from a window's certified items.

    topn and top2n: the largest estimates. frontier: all that may reach the
    threshold. topn-frontier: both. confirmed: those that surely do. threshold:
    the frontier without the top n.
    """
    order = Window.partitionBy("window").orderBy(F.desc("est"), "id")
    ranked = items.withColumn("_r", F.row_number().over(order))
    top, frontier = F.col("_r") <= n, F.col("cert_ub") >= F.col("threshold")
    rules = {"topn": top, "top2n": F.col("_r") <= 2 * n, "frontier": frontier, "topn-frontier": top | frontier, "confirmed": F.col("cert_lb") >= F.col("threshold"), "threshold": frontier & ~top}
    return ranked.filter(rules[policy]).select("window", "id").distinct()


#: Modelled bytes of a head update: its frame, an id, a slot.
FRAME, ID, SLOT = 40, 16, 4


@dataclass(frozen=True)
class Update:
    """What takes a dictionary to the next generation, and whether it goes as a delta: (removed slots, added ids) or the full head."""

    head: Head
    removed: tuple[int, ...]
    added: tuple[str, ...]
    full_bytes: int
    delta_bytes: int
    is_delta: bool

    @property
    def bytes(self) -> int:
        return self.delta_bytes if self.is_delta else self.full_bytes


def update(head: Head, ids: list[str], capacity: int, eta: float = 0.8, checkpoint: int = 32) -> Update:
    """The update to the first `capacity` of ids. A delta goes when its bytes are at most eta of the full head's, but not from generation 0 nor to each checkpoint."""
    wanted = Head.install(ids, capacity, head.generation + 1)
    new, old = set(wanted.ids), set(head.ids)
    removed = tuple(i for i, x in enumerate(head.ids) if x not in new)
    added = tuple(x for x in wanted.ids if x not in old)
    full, delta = FRAME + ID * len(wanted.ids), FRAME + SLOT * len(removed) + ID * len(added)
    goes = head.generation > 0 and wanted.generation % checkpoint > 0 and delta <= eta * full
    if goes:
        applied = head.delta(head.generation, wanted.generation, list(removed), list(added), capacity)
        if applied != wanted:
            raise RuntimeError("a head delta does not give the head it was made from")
        wanted = applied
    return Update(wanted, removed, added, full, delta, goes)


def head_changes(heads: DataFrame, eta: float = 0.8, checkpoint: int = 32, partitions: int = 1) -> DataFrame:
    """What changes between consecutive heads (window, id): kept, removed, added, bytes of a full head and of a delta, and whether the delta goes.

    The window's place among the windows is its head's generation, from 1. Bytes
    and rule are those of update; they are for all partitions together.
    """
    order = Window.orderBy("window")  # of windows, not of rows
    numbered = heads.select("window").distinct().withColumn("generation", F.row_number().over(order))
    rows = heads.select("window", "id").distinct().join(numbered, "window")
    now = rows.select("generation", "id", F.lit(1).alias("new"))
    before = rows.select((F.col("generation") + 1).alias("generation"), "id", F.lit(1).alias("old"))
    one = now.join(before, ["generation", "id"], "full_outer").groupBy("generation").agg(
        F.count_if(F.col("new").isNotNull() & F.col("old").isNotNull()).alias("kept"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old").isNull()).alias("added")
    )
    full = (F.lit(FRAME) + (F.col("kept") + F.col("added")) * ID) * partitions
    delta = (F.lit(FRAME) + F.col("removed") * SLOT + F.col("added") * ID) * partitions
    out = numbered.join(one, "generation").withColumn("full_bytes", full).withColumn("delta_bytes", delta)
    goes = (F.col("generation") > 1) & (F.pmod(F.col("generation"), F.lit(checkpoint)) > 0) & (F.col("delta_bytes") <= F.col("full_bytes") * eta)
    return out.select("window", "kept", "removed", "added", "full_bytes", "delta_bytes", goes.alias("selected"))
