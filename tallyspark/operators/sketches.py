"""Bounded summaries of partitions, as streaming maps over sorted partitions.

Rows are dealt by (window, part), sorted by arrival, and fed batch by batch to a
summary that keeps its bounded state between batches, so a hot partition needs
no more memory than its summary. The summaries are order sensitive: events carry
their arrival number `pos`.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_of

REPORT = "window long, part int, n_local long, q_local long, key string, est long, eps long"


class SpaceSaving:
    """q counters; a new key takes over the least counter, the one touched longest ago among equals, and inherits its count as error."""

    def __init__(self, q: int):
        self.q = max(1, q)
        self.reset()

    def reset(self) -> None:
        self.count: dict[str, int] = {}
        self.error: dict[str, int] = {}
        self.touched: dict[str, int] = {}
        self.heap: list[tuple[int, int, str]] = []  # entries may lag behind; they are renewed when they surface
        self.mass = self.clock = self.largest_error = 0

    def resize(self, q: int) -> None:
        """Another capacity clears the window; the same one doesn't."""
        if max(1, q) != self.q:
            self.q = max(1, q)
            self.reset()

    def update(self, key: str, weight: int = 1) -> None:
        self.update_all((key,), (weight,))

    def update_all(self, keys: Iterable[str], weights: Iterable[int]) -> None:
        """Updates in order. Weights that aren't positive change nothing."""
        count, error, touched, heap, q = self.count, self.error, self.touched, self.heap, self.q
        clock, mass = self.clock, self.mass
        for key, weight in zip(keys, weights):
            if weight <= 0:
                continue
            mass += weight
            clock += 1
            if key in count:
                count[key] += weight
                touched[key] = clock
                continue
            least = 0
            if len(count) >= q:
                c, t, old = heap[0]
                while count[old] != c or touched[old] != t:
                    heapq.heapreplace(heap, (count[old], touched[old], old))
                    c, t, old = heap[0]
                least = count.pop(old)
                del error[old], touched[old]
                if least > self.largest_error:
                    self.largest_error = least
                heapq.heapreplace(heap, (least + weight, clock, key))
            else:
                heapq.heappush(heap, (weight, clock, key))
            count[key], error[key], touched[key] = least + weight, least, clock
        self.clock, self.mass = clock, mass

    def report(self, per_item: bool = True) -> list[tuple[str, int, int]]:
        """(key, estimate, error), largest first, the most recently touched first among equals; one common error without per_item."""
        keys = sorted(self.count, key=lambda k: (-self.count[k], -self.touched[k]))
        return [(k, self.count[k], self.error[k] if per_item else self.largest_error) for k in keys]

    def frequent(self, phi: float) -> tuple[list[tuple[str, int]], bool]:
        """Keys of estimate ceil(phi * mass) or more, and whether all of them surely reach it."""
        if phi <= 0:
            return [], True
        least = math.ceil(min(phi, 1.0) * self.mass)
        found = [(k, c, e) for k, c, e in self.report() if c >= least]
        return [(k, c) for k, c, _ in found], all(c - e >= least for _, c, e in found)

    def top(self, k: int) -> tuple[list[tuple[str, int]], bool, bool]:
        """The first k keys, whether they surely are the top k, and whether their order is sure."""
        rows = self.report()
        first, after = rows[:k], [c for _, c, _ in rows[1 : k + 1]] + [0] * k
        limit = rows[k][1] if len(rows) > k else 0
        sure = all(c - e >= limit for _, c, e in first)
        order = all(c - e >= b for (_, c, e), b in zip(first, after))
        return [(x, c) for x, c, _ in first], sure, order


class SharedRandom:
    """The additive-feedback generator of the C library's rand(): each value is the sum of those 31 and 3 before."""

    def __init__(self, seed: int = 1):
        first = [seed or 1]
        while len(first) < 31:
            first.append(16807 * first[-1] % (2**31 - 1))
        self.last = deque(first[3:] + first[:3], maxlen=31)
        for _ in range(310):
            self.next()

    def next(self) -> int:
        value = (self.last[0] + self.last[28]) & 0xFFFFFFFF
        self.last.append(value)
        return value >> 1


@dataclass
class Cell:
    key: str | None = None
    count: int = 0
    lower: int = 0


class LockedBuckets:
    """`width` buckets of `depth` cells, largest last; a full bucket fights over its least cell unless that is locked by its count.

    Modes: 0 takes one off, 1 takes one off with probability 1 / floor(1.08 ** count),
    2 replaces and adds one with probability 1 / (count + 1), 3 adds one and replaces
    with probability 1 / count. lower counts what the present key surely had; what a
    bucket's mass has beyond these is its residual.
    """

    def __init__(self, width: int, depth: int = 6, lock: float = 0.7, theta: float = 0.01, mode: int = 2, seed: int = 1):
        self.width, self.depth, self.lock, self.theta, self.mode = max(1, width), max(1, depth), lock, theta, mode
        self.random = SharedRandom(seed)
        self.reset()

    def reset(self) -> None:
        self.cells = [[Cell() for _ in range(self.depth)] for _ in range(self.width)]
        self.bucket_mass = [0] * self.width
        self.mass = 0

    def update(self, key: str, bucket: int, weight: int = 1) -> None:
        """As `weight` updates of one, in time that doesn't grow with the weight beyond UNITS."""
        cells, left = self.cells[bucket], max(0, weight)
        while left:
            j = next((i for i in reversed(range(self.depth)) if cells[i].count and cells[i].key == key), None)
            if j is None:
                j = next((i for i in reversed(range(self.depth)) if not cells[i].count), None)
                if j is not None:
                    cells[j] = Cell(key)
            if j is not None:
                self.mass += left
                self.bucket_mass[bucket] += left
                cells[j].count += left
                cells[j].lower += left
                while j + 1 < self.depth and cells[j].count > cells[j + 1].count:
                    cells[j], cells[j + 1] = cells[j + 1], cells[j]
                    j += 1
                return
            cell = cells[0]
            spent = min(left, self._locked(cell.count))
            if spent:  # the cell stays locked for so many
                pass
            elif left <= self.UNITS:
                spent = 1
                self._fight(cell, key, self.random.next())
            else:
                spent = self._fight_many(cell, key, left)
            self.mass += spent
            self.bucket_mass[bucket] += spent
            left -= spent

    #: Updates up to here are fought one by one, as the sequence of draws says; of more, the number of lost fights is drawn.
    UNITS = 1000

    def _locked(self, count: int) -> int:
        """For how many more updates a cell of that count stays locked: it is while count >= mass * theta * lock, the mass with the update."""
        rate = self.theta * self.lock
        if rate <= 0:
            return 2**62
        n = max(0, math.ceil(count / rate) - self.mass - 1)
        while n and count < (self.mass + n) * rate:
            n -= 1
        while count >= (self.mass + n + 1) * rate:
            n += 1
        return n

    def _fight_many(self, cell: Cell, key: str, most: int) -> int:
        """Fights until one changes whose cell it is, or `most` of them; how many there were."""
        u = (self.random.next() + 1) / (2**31 + 1)
        before = cell.count
        if self.mode == 2 or self.mode == 1:
            odds = 1 / (before + 1) if self.mode == 2 else 1 / int(1.08 ** min(before, 9000))
            lost = 0 if odds >= 1 else int(min(most, math.log(u) / math.log1p(-odds)))
            if lost < most:
                self._fight(cell, key, 0)  # a draw that wins
                return lost + 1
            return most
        if self.mode == 0:
            fought = min(most, before)
            cell.count -= fought
            if cell.count <= 0:
                cell.key, cell.count, cell.lower = key, 1, 1
            return fought
        # mode 3: none of k fights is won with probability before / (before + k)
        lost = int(min(most, before / u - before))
        cell.count += lost
        if lost < most:
            self._fight(cell, key, 0)
            return lost + 1
        return most

    def _fight(self, cell: Cell, key: str, draw: int) -> None:
        before = cell.count
        if self.mode == 0 or self.mode == 1 and draw % int(1.08 ** min(before, 9000)) == 0:
            cell.count -= 1
            if cell.count <= 0:
                cell.key, cell.count, cell.lower = key, 1, 1
        elif self.mode == 2 and draw % (before + 1) == 0:
            cell.key, cell.count, cell.lower = key, before + 1, 1
        elif self.mode == 3:
            cell.count += 1
            if draw % cell.count == 0:
                cell.key, cell.lower = key, 1

    def report(self) -> tuple[list[tuple[int, str, int, int]], list[int]]:
        """(bucket, key, estimate, lower bound) of each used cell, and each bucket's residual."""
        cells = [(b, c.key, c.count, min(c.lower, c.count)) for b, row in enumerate(self.cells) for c in row if c.count]
        rest = list(self.bucket_mass)
        for b, _, _, low in cells:
            rest[b] -= low
        return cells, [max(0, x) for x in rest]


class CuckooKeeper:
    """Two tables of buckets with a lobby and two heavy entries, told apart by 16-bit fingerprints.

    A key counts in a heavy entry, else in a lobby. A lobby taken by another key
    decays; a lobby that reaches `promote` moves up, and the entry it displaces
    moves on through the other table while it is heavy. No bounds are known.
    """

    SMALL = 16  # counts up to here decay by their expectation table
    KICKS = 10

    def __init__(self, buckets: int, promote: int = 16, decay: float = 1.08, theta: float = 0.01, seed: int = 1):
        self.buckets = 1 << max(0, (max(1, buckets) - 1).bit_length())
        self.promote, self.decay, self.theta = max(1, promote), decay if decay > 1 else 1.08, theta if theta > 0 else 0.01
        self.random = random.Random(seed)
        self.cost = [0.0]  # expected weight that takes a count down to 0
        for c in range(self.SMALL):
            self.cost.append(self.cost[-1] + self.decay**c)
        self.reset()

    def reset(self) -> None:
        # entry: [fingerprint, count, last key]; of each bucket the first is the lobby
        self.tables = [[[[0, 0, None] for _ in range(3)] for _ in range(self.buckets)] for _ in range(2)]
        self.mass = 0

    def _places(self, identity: str) -> tuple[int, list[int]]:
        """Fingerprint and the bucket in each table, from a 32-digit hex identity."""
        mark = int(identity[:4], 16)
        first = int(identity[8:16], 16) & (self.buckets - 1)
        return mark, [first, self._other(mark, first)]

    def _other(self, mark: int, at: int) -> int:
        return (at ^ (0x5BD1E995 * mark & 0xFFFFFFFF)) & (self.buckets - 1)

    def update(self, key: str, identity: str, weight: int = 1) -> None:
        if weight <= 0:
            return
        self.mass += weight
        mark, places = self._places(identity)
        spots = [self.tables[t][i] for t, i in enumerate(places)]
        heavy = [e for b in spots for e in b[1:]]
        entry = next((e for e in heavy if e[1] and e[0] == mark), None)
        if entry is not None:
            entry[1] += weight
            entry[2] = key
            return
        entry = next((e for e in heavy if not e[1]), None)
        if entry is not None:
            entry[:] = mark, weight, key
            return
        t = next((t for t in (0, 1) if spots[t][0][1] and spots[t][0][0] == mark), None)
        if t is not None:
            spots[t][0][1] += weight
            spots[t][0][2] = key
        else:
            t = next((t for t in (0, 1) if not spots[t][0][1]), None)
            if t is not None:
                spots[t][0][:] = mark, weight, key
            else:
                t = mark & 1
                self._wear(spots[t][0], mark, key, weight)
        if spots[t][0][1] >= self.promote:
            self._promote(t, places[t])

    def _wear(self, lobby: list, mark: int, key: str, weight: int) -> None:
        old = lobby[1]
        left = self._decayed(old, weight)
        if left:
            lobby[1] = left
        else:
            spent = round(self.cost[old]) if old <= self.SMALL else 0
            lobby[:] = mark, max(1, weight - spent), key

    def _decayed(self, count: int, weight: int) -> int:
        if weight == 1:
            return count - (self.random.random() < self.decay**-count)
        if count > self.SMALL:
            return max(0, count - weight)
        step = self.cost[count] - self.cost[count - 1]
        if weight < step:
            return count - (self.random.random() < weight / step)
        return next(c for c in range(count + 1) if self.cost[c] + weight >= self.cost[count])

    def _promote(self, t: int, at: int) -> None:
        bucket = self.tables[t][at]
        lobby, least = bucket[0], min(bucket[1:], key=lambda e: e[1])
        if least[1] > lobby[1] and least[1] > self.promote:
            odds = max(0, lobby[1] - self.promote) / max(1, least[1] - self.promote)
            if self.random.random() >= min(1.0, odds):
                lobby[1] = min(lobby[1], self.promote)
                return
        moving, least[:] = list(least), list(lobby)
        lobby[:] = 0, 0, None
        for _ in range(self.KICKS):
            if moving[1] < 0.8 * self.theta * self.mass or not moving[1]:
                return
            t, at = 1 - t, self._other(moving[0], at)
            least = min(self.tables[t][at][1:], key=lambda e: e[1])
            displaced = list(least)
            least[:] = moving
            if not displaced[1]:
                return
            moving = displaced

    def report(self) -> list[tuple[str, int]]:
        total: dict[str, int] = {}
        for table in self.tables:
            for bucket in table:
                for _, count, key in bucket:
                    if count:
                        total[key] = total.get(key, 0) + count
        return sorted(total.items())


def _values(column: pa.Array) -> list:
    """A column's values; equal strings are one object, whose hash is known after its first use."""
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        return [None if i is None else words[i] for i in coded.indices.to_pylist()]
    return column.to_pylist()


def _over_parts(events: DataFrame, columns: list[str], start: Callable[[int, int], object], feed: Callable[[object, dict], None], finish: Callable[[int, int, object], list[tuple]], schema: str) -> DataFrame:
    """Streams each (window, part), in order of pos, through a state; finish gives its rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []
        kinds = None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            windows, parts = (np.asarray(batch.column(c)) for c in ("window", "part"))
            cols = {c: _values(batch.column(c)) for c in columns}
            ends = np.append(np.flatnonzero((windows[1:] != windows[:-1]) | (parts[1:] != parts[:-1])) + 1, len(windows)).tolist()
            i = 0
            for j in ends:
                now = (int(windows[i]), int(parts[i]))
                if now != held:
                    if held is not None:
                        out += finish(*held, state)
                    held, state = now, start(*now)
                feed(state, {c: cols[c][i:j] for c in columns})
                i = j
            if len(out) > 20_000:
                yield rows()
                out = []
        if held is not None:
            out += finish(*held, state)
        if out:
            yield rows()

    ordered = events.filter("weight > 0 and window is not null and part is not null").select("window", F.col("part").cast("int").alias("part"), "pos", *columns).repartition("window", "part").sortWithinPartitions("window", "part", "pos")
    return ordered.mapInArrow(run, schema)


def space_saving(events: DataFrame, q: int | dict[int, int], per_item: bool = True) -> DataFrame:
    """Reports of Space-Saving with q counters for each (window, part), or q by window: see REPORT; one row a counter."""

    def feed(s: SpaceSaving, cols: dict) -> None:
        s.update_all(cols["key"], cols["weight"])

    return _over_parts(events, ["key", "weight"], lambda w, p: SpaceSaving(q[w] if isinstance(q, dict) else q), feed, lambda w, p, s: [(w, p, s.mass, s.q, *r) for r in s.report(per_item)], REPORT)


def locked_buckets(events: DataFrame, width: int, depth: int = 6, lock: float = 0.7, theta: float = 0.01, mode: int = 2, seed: int = 1) -> DataFrame:
    """Cells of locked-bucket sketches: window, part, n_local, bucket, key, est, lb, residual. A used bucket without cells can't be.

    Each (window, part) draws from a generator of its own, seeded by all three.
    """
    schema = "window long, part int, n_local long, bucket int, key string, est long, lb long, residual long"

    def start(w: int, p: int) -> LockedBuckets:
        return LockedBuckets(width, depth, lock, theta, mode, 1 + (seed - 1 + 1_000_003 * w + 7919 * p) % (2**31 - 2))

    def feed(s: LockedBuckets, cols: dict) -> None:
        for key, weight, bucket in zip(cols["key"], cols["weight"], cols["bucket"]):
            s.update(key, bucket, weight)

    def finish(w: int, p: int, s: LockedBuckets) -> list[tuple]:
        cells, rest = s.report()
        return [(w, p, s.mass, b, key, est, low, rest[b]) for b, key, est, low in cells]

    return _over_parts(events.withColumn("bucket", bucket_of(F.col("key"), max(1, width))), ["key", "weight", "bucket"], start, feed, finish, schema)


def cuckoo_keeper(events: DataFrame, buckets: int, promote: int = 16, decay: float = 1.08, theta: float = 0.01, seed: int = 1) -> DataFrame:
    """Reports of cuckoo sketches: as space_saving's, with q_local 0 and no error bounds (eps null)."""

    def feed(s: CuckooKeeper, cols: dict) -> None:
        for key, weight, identity in zip(cols["key"], cols["weight"], cols["identity"]):
            s.update(key, identity, weight)

    made = events.withColumn("identity", F.md5(F.col("key").cast("binary")))
    return _over_parts(made, ["key", "weight", "identity"], lambda w, p: CuckooKeeper(buckets, promote, decay, theta, seed + 31 * w + p), feed, lambda w, p, s: [(w, p, s.mass, 0, k, c, None) for k, c in s.report()], REPORT)


def exact_report(events: DataFrame) -> DataFrame:
    """Exact local counts in the form of a report: errors 0, q_local 0."""
    counts = events.filter("weight > 0").groupBy("window", F.col("part").cast("int").alias("part"), "key").agg(F.sum("weight").alias("est"))
    mass = F.sum("est").over(Window.partitionBy("window", "part"))
    return counts.select("window", "part", mass.alias("n_local"), F.lit(0).cast("long").alias("q_local"), "key", "est", F.lit(0).cast("long").alias("eps"))


def frequent(reports: DataFrame, phi: float) -> DataFrame:
    """Per (window, part): keys of estimate ceil(phi * n_local) or more, with guaranteed for all of them together. phi <= 0: none."""
    least = F.ceil(F.lit(min(phi, 1.0)) * F.col("n_local"))
    found = reports.filter((F.lit(phi) > 0) & (F.col("est") >= least))
    sure = F.bool_and(F.col("est") - F.col("eps") >= least).over(Window.partitionBy("window", "part"))
    return found.select("window", "part", "key", "est", sure.alias("guaranteed"))


def top_reports(reports: DataFrame, k: int) -> DataFrame:
    """Per (window, part): the k largest, whether they surely are the top k, and whether their order is sure; ties by key."""
    w = Window.partitionBy("window", "part").orderBy(F.desc("est"), "key")
    ranked = reports.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("est").over(w), F.lit(0)))
    whole = Window.partitionBy("window", "part")
    limit = F.coalesce(F.max(F.when(F.col("rank") == k + 1, F.col("est"))).over(whole), F.lit(0))
    sure = ranked.withColumn("limit", limit).filter(F.col("rank") <= k)
    low = F.col("est") - F.col("eps")
    return sure.select("window", "part", "rank", "key", "est", F.bool_and(low >= F.col("limit")).over(whole).alias("guaranteed"), F.bool_and(low >= F.col("next")).over(whole).alias("ordered"))


def approximate_top(events: DataFrame, k: int, most_tracked: int = 10_000) -> DataFrame:
    """Spark's own approx_top_k per window, for comparison: estimates without bounds, so nothing can be certified."""
    top = events.filter("weight > 0").groupBy("window").agg(F.expr(f"approx_top_k(key, {k}, {most_tracked})").alias("top"))
    return top.select("window", F.explode("top").alias("t")).select("window", F.col("t.item").alias("key"), F.col("t.count").alias("est"))
