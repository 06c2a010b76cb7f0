"""Summaries and reductions on hand-checked inputs. The small traces and their results are fixed values, checked by hand."""

import random

import pytest

from tallyspark.functions.allocation import capped, largest_remainder
from tallyspark.operators import exact, hybrid, metrics, reduce, sketches


def test_space_saving_inherits_the_least_counter():
    s = sketches.SpaceSaving(3)
    for key, weight in (("a", 5), ("b", 3), ("c", 2), ("d", 1)):
        s.update(key, weight)
    assert s.mass == 11 and sum(c for _, c, _ in s.report()) == 11
    assert {k: (c, e) for k, c, e in s.report()} == {"a": (5, 0), "b": (3, 0), "d": (3, 2)}
    assert s.frequent(0.0) == ([], True)
    assert s.top(0) == ([], True, True)
    s.resize(3)
    assert s.mass == 11
    s.resize(4)
    assert s.mass == 0


def test_space_saving_is_the_unit_update_model():
    rng = random.Random(5)
    for _ in range(60):
        q, fast, slow = rng.randint(1, 6), None, {}
        fast, clock = sketches.SpaceSaving(q), 0
        for _ in range(80):
            key, weight = rng.choice("abcdefghij"), rng.randint(-1, 4)
            fast.update(key, weight)
            for _ in range(max(0, weight)):
                clock += 1
                if key not in slow and len(slow) >= q:
                    victim = min(slow, key=lambda k: (slow[k][0], slow[k][2]))
                    count = slow.pop(victim)[0]
                    slow[key] = [count, count, clock]
                entry = slow.setdefault(key, [0, 0, clock])
                entry[0] += 1
                entry[2] = clock
        assert {k: (c, e) for k, c, e in fast.report()} == {k: (v[0], v[1]) for k, v in slow.items()}


def test_library_generator():
    r = sketches.SharedRandom(1)
    assert [r.next() for _ in range(3)] == [1804289383, 846930886, 1681692777]


def test_locked_bucket_trace():
    s = sketches.LockedBuckets(1, 1, 0.7, 1.0, 2, 1)
    for key in "xyy":
        s.update(key, 0)
    assert s.report() == ([(0, "y", 2, 1)], [2])


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_locked_bucket_bounds_hold(mode):
    rng, s, truth = random.Random(mode), sketches.LockedBuckets(4, 2, 0.7, 0.2, mode), {}
    for _ in range(3000):
        k = rng.randint(0, 40)
        s.update(str(k), k % 4)
        truth[str(k)] = truth.get(str(k), 0) + 1
    cells, rest = s.report()
    assert sum(low for *_, low in cells) + sum(rest) == s.mass == 3000
    assert all(low <= truth[k] <= low + rest[b] for b, k, _, low in cells)


class UnitBuckets(sketches.LockedBuckets):
    """Each update by itself, as the rules say."""

    def update(self, key, bucket, weight=1):
        cells = self.cells[bucket]
        for _ in range(max(0, weight)):
            self.mass += 1
            self.bucket_mass[bucket] += 1
            used = [i for i in range(self.depth) if cells[i].count and cells[i].key == key] or [i for i in range(self.depth) if not cells[i].count]
            if used:
                j = used[-1]
                if not cells[j].count:
                    cells[j] = sketches.Cell(key)
                cells[j].count += 1
                cells[j].lower += 1
                if j + 1 < self.depth and cells[j].count > cells[j + 1].count:
                    cells[j], cells[j + 1] = cells[j + 1], cells[j]
            elif cells[0].count < self.mass * (self.theta * self.lock):
                self._fight(cells[0], key, self.random.next())


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_weights_are_many_updates(mode):
    rng = random.Random(mode)
    fast, slow = (kind(3, 2, 0.7, 0.1, mode) for kind in (sketches.LockedBuckets, UnitBuckets))
    for _ in range(1500):
        k, w = rng.randint(0, 30), rng.choice((0, 1, 1, 2, 7))
        fast.update(str(k), k % 3, w)
        slow.update(str(k), k % 3, w)
        assert fast.report() == slow.report()


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_huge_weights_end(mode):
    rng, s, truth = random.Random(mode), sketches.LockedBuckets(2, 2, 0.7, 0.2, mode), {}
    for _ in range(400):
        k, w = rng.randint(0, 20), rng.choice((1, 10**4, 10**9))
        s.update(str(k), k % 2, w)
        truth[str(k)] = truth.get(str(k), 0) + w
    cells, rest = s.report()
    assert sum(low for *_, low in cells) + sum(rest) == s.mass == sum(truth.values())
    assert all(low <= truth[k] <= low + rest[b] for b, k, _, low in cells)


def test_cuckoo_finds_a_dominant_key():
    rng, s = random.Random(1), sketches.CuckooKeeper(8)
    import hashlib

    for _ in range(4000):
        key = "big" if rng.random() < 0.5 else str(rng.randint(0, 500))
        s.update(key, hashlib.md5(key.encode()).hexdigest(), rng.choice((1, 1, 2, 40)))
    assert max(s.report(), key=lambda x: x[1])[0] == "big"


def test_certificate_envelope(spark):
    parts = spark.createDataFrame([(0, 0, 10, 2), (0, 1, 10, 2)], "window long, part int, n_local long, q_local long")
    rows = [(0, 0, "ss", "a", 6, 0), (0, 0, "ss", "b", 4, 0), (0, 1, "ss", "b", 4, 0), (0, 1, "ss", "c", 6, 0)]
    reports = spark.createDataFrame(rows, "window long, part int, kind string, id string, est long, eps long")
    got = {r.id: (r.est, r.cert_lb, r.cert_ub, r.reporters, r.resolution_part, r.guaranteed) for r in reduce.certify(parts, reports, 3).collect()}
    assert got == {"b": (8, 8, 8, 2, 0, True), "a": (6, 6, 10, 1, 0, False), "c": (6, 6, 10, 1, 1, False)}
    empty = reduce.certify(parts.limit(0), reports.limit(0), 3)
    assert empty.count() == 0


def test_bucket_merge(spark):
    cells = spark.createDataFrame([(0, 0, 0, "a", 5, 5), (0, 0, 0, "b", 3, 3), (0, 0, 1, "x", 4, 4), (0, 1, 0, "a", 2, 2), (0, 1, 0, "c", 6, 6), (0, 1, 1, "x", 1, 1), (0, 1, 1, "y", 7, 7)], "window long, part int, bucket int, id string, est long, lb long")
    parts = spark.createDataFrame([(0, 0, 12), (0, 1, 16)], "window long, part int, n_local long")
    items, _ = reduce.reduce_buckets(cells, 4, 2, None, parts)
    assert {(r.id, r.est, r.mass, r.threshold) for r in items.collect()} == {("a", 7, 28, 8), ("c", 6, 28, 8), ("x", 5, 28, 8), ("y", 7, 28, 8)}


@pytest.mark.parametrize("n, d, cells, residuals, unseen, complete", [(2, 1, [(0, 0, 0, "a", 8, 3), (0, 1, 0, "b", 9, 4)], [7, 6], 16, False), (4, 2, [(0, 0, 0, "a", 8, 8), (0, 1, 0, "a", 8, 8)], [2, 2], 4, True)])
def test_bucket_residuals(spark, n, d, cells, residuals, unseen, complete):
    frame = spark.createDataFrame(cells, "window long, part int, bucket int, id string, est long, lb long")
    rest = spark.createDataFrame([(0, p, 0, r) for p, r in enumerate(residuals)], "window long, part int, bucket int, residual long")
    parts = spark.createDataFrame([(0, 0, 10), (0, 1, 10)], "window long, part int, n_local long")
    items, summary = reduce.reduce_buckets(frame, n, d, rest, parts)
    one = summary.first()
    assert (one.unseen_ub, one.complete) == (unseen, complete)
    if n == 2:
        assert [(r.id, r.cert_lb, r.cert_ub) for r in items.collect()] == [("b", 4, 17)]


def test_head_dictionary(spark):
    head = hybrid.Head.install(["c", "a", "b", "a"], 3, 7)
    after = head.delta(7, 8, [1], ["d"], 3)
    assert after.ids == ("a", "c", "d") and after.generation == 8
    assert after.delta(7, 8, [1], ["e"], 3) is None and head.delta(7, 8, [9], ["d"], 4) is None and head.delta(7, 8, [], ["a"], 4) is None
    bad = spark.createDataFrame([(8, 1), (7, 0)], "head_gen long, slot int")
    for frame in (bad, bad.filter("head_gen = 7").withColumn("slot", bad.slot + 5)):
        with pytest.raises(RuntimeError):
            reduce.check_head(frame, 7, 3)
    assert hybrid.tail_floor(10, 100, 0.75) == 25


def test_head_keys_are_exact(spark):
    rows = [(0, 0, i, "h" if i < 7 else f"k{i}", 1) for i in range(12)] + [(0, 1, i, f"z{i}", 1) for i in range(5)]
    events = spark.createDataFrame(rows, "window long, part int, pos long, key string, weight long")
    parts, reports = hybrid.hybrid_report(events, hybrid.Head.install(["h"], 1, 1).frame(spark), 2, 1)
    h = reduce.certify(parts, reports, 4, prune=False).filter("id = 'h'").first()
    assert (h.est, h.cert_lb, h.cert_ub) == (7, 7, 7)


@pytest.mark.parametrize("m, aae, are, recall", [(40, 25.0, 0.3, 0.5), (None, 45.0, 0.55, 0.5)])
def test_errors_count_missing_keys(spark, m, aae, are, recall):
    truth = spark.createDataFrame([(0, "r", 100), (0, "m", 80), (0, "f", 20)], "window long, id string, cnt long")
    said = [("r", 90), ("f", 60)] + ([("m", m)] if m else [])
    method = spark.createDataFrame([(0, k, c, 50) for k, c in said], "window long, id string, est long, threshold long")
    one = metrics.evaluate(truth, method, 4).first()
    assert (one.recall, round(one.aae, 6), round(one["are"], 6)) == (recall, aae, are)


def test_allocation():
    assert largest_remainder(7, [1, 1, 1]).tolist() == [2, 2, 3]
    assert largest_remainder(0, [1, 2]).tolist() == [0, 0]
    share, left = capped(10, [1, 1, 1], [2, 3, 4])
    assert share.tolist() == [2, 3, 4] and left == 1
    share, left = capped(10, [1, 1, 1], [2, 3, 4], relax=True)
    assert share.sum() == 10 and left == 0


def test_null_and_nonpositive_weights(spark):
    rows = [(0, 0, 0, "a", 3), (0, 0, 1, "b", 0), (0, 0, 2, "c", -2), (0, 0, 3, None, 1)]
    events = spark.createDataFrame(rows, "window long, part int, pos long, key string, weight long")
    assert {r.key: r.cnt for r in exact.global_counts(events).collect()} == {"a": 3, None: 1}
