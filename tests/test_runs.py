"""Adaptive runs against a plain replay, head updates, reducers, and the methods' options."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import hybrid, reduce, sketches
from tallyspark.plans import control, methods
from tallyspark.plans.control import Capacity, Controller, Item


@pytest.fixture(scope="module")
def stream(spark):
    """Six windows of three partitions whose heavy keys change; and the rows by window and partition."""
    rng, rows, pos = random.Random(3), [], 0
    for w in range(6):
        hot = [f"hot{(w // 2 + i) % 5}" for i in range(3)]
        for i in range(900):  # heavy keys come late, so that summaries overestimate them
            key = rng.choice(hot) if rng.random() < (0.6 if i > 350 else 0.03) else f"k{int(rng.paretovariate(0.8)) % 150}"
            rows.append((w, rng.randrange(3), pos, key, 1))
            pos += 1
    by = {}
    for w, p, _, key, _ in rows:
        by.setdefault(w, {}).setdefault(p, []).append(key)
    return spark.createDataFrame(rows, "window long, part int, pos long, key string, weight long").persist(), by


def plain_certify(parts, head, q, n, per_item):
    """Items by id of one window: what certify gives, with a loop over partitions and ids."""
    mass, floors, seen, head_share = 0, {}, {}, []
    for p, keys in parts.items():
        s, exact = sketches.SpaceSaving(q), {}
        for k in keys:
            if k in head:
                exact[k] = exact.get(k, 0) + 1
            else:
                s.update(k)
        mass += len(keys)
        report = s.report(per_item)
        floors[p] = min(c for _, c, _ in report) if len(report) >= q else 0
        head_share.append(sum(exact.values()) / len(keys))
        for k, c, e in [*((k, c, None) for k, c in exact.items()), *report]:
            seen.setdefault(k, []).append((p, c, e))
    out = {}
    for k, found in seen.items():
        est = sum(c for _, c, _ in found)
        if k in head:
            out[k] = Item(est, est, est, 0, 0)
            continue
        inflation, hidden = sum(e for *_, e in found), sum(floors.values()) - sum(floors[p] for p, *_ in found)
        out[k] = Item(est, max(0, est - inflation), est + hidden, inflation, hidden)
    return out, mass, mass // n + 1, min(head_share)


def replay(by, spec, n, memory=None):
    """(q, q_next, head, margin, violation, planned checks) by window, with the controller and plain loops only."""
    m = methods.parse_methods(spec)[0]
    is_hybrid, capacity = m.name == "hybrid", Capacity(memory) if memory else None
    policy = methods.policy_of(m, n, capacity.counters() if capacity else None)
    c, head, q, out, planned = Controller(policy), hybrid.Head(), policy.clamp(n), [], None
    for w in sorted(by):
        items, mass, threshold, share = plain_certify(by[w], set(head.ids), q, n, m.get("ss-eps", "per-item") == "per-item")
        after = head
        if is_hybrid:
            ranked = sorted(items, key=lambda k: (-items[k].est, k))
            ids = [k for r, k in enumerate(ranked) if r < n or items[k].upper >= threshold]
            after = hybrid.Head.install(ids, 4 * n, head.generation + 1)
            cap = capacity.tail(len(after.ids)) if capacity else None
            floor = max(1, -int(-(n * (1 - share)) // 1))
            c.policy = control.replace(c.policy, floor=floor, cap=cap, most=cap)
        d = c.next(q, [i for k, i in items.items() if k not in head.ids and i.upper >= threshold], mass, threshold)
        following = max(c.policy.least, control.deployed(m.get("diff-mode", "predictive"), d, c.policy, q))
        out.append((w, q, following, len(head.ids), len(after.ids), round(d.margin, 9), d.violation, d.probe_issued, d.probe_failed, planned is not None and d.baseline <= planned))
        head, q, planned = after, following, following
    return out


@pytest.mark.parametrize(
    "spec, memory",
    [
        ("ss[epsilon-m=0.05]", None), ("ss[epsilon-m=0.05 ss-eps=max-sketch]", None), ("ss[epsilon-m=0.3 probe-strategy=bracket diff-mode=reactive-eff]", 1600),
        ("hybrid[epsilon-m=0.3]", None), ("hybrid[epsilon-m=0.3 diff-mode=reactive-req]", 1500),
    ],
)
def test_adaptive_runs_replay(spark, stream, spec, memory):
    events, by = stream
    rows = methods.run_adaptive(events, methods.parse_methods(spec)[0], 10, memory).orderBy("window").collect()
    got = [(r.window, r.q, r.q_next, r.head_size, r.head_next, round(r.margin, 9), r.violation, r.probe_issued, r.probe_failed, bool(r.service_ok)) for r in rows]
    want = replay(by, spec, 10, memory)
    assert got == want
    assert len({r.q for r in rows}) > 1 or memory
    assert all(0 <= r.f1 <= 1 for r in rows) and rows[0].service_ok is None


def test_options_change_runs(spark, stream):
    events, _ = stream
    run = lambda spec, **more: methods.run_adaptive(events, methods.parse_methods(spec)[0], 10, **more).orderBy("window").collect()
    fixed = run("hybrid[hyb-tail=2n]")
    assert {r.q for r in fixed} == {20} and all(r.service_ok is None for r in fixed)
    plain, full = run("hybrid[head-delta-eta=1]"), run("hybrid[head-checkpoint=1]")
    assert any(r.head_delta for r in plain) and not any(r.head_delta for r in full)
    assert sum(r.head_bytes for r in plain) < sum(r.head_bytes for r in full)
    assert [(r.q, r.head_next) for r in plain] == [(r.q, r.head_next) for r in full]  # a delta gives the head that a full update gives
    assert {r.overlap is not None for r in run("ss", topk=5)} == {True}
    for reducer in ("streaming", "parallel-streaming"):
        assert run(f"ss[reducer={reducer}]") == run("ss")


def test_widths_climb_until_complete(spark, stream):
    events, _ = stream
    rows = methods.run_adaptive(events, methods.parse_methods("hl[hl-adaptive=on]")[0], 25).orderBy("window").collect()
    ladder = control.width_ladder(25)
    assert rows[0].q == ladder[0] and any(not r.complete for r in rows)
    for r, after in zip(rows, rows[1:]):
        assert after.q == r.q_next == control.next_width(r.q, r.complete, 25)
    one = events.filter("window = 0")
    assert methods._buckets(one, methods.parse_methods("hl[hl-cert=on]")[0], 25, ladder[0], 6, True)[1].first().complete == rows[0].complete


def test_head_updates():
    head = hybrid.Head.install(["a", "b", "c"], 9, 0)
    first = hybrid.update(head, ["a", "b", "d"], 9)
    assert first.head.ids == ("a", "b", "d") and not first.is_delta and (first.removed, first.added) == ((2,), ("d",))
    assert (first.full_bytes, first.delta_bytes) == (40 + 48, 40 + 4 + 16)
    second = hybrid.update(first.head, ["a", "b", "e"], 9)
    assert second.is_delta and second.head == hybrid.Head(("a", "b", "e"), 2) and second.bytes == 60
    assert not hybrid.update(first.head, ["x", "y", "z"], 9).is_delta and not hybrid.update(first.head, ["a", "b", "e"], 9, checkpoint=2).is_delta


def test_head_changes_are_updates(spark):
    rng, heads, head, want = random.Random(4), [], hybrid.Head(), []
    for g, w in enumerate((3, 4, 8, 9, 10, 11)):  # a gap of windows is none of generations
        ids = rng.sample("abcdefgh", 6)
        heads += [(w, x) for x in ids]
        change = hybrid.update(head, ids, 9, 0.8, 4)
        want.append((w, 6 - len(change.added), len(change.removed), len(change.added), change.full_bytes, change.delta_bytes, change.is_delta))
        head = change.head
    got = hybrid.head_changes(spark.createDataFrame(heads, "window long, id string"), 0.8, 4).orderBy("window").collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("reducer", ["streaming", "parallel-streaming"])
def test_reducers_give_the_same(spark, stream, reducer):
    parts, reports = reduce.from_sketch(sketches.space_saving(stream[0], 12))
    a, b = reduce.certify(parts, reports, 20), reduce.certify(parts, reports, 20, reducer=reducer, workers=5)
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and a.count()
    with pytest.raises(ValueError):
        reduce.certify(parts, reports, 20, reducer="no")


def test_keys_resolve_or_raise(spark):
    items = spark.createDataFrame([(0, "i1", 9, 5, 1), (0, "i2", 9, 5, 0), (0, "i3", 1, 5, 0)], "window long, id string, est long, threshold long, resolution_part int")
    keys = spark.createDataFrame([(0, 1, "i1", "one"), (0, 0, "i9", "nine")], "window long, part int, id string, key string")
    known = spark.createDataFrame([("i2", "two")], "id string, key string")
    assert {r.id: r.key for r in reduce.resolve_keys(items, keys, known).collect()} == {"i1": "one", "i2": "two"}
    assert {r.id: r.key for r in reduce.resolve_keys(items, keys, strict=False).collect()} == {"i1": "one", "i2": None}
    with pytest.raises(Exception, match="no partition resolves i2"):
        reduce.resolve_keys(items, keys).collect()


def test_residuals_must_be_known(spark):
    cells = spark.createDataFrame([(0, 0, 0, "a", 3, 3), (0, 1, 2, "b", 4, 4)], "window long, part int, bucket int, id string, est long, lb long")
    rest = spark.createDataFrame([(0, 0, 0, 1)], "window long, part int, bucket int, residual long")
    parts = spark.createDataFrame([(0, 0, 4), (0, 1, 4)], "window long, part int, n_local long")
    with pytest.raises(Exception, match="no residual"):
        reduce.reduce_buckets(cells, 2, 2, rest, parts)[0].collect()


def test_plan_checks():
    p = control.Policy(n=10, floor=10, cap=50)
    d = control.Decision(60, baseline=60, wanted=70)
    c = control.verify_plan(40, d, p, (40, 65))
    assert (c.required, c.effective, c.miss_required, c.service_ok, c.control_ok, c.calibration_ok) == (60, 70, True, False, False, False)
    assert control.verify_plan(50, d, p, None).miss_required is False  # the cap allows no more


def test_benchmark_runs_all_methods(spark, stream):
    out = methods.benchmark(stream[0], "oracle,ss[policy=static q=2n],ss,hybrid,hl[hl-adaptive=on],chk", 10, memory=4096, topk=5)
    rows = out.collect()
    assert {r.method for r in rows} == {"ss-static", "ss-difficulty", "hybrid-topn-frontier", "hl", "chk"} and len(rows) == 5 * 6
    assert all(0 <= r.overlap <= 1 for r in rows)


def test_run_files(tmp_path):
    for name, body in (("generation", {"n": 10}), ("partitioning", {"n": 10, "policy": "imbalance"}), ("scenario", [{"n": 10}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "run.json").write_text(json.dumps({"generation": "generation.json", "partitioning": "partitioning.json", "scenario": "scenario.json"}))
    config = methods.load_run(str(tmp_path / "run.json"))
    assert config["partitioning"]["policy"] == "imbalance" and methods.validate_topology(config) == 10
    (tmp_path / "other.json").write_text(json.dumps({"n": 12}))
    with pytest.raises(ValueError):
        methods.load_run(str(tmp_path / "run.json"), {"generation": str(tmp_path / "other.json")})
    methods.write_manifest(config, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "run.json").read_text()) == config
