"""Sources, writers, windows, placement, generation and streaming on small inputs."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import exact, generate, placement, windows
from tallyspark.sources import packets, streams
from tallyspark.streaming import pipeline


def gz(path, body):
    with gzip.open(path, "wt") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_folder_of_windows(spark, tmp_path):
    gz(tmp_path / "window_000002.json.gz", {"1": [["late", 2]], "0": ["early"]})
    gz(tmp_path / "window_000010.json.gz", {"0": ["ten"]})
    gz(tmp_path / "window_000011.json.gz", {"5": {"0": ["nested"]}})
    got = rows(streams.read_folder(spark, str(tmp_path)), "window", "part", "key", "weight")
    assert got == [(2, 0, "early", 1), (2, 1, "late", 2), (10, 0, "ten", 1), (11, 0, "nested", 1)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("")
    with pytest.raises(FileNotFoundError):
        streams.read_folder(spark, str(tmp_path / "none"))


def test_file_of_windows(spark, tmp_path):
    gz(tmp_path / "s.json.gz", {"0": {"0": ["a", ["b", 3], 7, ["c"], ["d", "x"]], "1": [["a", 2], '["a",2]']}, "1": {"0": ["d"]}, "2": 5, "w": {"p": {"k": 4}}})
    got = rows(streams.read_nested(spark, str(tmp_path / "s.json.gz")), "window", "part", "pos", "key", "weight")
    assert got == [(0, 0, 0, "a", 1), (0, 0, 1, "b", 3), (0, 1, 0, "a", 2), (0, 1, 1, '["a",2]', 1), (1, 0, 0, "d", 1), (2, 2, 0, "k", 4)]


def test_count_traces(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"window": 0, "counts": {"a": 3, "b": 0}}\n\n{"counts": {"a": 1}}\n')
    assert rows(streams.read_counts_jsonl(spark, str(tmp_path / "c.jsonl")), "window", "key", "cnt") == [(0, "a", 3), (1, "a", 1)]
    (tmp_path / "t.csv").write_text("window,src_ip,packet_count\n0,a,2\n0,a,3\n1,b,1\n")
    assert rows(streams.read_counts_csv(spark, str(tmp_path / "t.csv")), "window", "key", "cnt") == [(0, "a", 5), (1, "b", 1)]
    (tmp_path / "bad.csv").write_text("window,ip\n0,a\n")
    with pytest.raises(ValueError):
        streams.read_counts_csv(spark, str(tmp_path / "bad.csv"))


def test_round_trips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "LINE", 2)  # windows of many lines
    monkeypatch.setattr(streams, "BLOCK", 2)
    monkeypatch.setattr(streams, "KEYS", 1)
    counts = spark.createDataFrame([(0, 0, 'q"uote', 2), (0, 0, "z", 5), (0, 1, "a", 1), (1, 0, "b", 3), (1, 2, "\u00e9\\", 4)], "window long, part int, key string, cnt long")
    columns = ("window", "part", "key", "cnt")
    streams.write_compact(counts, str(tmp_path / "compact"))
    with gzip.open(tmp_path / "compact" / "window_000000.json.gz", "rt") as f:
        assert json.load(f) == {"0": [['q"uote', 2], ["z", 5]], "1": [["a", 1]]}
    back = streams.read_trace(spark, str(tmp_path / "compact")).withColumnRenamed("weight", "cnt")
    want = [(0, 0, 'q"uote', 2), (0, 0, "z", 5), (0, 1, "a", 1), (1, 0, "b", 3), (1, 1, "\u00e9\\", 4)]  # partitions are numbered anew
    assert {(w, k, c) for w, _, k, c in rows(back, *columns)} == {(w, k, c) for w, _, k, c in want}
    streams.write_counts_jsonl(counts.select("window", "key", "cnt"), str(tmp_path / "jsonl"))
    assert rows(streams.read_counts_jsonl(spark, str(tmp_path / "jsonl")), "window", "key", "cnt") == rows(counts, "window", "key", "cnt")
    streams.write_expanded(counts, str(tmp_path / "events"), seed=2, form="parquet")
    assert rows(exact.local_counts(spark.read.parquet(str(tmp_path / "events"))), *columns) == rows(counts, *columns)
    for write, name in ((streams.write_expanded, "files"), (streams.write_stream, "one")):
        write(counts, str(tmp_path / name), seed=2)
        events = streams.read_trace(spark, str(tmp_path / name)) if name == "files" else streams.read_nested(spark, str(tmp_path / name))
        assert streams.emitted(events) == 15 and {r[0] for r in rows(events, "weight")} == {1}
        assert rows(exact.global_counts(events), "window", "key", "cnt") == rows(counts.select("window", "key", "cnt"), "window", "key", "cnt")
    order = [r.key for r in streams.read_window(spark, str(tmp_path / "files"), 0).filter("part = 0").orderBy("pos").collect()]
    assert sorted(order) == ['q"uote'] * 2 + ["z"] * 5 and order == [r.key for r in streams.expand(counts, 2).filter("window = 0 and part = 0").orderBy("pos").collect()]


def test_one_window_of_a_trace(spark, tmp_path):
    gz(tmp_path / "s.json.gz", {"0": {"0": ["a"]}, "7": {"0": ["b", ["c", 2]], "4": ["d"]}})
    assert rows(streams.read_window(spark, str(tmp_path / "s.json.gz"), 7), "window", "part", "key", "weight") == [(7, 0, "b", 1), (7, 0, "c", 2), (7, 4, "d", 1)]
    (tmp_path / "f").mkdir()
    gz(tmp_path / "f" / "window_000012.json.gz", {"0": ["x"]})
    gz(tmp_path / "f" / "window_000002.json.gz", {"0": ["y"]})
    assert rows(streams.read_window(spark, str(tmp_path / "f"), 2), "window", "key") == [(2, "y")]
    with pytest.raises(FileNotFoundError):
        streams.read_window(spark, str(tmp_path / "f"), 1)


def test_lines_without_windows_are_numbered(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for k in range(3):
        (tmp_path / "c" / f"{k}.jsonl").write_text("".join(f'{{"counts": {{"k{4 * k + i}": 1}}}}\n\n' for i in range(4)))
    got = rows(streams.read_counts_jsonl(spark, str(tmp_path / "c")), "window", "key")
    assert [w for w, _ in got] == [*range(12)] and all(int(k[1:]) % 4 == w % 4 for w, k in got)


def test_pickles(spark, tmp_path):
    import pickle
    from collections import Counter

    with gzip.open(tmp_path / "t.pkl.gz", "wb") as f:
        pickle.dump({0: Counter(a=2, b=0), 3: {"c": 1, 5: 2}}, f)
    got = streams.read_pickle_counts(spark, str(tmp_path / "t.pkl.gz"))
    assert rows(got, "window", "key", "cnt") == [(0, "a", 2), (3, "5", 2), (3, "c", 1)]
    streams.write_pickle_counts(got, str(tmp_path / "out"))
    assert rows(streams.read_pickle_counts(spark, str(tmp_path / "out")), "window", "key", "cnt") == rows(got, "window", "key", "cnt")
    with open(tmp_path / "bad.pkl", "wb") as f:
        pickle.dump({0: print}, f)
    with pytest.raises(Exception, match="not allowed"):
        streams.read_pickle_counts(spark, str(tmp_path / "bad.pkl")).collect()


def capture(order, link, found, fraction=0xA1B2C3D4):
    import struct

    out = struct.pack(order + "IHHiIII", fraction, 2, 4, 0, 0, 65535, link)
    for seconds, part, body in found:
        out += struct.pack(order + "IIII", seconds, part, len(body), len(body)) + body
    return out


def test_packet_captures(spark, tmp_path):
    four = bytes([0x45] + [0] * 11 + [10, 0, 0, 1] + [0] * 4)
    six = bytes([0x60] + [0] * 7 + [0x20, 0x01, 0x0D, 0xB8] + [0] * 11 + [1] + [0] * 16)
    ether = lambda kind, body: bytes(12) + kind.to_bytes(2, "big") + body
    vlan = bytes(12) + b"\x81\x00\x00\x05\x08\x00" + four
    (tmp_path / "x.dirA.pcap").write_bytes(capture("<", 1, [(100, 5, ether(0x0800, four)), (100, 6, ether(0x0806, b"arp")), (101, 0, ether(0x86DD, six)), (165, 1, vlan)]))
    with gzip.open(tmp_path / "y.dirB.pcap.gz", "wb") as f:
        f.write(capture(">", 101, [(130, 999_999_999, four), (131, 0, b""), (132, 0, six)], 0xA1B23C4D)[:-3])  # cut off
    found = packets.read_packets(spark, str(tmp_path))
    assert rows(found, "pos", "micros", "src") == [(0, 100_000_005, "10.0.0.1"), (0, 130_999_999, "10.0.0.1"), (2, 101_000_000, "2001:db8::1"), (3, 165_000_001, "10.0.0.1")]
    assert rows(packets.packet_counts(found, 60, 100), "window", "key", "cnt") == [(0, "10.0.0.1", 2), (0, "2001:db8::1", 1), (1, "10.0.0.1", 1)]
    assert packets.find_captures(spark, str(tmp_path), "B")[0].endswith("y.dirB.pcap.gz") and len(packets.find_captures(spark, str(tmp_path), "A")) == 1
    told = packets.write_packet_counts(found, str(tmp_path / "out"))
    assert (told["total_packets"], told["dataset_start_time"], len(told["files"])) == (4, 100, 2)
    assert rows(streams.read_counts_jsonl(spark, str(tmp_path / "out" / "counts")), "window", "key", "cnt") == [(0, "10.0.0.1", 2), (0, "2001:db8::1", 1), (1, "10.0.0.1", 1)]
    with pytest.raises(FileNotFoundError):
        packets.read_packets(spark, str(tmp_path / "none"))


def test_metrics_and_report(spark, tmp_path):
    run = spark.createDataFrame([(0, 'a"b', 1 / 3, 2), (1, 'a"b', None, 4), (2, "c", float("nan"), 6)], "window long, method string, f1 double, q int")
    streams.write_metrics(run, str(tmp_path / "m"))
    lines = sorted(x for f in (tmp_path / "m").glob("*.csv") for x in f.read_text().split("\n")[1:] if x)
    assert lines == ['0,"a""b",0.3333333333,2', '1,"a""b",,4', "2,c,,6"]
    text = streams.report(run.filter("window < 2"))
    assert '[a"b] window 0: f1=0.333333 q=2' in text and '== a"b: 2 windows' in text


def test_hashtag_blocks(spark, tmp_path):
    (tmp_path / "x.n3").write_text('@prefix a: <b> .\n<post1> created "2020-01-01T00:00:00Z"^^<d> .\n<post1> mentions _:b1 .\n_:b1 hasTag> "news" .\n\n<post2> created "2020-01-02T00:00:00Z"^^<d> .\n<post2> mentions _:b2 .\n')
    assert rows(streams.read_hashtag_blocks(spark, str(tmp_path / "x.n3")), "created", "tag") == [("2020-01-01T00:00:00Z", "news")]


def test_tag_windows(spark, tmp_path):
    tags = spark.createDataFrame([("2020-01-01T05:00:00Z", "a"), ("2020-01-01T06:00:00Z", "a"), ("2020-01-03T00:00:00Z", "b")], "created string, tag string")
    streams.write_tag_windows(tags, str(tmp_path / "w"))
    lines = sorted((x for f in (tmp_path / "w" / "counts").glob("*.json") for x in map(json.loads, f.read_text().splitlines())), key=lambda x: x["window"])
    assert lines == [{"window": 0, "counts": {"a": 2}}, {"window": 1, "counts": {}}, {"window": 2, "counts": {"b": 1}}]
    told = [json.loads(f.read_text()) for f in (tmp_path / "w" / "metadata.json").glob("*.json")][0]
    assert (told["events"], told["tags"], told["window_hours"]) == (3, 2, 24.0)


def test_policies_by_schedule(spark, adversary_input):
    placed = placement.scheduled(adversary_input, 4, [(1, "round_robin"), (1, "source_prefix_locality")], n=N, seed=1)
    assert windows.preserved(adversary_input, placed).count() == 0
    spread = {r.window: r.most for r in placed.groupBy("window", "key").agg(F.count("*").alias("parts")).groupBy("window").agg(F.max("parts").alias("most")).collect()}
    assert spread == {0: 4, 1: 1}


def test_windows_refuse_gaps_and_bad_counts(spark):
    counts = spark.createDataFrame([(0, "a", 1), (2, "a", 1)], "window long, key string, cnt long")
    with pytest.raises(ValueError):
        windows.slice_windows(counts, 0, 3)
    one = windows.validate_counts(counts).first()
    assert (one.missing_windows, one.valid) == (1, False)
    with pytest.raises(ValueError):
        windows.concat_traces({"a": counts.withColumn("cnt", F.lit(0))})


M, N = 16, 80


@pytest.fixture(scope="module")
def adversary_input(spark):
    """Two windows: four heavy keys, of which "edge" just so, twelve boundary keys, and a long tail."""
    light = [(f"near{i}", 3900 - 55 * i) for i in range(12)] + [(f"tail{i}", 1900 - 5 * i) for i in range(260)]
    keys = [("top", 21000), ("next", 11500), ("third", 7300), ("edge", 5400), *light]
    return spark.createDataFrame([(w, k, c + (i % 3) * w) for w in (0, 1) for i, (k, c) in enumerate(keys)], "window long, key string, cnt long").persist()


def board_of(counts, placed):
    """Of window 0: its mass, counts by key, {part: {key: cnt}}, and loads."""
    total = {r.key: r.cnt for r in counts.filter("window = 0").collect()}
    local = {p: {} for p in range(M)}
    for r in placed.filter("window = 0").collect():
        local[r.part][r.key] = local[r.part].get(r.key, 0) + r.cnt
    return sum(total.values()), total, local, [sum(x.values()) for x in local.values()]


@pytest.mark.parametrize("policy", ["round_robin", "synthetic_mixture", "locality", "imbalance", "cert_ambiguity", *placement.ADVERSARIES])
def test_placement_keeps_counts(spark, adversary_input, policy):
    placed = placement.place(adversary_input, M, policy, n=N, seed=17).persist()
    assert windows.preserved(adversary_input, placed).count() == 0
    assert placed.filter("cnt <= 0 or part < 0 or part >= 16").count() == 0
    assert placed.groupBy("window", "part", "key").count().filter("count > 1").count() == 0
    again = placement.place(adversary_input.repartition(3), M, policy, n=N, seed=17)
    assert rows(placed, "window", "part", "key", "cnt") == rows(again, "window", "part", "key", "cnt")


def test_exact_policies_hold_partition_sizes(adversary_input):
    for policy in ("hh_hidden_optimal", "hh_hidden_exact", "constrained_certificate_adversary"):
        mass, _, _, loads = board_of(adversary_input, placement.place(adversary_input, M, policy, n=N, seed=17))
        assert sum(loads) == mass and max(loads) - min(loads) <= 1, policy


def most_hidden(supply, caps, room):
    """The least cut between keys and partitions."""
    left = sorted(supply, reverse=True)
    return min(sum(left[k:]) + sum(min(r, k * c) for r, c in zip(room, caps)) for k in range(len(left) + 1))


def max_flow(supply, caps, room):
    """Maximum flow by paths that add to it, one unit at a time."""
    k, m = len(supply), len(caps)
    cap = {("s", i): supply[i] for i in range(k)} | {(i, k + p): caps[p] for i in range(k) for p in range(m)} | {(k + p, "t"): room[p] for p in range(m)}
    flow = 0
    while True:
        came, queue = {"s": None}, ["s"]
        for x in queue:
            for (a, b), c in list(cap.items()):
                if a == x and c > 0 and b not in came:
                    came[b] = a
                    queue.append(b)
        if "t" not in came:
            return flow
        at = "t"
        while at != "s":
            cap[(came[at], at)] -= 1
            cap[(at, came[at])] = cap.get((at, came[at]), 0) + 1
            at = came[at]
        flow += 1


def test_hidden_mass_is_the_most():
    rng = np.random.default_rng(2)
    for trial in range(300):
        k, m = rng.integers(1, 5), rng.integers(1, 6)
        supply, caps, room = rng.integers(0, 12, k), rng.integers(0, 5, m), rng.integers(0, 9, m)
        share = placement.hide(supply, caps, room)
        assert (share >= 0).all() and (share <= caps).all() and (share.sum(axis=0) <= room).all() and (share.sum(axis=1) <= supply).all()
        assert share.sum() == most_hidden(supply.tolist(), caps.tolist(), room.tolist())
        if trial < 60:
            assert share.sum() == max_flow(supply.tolist(), caps.tolist(), room.tolist())


@pytest.mark.parametrize("policy, near", [("hh_hidden_optimal", 0.8), ("hh_hidden_exact", 1.0)])
def test_heavy_keys_are_hidden_best(adversary_input, policy, near):
    """Mass of heavy keys under the local thresholds of the fixed sizes: the most that the other keys' places allow."""
    mass, total, local, loads = board_of(adversary_input, placement.place(adversary_input, M, policy, n=N, seed=17))
    heavy = [k for k, c in total.items() if c * N > mass]
    caps = [math.ceil(x / N) - 1 for x in loads]
    rest = {k for k, c in total.items() if c * N <= mass and (near >= 1 or c * N < near * mass)}
    room = [x - sum(c for k, c in local[p].items() if k in rest) for p, x in enumerate(loads)]
    hidden = sum(min(local[p].get(k, 0), caps[p]) for p in range(M) for k in heavy)
    assert len(heavy) == 4 and hidden >= most_hidden([total[k] for k in heavy], caps, room)


def test_boundary_keys_stay_at_home(adversary_input):
    placed = placement.place(adversary_input, M, "persistent_ambiguity", n=N, seed=17)
    near = placed.filter("key = 'near3'").groupBy("window", "part").agg(F.sum("cnt").alias("cnt")).collect()
    homes = [max((r for r in near if r.window == w), key=lambda r: r.cnt) for w in (0, 1)]
    assert homes[0].part == homes[1].part and homes[0].cnt > 0.85 * sum(r.cnt for r in near if r.window == 0)


def test_suppression_makes_boundary_keys_reported(adversary_input):
    mass, total, local, loads = board_of(adversary_input, placement.place(adversary_input, M, "reported_mass_suppression_adversary", n=N, seed=17))
    seen = lambda k: sum(c for p, x in local.items() if (c := x.get(k, 0)) * N >= loads[p])
    assert max(loads) <= 4 * mass / M + 1 and min(loads) > 0
    near, heavy = [k for k in total if k.startswith("near")], ["top", "next", "third", "edge"]
    assert all(seen(k) > 0.9 * total[k] for k in near)
    shown = sum(seen(k) for k in heavy)
    assert shown < 0.95 * sum(total[k] for k in heavy) and seen("edge") < mass / N
    assert sum(any(local[p].get(k, 0) * N >= loads[p] for k in heavy) for p in range(M)) <= 3  # few reporters


@pytest.mark.parametrize("policy", ["dual_visibility_adversary", "filter_aware_visibility_adversary"])
def test_visibility_is_suppressed(adversary_input, policy):
    """Loads are bounded, and the marginal key's visible mass is under the global threshold, where it would be found."""
    mass, total, local, loads = board_of(adversary_input, placement.place(adversary_input, M, policy, n=N, seed=17))
    assert min(loads) > 0 and max(loads) <= 4 * mass / M + 1
    light = {k for k, c in total.items() if c * N <= mass}

    def visible(key):
        out = 0
        for p, x in local.items():
            mine, rank = x.get(key, 0), sorted((c for k, c in x.items() if k in light), reverse=True)
            over, in_top = mine >= max(1, math.ceil(0.7 * loads[p] / N)), len(rank) < N or mine >= rank[N - 1]
            out += mine if (over or in_top if policy.startswith("dual") else over and in_top) else 0
        return out

    assert visible("edge") < mass / N and visible("edge") < total["edge"]
    assert all(visible(k) < total[k] for k in ("top", "next", "third"))


def test_windows_without_rivals_are_even(spark):
    flat = spark.createDataFrame([(0, f"k{i}", 5) for i in range(200)] + [(1, "only", 90), (2, "a", 50), (2, "b", 50)], "window long, key string, cnt long")
    for policy in placement.ADVERSARIES:
        placed = placement.place(flat, 4, policy, n=50, seed=1)
        assert windows.preserved(flat, placed).count() == 0
        assert {r.part for r in placed.filter("window = 1").collect()} == {0, 1, 2, 3}


def test_placement_refuses(adversary_input):
    with pytest.raises(ValueError):
        placement.place(adversary_input, 4, "nowhere")
    with pytest.raises(ValueError):
        placement.scheduled(adversary_input, 4, [(1, "round_robin")])
    assert placement.network_prefix("10.2.3.4") == "10.2.0.0/16" and placement.network_prefix("2001:db8:1:2::1") == "2001:db8:1::/48" and placement.network_prefix("x") == "x"


def test_presets(spark):
    assert generate.profile("flattened", "low_skew", 60) == {"heavy": 3, "flatness": 0.2} and generate.profile("zipf", "none", 9) == {}
    for kind, name in (("zipf", "high_skew"), ("normal", "narrow"), ("flattened", "medium_skew"), ("uniform", None), ("heavy_and_background", None)):
        assert generate.distribution(spark, kind, 5000, 200, 20, name).agg(F.sum("cnt")).first()[0] == 5000
    top = lambda s: generate.distribution(spark, "zipf", 5000, 200, 20, s).agg(F.max("cnt")).first()[0]
    assert top("low_skew") < top("medium_skew") < top("high_skew")
    assert generate.distribution(spark, "zipf", 5000, 200, 20, "low_skew", s=1.5).agg(F.max("cnt")).first()[0] == top("high_skew")  # what is given wins
    with pytest.raises(ValueError):
        generate.distribution(spark, "other", 1, 1)


def test_generation(spark):
    for frame, total in ((generate.uniform(spark, 107, 10), 107), (generate.zipf(spark, 1000, 40, 1.1), 1000), (generate.normal(spark, 1000, 40, 10), 1000), (generate.heavy_and_background(spark, 1000, 60, 20, 5), 1000), (generate.flattened(spark, 1000), 1000)):
        assert frame.agg(F.sum("cnt")).first()[0] == total
    halo = generate.head_halo(60_000, 15_000)
    for w in (0, 9, 55):
        counts = halo.window(w)
        assert counts.sum() == 60_000 and all((counts * n > 60_000).sum() >= k for n, k in ((100, 3), (200, 6), (400, 12)))


def stepped(rule, windows_of_counts):
    """[(keys, counts)] of some windows, by steps."""
    keys = np.array([f"k{i:03}" for i in range(len(windows_of_counts[0]))], object)
    out = [(keys, np.array(windows_of_counts[0]))]
    for w, now in enumerate(windows_of_counts[1:], 1):
        out.append(rule.step(*out[-1], np.array(now), w))
    return out


def skewed(rng, size, total):
    shape = 1 / np.arange(1, size + 1) ** rng.uniform(0.8, 1.3)
    return np.maximum(1, np.floor(shape / shape.sum() * total)).astype(np.int64)


@pytest.mark.parametrize("churn", [0.0, 0.25, 0.5])
def test_churn_is_met_and_keeps_counts(churn):
    rng = np.random.default_rng(3)
    made = [skewed(rng, 120, 20_000) for _ in range(6)]
    run = stepped(generate.Evolution(n=20, churn=churn, top=20), made)
    for (k0, c0), (k1, c1), want in zip(run, run[1:], made[1:]):
        tops = [set(sorted(k, key=lambda x, k=k, c=c: (-c[list(k).index(x)], x))[:20]) for k, c in ((k0, c0), (k1, c1))]
        assert len(tops[1] - tops[0]) == round(20 * churn) and sorted(c1) == sorted(want)


def test_drift_births_and_caps():
    rng = np.random.default_rng(4)
    made = [skewed(rng, 150, 30_000) for _ in range(5)]
    rule = generate.Evolution(n=40, birth=0.1, drift=0.5, newborn=0.5)
    run = stepped(rule, made)
    for (k0, c0), (k1, c1), want in zip(run, run[1:], made[1:]):
        assert c1.sum() == want.sum() and len(set(k1)) == len(k1)
        line0, line1 = c0.sum() // 40 + 1, c1.sum() // 40 + 1
        hot = {k for k, c in zip(k1, c1) if c >= line1}
        fresh = hot - {k for k, c in zip(k0, c0) if c >= line0}
        assert abs(len(fresh) - 0.5 * len(hot)) <= 2
        born = set(k1) - set(k0)
        assert len(born) == 15 and all(c <= line1 * 0.5 + 1 for k, c in zip(k1, c1) if k in born)


def test_change_is_limited():
    rng = np.random.default_rng(5)
    made = [skewed(rng, 60, t) for t in (9000, 9000, 30_000, 5000)]
    run = stepped(generate.Evolution(most_change=0.1), made)
    for (k0, c0), (k1, c1), want in zip(run, run[1:], made[1:]):
        old = dict(zip(k0, c0))
        assert all(math.floor(old[k] * 0.9) <= c <= math.ceil(old[k] * 1.1) for k, c in zip(k1, c1))
        low, high = sum(math.floor(c * 0.9) for c in c0), sum(math.ceil(c * 1.1) for c in c0)
        assert c1.sum() == min(max(want.sum(), low), high)


def test_evolution_of_frames(spark):
    rng = np.random.default_rng(6)
    made = [skewed(rng, 50, 5000) for _ in range(3)]
    frame = spark.createDataFrame([(10 + w, f"k{i:03}", int(c)) for w, m in enumerate(made) for i, c in enumerate(m)], "window long, key string, cnt long")
    rule = generate.Evolution(n=20, birth=0.1, churn=0.2, top=10, most_change=0.5)
    got = {w: {} for w in (10, 11, 12)}
    for r in generate.evolve(frame, rule).collect():
        got[r.window][r.key] = r.cnt
    for (keys, counts), w in zip(stepped(rule, made), got):
        assert got[w] == dict(zip(keys, counts.tolist()))
    assert generate.evolve(frame.limit(0), rule).count() == 0


def test_gutted_keys_give_to_new_ones(spark):
    frame = spark.createDataFrame([(w, f"k{i}", 400 - 50 * i if i < 4 else 2) for w in (0, 1) for i in range(104)], "window long, key string, cnt long")
    got = generate.gut_hot_keys(frame, 10, 0.5, seed=1)
    assert got.agg(F.sum("cnt")).first()[0] == frame.agg(F.sum("cnt")).first()[0]
    hot = frame.filter("cnt > 160").count() // 2
    assert got.filter("key like 'minted_%'").count() == got.filter("cnt = 1").count() == 2 * round(hot * 0.5)


@pytest.mark.parametrize("a, b", [([3, 11, 6], [12, 2, 2]), ([5, 5, 1], [9, 4, 7]), ([20, 2, 13, 8], [1, 17, 17, 6])])
def test_rank_matching_is_optimal(spark, a, b):
    from itertools import permutations

    before, after = (spark.createDataFrame([(f"{n}{i}", c) for i, c in enumerate(x)], "key string, cnt long") for n, x in (("a", a), ("b", b)))
    got = {r.key: r.cnt for r in generate.match_ranks(before, after).collect()}
    assert sum(abs(c - got[f"a{i}"]) for i, c in enumerate(a)) == min(sum(abs(x - y) for x, y in zip(a, p)) for p in permutations(b))


def test_streaming_heavy_hitters(spark, tmp_path):
    data = [(f"2024-01-01 00:0{m}:00", 0, i, "hot" if i % 2 else f"k{i}", 1) for m in range(4) for i in range(20)]
    frame = spark.createDataFrame(data, "ts string, part int, pos long, key string, weight long").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    got = []
    stream = pipeline.read_events(spark, str(tmp_path / "in"))
    q = pipeline.heavy_hitter_stream(stream, "1 minute", "10 seconds", 4, lambda f, i: got.extend(f.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert {r.key for r in got} == {"hot"} and all(r.cnt == 10 for r in got) and len(got) == 2  # later windows end after the watermark


def test_streaming_summaries(spark, tmp_path):
    from tallyspark.operators.sketches import SpaceSaving

    keys = [("a", "b", "a", "c", "d", "a")[i % 6] for i in range(30)]
    for n, minute in enumerate((0, 1, 5)):
        data = [(f"2024-01-01 00:0{minute}:{i:02}", 0, i, k, 1) for i, k in enumerate(keys)]
        frame = spark.createDataFrame(data, "ts string, part int, pos long, key string, weight long").withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipeline.streaming_summaries(pipeline.read_events(spark, str(tmp_path / "in"), files_a_trigger=1), 60, "1 second", 2)
    query = stream.writeStream.format("memory").queryName("summaries").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    plain = SpaceSaving(2)
    for k in keys:
        plain.update(k)
    got = spark.table("summaries").collect()
    assert len({r.window for r in got}) == 2
    for w in {r.window for r in got}:
        assert sorted((r.key, r.est, r.eps) for r in got if r.window == w) == sorted(plain.report())


def test_summary_state_survives(spark):
    from tallyspark.operators.sketches import SpaceSaving

    a, b = SpaceSaving(3), SpaceSaving(3)
    stream = [(k, 1) for k in "abcabdeafgabcd"]
    for i, (k, w) in enumerate(stream):
        a.update(k, w)
        if i % 4 == 3:
            c = SpaceSaving(3)
            pipeline.restore(c, pipeline.save(b))
            b = c
        b.update(k, w)
    assert a.report() == b.report()
