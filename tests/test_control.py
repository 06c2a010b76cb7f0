"""Controllers on hand-checked sequences."""

import pytest

from tallyspark.plans import control, methods
from tallyspark.plans.control import Controller, Item, Policy


def run(sequence, state=True, **options):
    c = Controller(Policy(n=10, floor=10, epsilon_m=0.01, alpha=0.95, **options))
    if not state:
        c.state = None
    return [c.next(q, [Item(1015, 1015 - e, 1015, e, 0), Item(1001, 1001 - e, 1001, e, 0)], 10_000, 1001).q for q, e in sequence]


CASES = {
    "hold": ([(40, 0)], {"probing": False}, [40]),
    "violation": ([(10, 100)], {"probing": False}, [100]),
    "probe": ([(40, 0)] * 2, {"strategy": "bracket", "guard": False}, [40, 20]),
    "probe fails": ([(40, 0), (40, 0), (20, 15)], {"strategy": "bracket", "guard": False}, [40, 20, 30]),
    "guarded": ([(40, 0), (40, 0), (20, 15), (30, 0), (30, 5), (30, 5), (30, 5), (26, 5), (26, 5)], {"strategy": "bracket"}, [40, 20, 30, 30, 30, 30, 26, 26, 26]),
    "comfort": ([(40, 0)] * 2, {"strategy": "comfort"}, [40, 35]),
    "pressure vetoed": ([(40, 7)] * 2, {"strategy": "pressure"}, [40, 40]),
    "pressure": ([(40, 5)] * 2, {"strategy": "pressure"}, [40, 35]),
    "pressure fails": ([(40, 0), (40, 0), (35, 15), (53, 0), (53, 0), (53, 0)], {"strategy": "pressure"}, [40, 35, 53, 53, 53, 50]),
}


@pytest.mark.parametrize("name", CASES)
def test_sequences(name):
    sequence, options, want = CASES[name]
    assert run(sequence, **options) == want


def test_margin_and_clamps():
    assert control.service_margin([Item(110, 100, 120, 10, 5), Item(110, 100, 130, 30, 20)], 1000, 101, 1.0) == 0.03
    assert Policy(n=1, floor=1, cap=4, most=5).clamp(9) == 4
    assert [control.nearest_rank([1, 2, 3, 4, 5], a) for a in (0, 0.8, 0.81, 1)] == [1, 4, 5, 5]
    assert control.nearest_rank([], 0.5) == 0.0


def test_ambiguity_frontier():
    assert control.resolve_frontier([(150, 1.0)], 100) == 150
    assert control.resolve_frontier([(400, 1.0)], 100) == 100
    p = Policy(n=10, floor=10, epsilon_m=0.01, ambiguity=True)
    demand = control.ambiguous_demand([Item(1015, 1000, 1015, 15, 0)], 10_000, 1001, 100, p)
    assert demand[0][0] == 151


def test_ladder_and_memory():
    assert control.width_ladder(100) == [8, 16, 32, 64, 128]
    assert [control.next_width(w, ok, 100) for w, ok in ((8, False), (8, True), (128, False))] == [16, 8, 128]
    c = control.Capacity(8600)
    assert (c.counters(), c.width(6), c.cuckoo_buckets(), c.tail(10)) == (268, 71, 100, 261)


def test_methods_parse():
    parsed = methods.parse_methods("oracle, ss[policy=static q=2n],ss[policy=static q=3n],hybrid[hyb-head=frontier],hl[hl-adaptive=on]")
    assert [m.label for m in parsed] == ["oracle", "ss-static", "ss-static#2", "hybrid-frontier", "hl"]
    assert parsed[4].get("hl-cert", False) and methods.multiple("2n", 50) == 100
    for bad in ("lossy", "ss[hl-w=3]", "ss[policy=maybe]", "hybrid[alpha-req=2]"):
        with pytest.raises(ValueError):
            methods.parse_methods(bad)
