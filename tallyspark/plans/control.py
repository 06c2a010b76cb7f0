"""Capacity controllers: how many counters the next window gets.

Decisions are made from one small number a window, the service margin: a quantile
over keys that may be heavy of how far their interval is open, relative to the
window's mass. Up at once when the margin is over its target; down by probes,
after enough windows in a row were fine.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Policy:
    """alpha and epsilon_m define the service; floor, cap and most bound q; the rest shapes probing and the ambiguity guard."""

    n: int
    floor: int = 1
    cap: int | None = None
    most: int | None = None
    fixed: bool = False
    alpha: float = 0.95
    epsilon_m: float = 0.15
    probing: bool = True
    guard: bool = True
    strategy: str = "comfort"
    gate: float = 0.5
    evidence: int = 2
    ambiguity: bool = False
    decay: float = 0.5

    def __post_init__(self):
        if self.strategy not in ("bracket", "comfort", "pressure"):
            raise ValueError(f"unknown probe strategy {self.strategy}")

    @property
    def target(self) -> float:
        return max(1e-12, self.epsilon_m / self.n)

    @property
    def least(self) -> int:
        return max(1, self.floor)

    def clamp(self, q: int) -> int:
        """Under the cap first, then over the floor, then under the maximum."""
        q = q if self.cap is None else min(q, self.cap)
        q = max(q, self.floor)
        return q if self.most is None else min(q, self.most)


@dataclass(frozen=True)
class Item:
    """What a controller needs of a certified key."""

    est: int
    lower: int
    upper: int
    inflation: int
    hidden: int


@dataclass
class State:
    """What is remembered between windows."""

    low: int = 0  # below it a probe has failed
    enough: int = 0  # least capacity seen to suffice, 0: none
    calm: int = 0  # sufficient windows in a row
    on_probe: bool = False
    guarded: int = 0  # demand that a failed probe exposed, while its recovery is confirmed
    confirmed: int = 0
    depth: int = 0  # deepest release that a pressure probe may take, 0: any
    ambiguity: float = 0.0  # log capacity kept for ambiguous keys


@dataclass(frozen=True)
class Decision:
    q: int
    margin: float = 0.0
    violation: bool = False
    q_up: int = 0
    baseline: int = 0
    probe_issued: bool = False
    probe_failed: bool = False
    ambiguity: float = 0.0
    wanted: int = 0  # the baseline with what ambiguous keys ask for, before any bound


def nearest_rank(values: Iterable[float], alpha: float) -> float:
    found = sorted(values)
    if not found:
        return 0.0
    rank = min(len(found), max(1, math.ceil(alpha * len(found))))
    return found[rank - 1]


def service_margin(items: Iterable[Item], mass: int, threshold: int, alpha: float) -> float:
    """The quantile, over keys that may reach the threshold, of the larger of inflation and hidden mass, over the mass."""
    return nearest_rank((max(i.inflation, i.hidden) / mass for i in items if i.upper >= threshold), alpha)


@dataclass
class Controller:
    policy: Policy
    state: State | None = field(default_factory=State)

    def next(self, q: int, items: list[Item], mass: int, threshold: int) -> Decision:
        """The capacity after a window that ran with q and certified items."""
        p = self.policy
        q = max(p.least, q or p.least)
        if p.fixed or not mass:
            return Decision(p.clamp(q), wanted=q, baseline=q)
        margin = service_margin(items, mass, threshold, p.alpha)
        violated = margin > p.target
        q_up = max(q + 1, math.ceil(q * (margin / p.target))) if violated else 0
        issued = failed = False
        base = q_up if violated else q
        if self.state is not None:
            self.state.low = self.state.low or p.least
            if violated:
                failed = self.state.on_probe
                base = self._recover(q, q_up, margin)
            else:
                base = self._settle(q, margin)
                issued = base < q
        base = max(p.least, base)
        lift = self._ambiguity(base, q, items, mass, threshold)
        wanted = max(base, math.ceil(base * math.exp(lift))) if p.ambiguity else base
        return Decision(p.clamp(max(p.least, wanted)), margin, violated, q_up, base, issued, failed, lift, wanted)

    def _recover(self, q: int, q_up: int, margin: float) -> int:
        """After a violation: up to the demand. A failed probe is remembered; a fresh violation forgets older probes."""
        p, s = self.policy, self.state
        if s.on_probe:
            s.low = max(s.low, q + 1)
            s.depth = max(1, (max(1, s.depth) + 1) // 2) if p.strategy == "pressure" else s.depth
        else:
            s.low, s.guarded = p.least, 0
            s.depth = 0 if p.strategy == "pressure" else s.depth
        base = max(s.low, q_up)
        if s.enough and base > s.enough:
            s.enough = 0
        if p.guard and s.on_probe:
            s.guarded = base
        s.calm = s.confirmed = 0
        s.on_probe = False
        return base

    def _settle(self, q: int, margin: float) -> int:
        """After a sufficient window: confirm what is under test, or probe lower when there is evidence."""
        p, s = self.policy, self.state
        s.enough = min(s.enough, q) if s.enough else q
        under_test = p.guard and (s.on_probe or s.guarded)
        if under_test:
            s.confirmed += 1
            if p.strategy == "pressure" or s.confirmed >= max(1, p.evidence):
                if s.on_probe and p.strategy == "pressure":
                    s.depth = 0
                if not s.on_probe:
                    s.guarded = 0
                s.on_probe = False
                s.calm = s.confirmed = 0
            return q
        s.on_probe, s.confirmed = False, 0
        s.calm += 1
        pressure = min(1.0, max(0.0, margin / p.target))
        room = s.enough > s.low + 1 or (p.strategy != "bracket" and q > p.least)
        allowed = p.strategy != "pressure" or (pressure <= min(1.0, max(0.0, p.gate)) and q > p.least)
        if not (p.probing and s.calm >= max(1, p.evidence) and room and allowed):
            return q
        s.calm = 0
        probe = self._bracket_probe() if p.strategy == "bracket" else self._release(q, pressure)
        if probe >= q:
            return q
        s.on_probe = True
        if p.strategy == "pressure":
            s.depth = q - probe
        return probe

    def _bracket_probe(self) -> int:
        """The geometric middle of what failed and what sufficed."""
        s = self.state
        low = min(max(s.low, s.guarded), s.enough - 1) if self.policy.guard and s.guarded else s.low
        if low >= s.enough:
            return s.enough
        return min(s.enough, max(low + 1, math.ceil(math.sqrt(low * s.enough))))

    def _release(self, q: int, pressure: float) -> int:
        """Halfway to what the margin supports, but at most half the floor at once."""
        p, s = self.policy, self.state
        shallow = max(1, (p.least + 1) // 2)
        supported = max(p.least, math.ceil(q * pressure))
        probe = q - (q - supported) // 2 if p.strategy == "comfort" or pressure > 0 else q - shallow
        probe = max(probe, p.least, q - shallow)
        if p.strategy == "pressure" and s.depth:
            probe = max(probe, q - s.depth)
        return max(probe, s.guarded) if p.guard else probe

    def _ambiguity(self, base: int, q: int, items: list[Item], mass: int, threshold: int) -> float:
        """Log capacity over the base that pays for resolving ambiguous keys; what isn't renewed decays."""
        p = self.policy
        if not p.ambiguity:
            return 0.0
        best = resolve_frontier([x for x in ambiguous_demand(items, mass, threshold, q, p) if x[0] > base], base)
        now = math.log(best / base) if best > base else 0.0
        lift = max(now, min(1.0, max(0.0, p.decay)) * (self.state.ambiguity if self.state else 0.0))
        if self.state:
            self.state.ambiguity = lift
        return lift


def ambiguous_demand(items: Iterable[Item], mass: int, threshold: int, q: int, policy: Policy) -> list[tuple[int, float]]:
    """(capacity, materiality) for each ambiguous key whose estimate and open side both are further from 1 / n than the target."""
    line, out = 1 / policy.n, []
    for i in items:
        if not i.lower < threshold <= i.upper:
            continue
        share = i.est / mass
        over = share >= line
        open_ = max(0.0, share - max(0.0, i.lower / mass)) if over else max(0.0, min(1.0, i.upper / mass) - share)
        away = abs(share - line)
        if open_ > policy.target and away > policy.target:
            out.append((max(policy.least, math.floor(q * (open_ / policy.target)) + 1), (away - policy.target) / line))
    return out


def resolve_frontier(demand: list[tuple[int, float]], base: int) -> int:
    """The capacity of largest resolved share of materiality less relative cost; the base where nothing gains."""
    useful = sorted(x for x in demand if x[1] > 0)
    total, done, best, gain = sum(m for _, m in useful), 0.0, base, 0.0
    for k, (q, m) in enumerate(useful):
        done += m
        if k + 1 < len(useful) and useful[k + 1][0] == q:
            continue
        worth = done / total - (q - base) / base
        if worth > gain:
            best, gain = q, worth
    return best


def width_ladder(n: int) -> list[int]:
    """Widths that a bucketed sketch may take: twice the one before, from 2 n / 25."""
    return [-(-n * f // 25) for f in (2, 4, 8, 16, 32)]


def next_width(width: int, complete: bool, n: int) -> int:
    """One rung up where completeness failed; never down."""
    higher = [w for w in width_ladder(n) if w > width]
    return width if complete or not higher else higher[0]


@dataclass(frozen=True)
class Capacity:
    """What a byte budget holds: modelled sizes of a head slot, a counter, a bucket cell and a cuckoo bucket."""

    budget: int

    def counters(self) -> int:
        return max(1, self.budget // 32)

    def tail(self, head: int) -> int:
        return max(1, (self.budget - 24 * head) // 32)

    def width(self, depth: int) -> int:
        return max(1, self.budget // (depth * 20 + 1))

    def cuckoo_buckets(self) -> int:
        return max(1, self.budget // 86)


def deployed(mode: str, decision: Decision, policy: Policy, q: int) -> int:
    """The capacity a mode deploys: the prediction, what the window needed, or that when it was short and no change else."""
    wanted = {"predictive": decision.q, "reactive-req": max(decision.baseline, policy.least), "reactive-eff": max(decision.q_up, q)}
    return policy.clamp(wanted[mode])


@dataclass(frozen=True)
class Check:
    """How a window's capacity q compares with what the window turned out to need, and with the plan that was made for it.

    required is the need without, effective with ambiguous keys, neither under the
    floor. miss: q is under the need, as far as the cap allows it. The plan's flags
    are None in the first window, for which there is no plan.
    """

    required: int
    effective: int
    miss_required: bool
    miss_effective: bool
    over_required: float
    over_effective: float
    service_ok: bool | None = None
    control_ok: bool | None = None
    calibration_ok: bool | None = None


def verify_plan(q: int, decision: Decision, policy: Policy, planned: tuple[int, int] | None) -> Check:
    """The check of a window; planned is (capacity, predicted need) of the plan made in the window before."""
    required, effective = max(policy.least, decision.baseline), max(policy.least, decision.wanted)
    cap = min(x for x in (policy.cap, policy.most, 2**62) if x is not None)
    flags = (None, None, None) if planned is None else (required <= planned[0], effective <= planned[0], effective <= max(policy.least, planned[1]))
    return Check(required, effective, q < min(required, cap), q < min(effective, cap), q / required, q / effective, *flags)


def upward_only(policy: Policy) -> Policy:
    return replace(policy, probing=False)
