"""Method specifications, as text, and the runs they describe.

    ss[policy=static q=2n]   hybrid[hyb-head=frontier alpha-req=0.95]   hl[hl-w=64 hl-cert=on]   chk   oracle
"""

from __future__ import annotations

import json
import re
from dataclasses import astuple, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.held import held, scratch
from ..operators import exact, hybrid, metrics, reduce, sketches
from ..sources.streams import EVENT
from .control import Capacity, Controller, Item, Policy, deployed, next_width, verify_plan, width_ladder

METHODS = ("oracle", "ss", "hybrid", "hl", "chk")
_FLAG = {"on": True, "off": False}
#: Fixed names and values: the options, the methods they apply to, and what they may be.
OPTIONS: dict[str, tuple[tuple[str, ...], object]] = {
    "policy": (("ss",), ("difficulty", "static")),
    "q": (("ss",), re.compile(r"\d*n|\d+")),
    "alpha-req": (("ss", "hybrid"), (0.0, 1.0)),
    "epsilon-m": (("ss", "hybrid"), (0.0, float("inf"))),
    "downward-probing": (("ss", "hybrid"), _FLAG),
    "probe-residual-guard": (("ss", "hybrid"), _FLAG),
    "probe-strategy": (("ss", "hybrid"), ("bracket", "comfort", "pressure")),
    "probe-pressure-gate": (("ss", "hybrid"), (0.0, 1.0)),
    "amb-adjust": (("ss", "hybrid"), _FLAG),
    "diff-mode": (("ss", "hybrid"), ("predictive", "reactive-req", "reactive-eff")),
    "ss-eps": (("ss", "hybrid"), ("per-item", "max-sketch")),
    "hyb-tail": (("hybrid",), re.compile(r"\d*n|difficulty")),
    "hyb-head": (("hybrid",), ("topn-frontier", "frontier", "confirmed", "topn", "top2n", "threshold")),
    "head-delta-eta": (("hybrid",), (0.0, 1.0)),
    "head-checkpoint": (("hybrid",), (1.0, float("inf"))),
    "reducer": (("ss", "hybrid"), ("hash", "streaming", "parallel-streaming")),
    "hl-w": (("hl",), re.compile(r"auto|\d+")),
    "hl-d": (("hl",), (1.0, float("inf"))),
    "hl-L": (("hl",), (0.0, float("inf"))),
    "hl-lossy": (("hl",), (0.0, 3.0)),
    "hl-cert": (("hl",), _FLAG),
    "hl-adaptive": (("hl",), _FLAG),
}


@dataclass(frozen=True)
class Method:
    name: str
    options: dict[str, object] = field(default_factory=dict)
    label: str = ""

    def get(self, name: str, otherwise: object) -> object:
        return self.options.get(name, otherwise)


def _value(name: str, text: str) -> object:
    allowed = OPTIONS[name][1]
    if isinstance(allowed, dict):
        if text in allowed:
            return allowed[text]
    elif isinstance(allowed, re.Pattern):
        if allowed.fullmatch(text):
            return text
    elif isinstance(allowed[0], str):
        if text in allowed:
            return text
    else:
        number = float(text)
        if allowed[0] <= number <= allowed[1]:
            return int(number) if number.is_integer() and name not in ("alpha-req", "epsilon-m", "hl-L") else number
    raise ValueError(f"{name}={text}")


def parse_methods(text: str) -> list[Method]:
    """The methods of a comma-separated list; unknown names and options raise. Repeated methods get numbered labels."""
    out = []
    for spec in re.findall(r"[^,\[\]]+(?:\[[^\]]*\])?", text):
        m = re.fullmatch(r"\s*([\w-]+)(?:\[([^\]]*)\])?\s*", spec)
        if not m or m[1] not in METHODS:
            raise ValueError(f"unknown method {spec.strip()}")
        options = {}
        for pair in (m[2] or "").split():
            name, _, value = pair.partition("=")
            if name not in OPTIONS or m[1] not in OPTIONS[name][0]:
                raise ValueError(f"{m[1]} has no option {name}")
            options[name] = _value(name, value)
        if options.get("hl-adaptive"):
            options["hl-cert"] = True
        out.append(Method(m[1], options))
    seen: dict[str, int] = {}
    labelled = []
    for m in out:
        base = f"{m.name}-{m.get('policy', 'difficulty')}" if m.name == "ss" else f"{m.name}-{m.get('hyb-head', 'topn-frontier')}" if m.name == "hybrid" else m.name
        seen[base] = seen.get(base, 0) + 1
        labelled.append(Method(m.name, m.options, base if seen[base] == 1 else f"{base}#{seen[base]}"))
    return labelled


def multiple(text: str, n: int) -> int:
    """'kn' as k * n, 'n' as n, digits as they are."""
    return int(text[:-1] or 1) * n if text.endswith("n") else int(text)


def policy_of(method: Method, n: int, cap: int | None) -> Policy:
    fixed = method.name == "ss" and method.get("policy", "difficulty") == "static"
    return Policy(
        n=n, floor=n, cap=cap, fixed=fixed, alpha=method.get("alpha-req", 0.95), epsilon_m=method.get("epsilon-m", 0.15), probing=method.get("downward-probing", True),
        guard=method.get("probe-residual-guard", True), strategy=method.get("probe-strategy", "comfort"), gate=method.get("probe-pressure-gate", 0.5), ambiguity=method.get("amb-adjust", False),
    )


def frontier(items: DataFrame) -> list[Item]:
    """The items that may be heavy: at most a few times n rows, by the certificate."""
    return [item for item, _ in _control_rows(items, 0)[0]]


def _control_rows(items: DataFrame, top: int) -> tuple[list[tuple[Item, Row]], Row | None]:
    """What the controller and the next head need of one window's items, in one job: the frontier, and the `top` largest."""
    order = Window.partitionBy("window").orderBy(F.desc("est"), "id")
    ranked = items.withColumn("rank", F.row_number().over(order)) if top else items.withColumn("rank", F.lit(1))
    wanted = ranked.filter((F.col("cert_ub") >= F.col("threshold")) | (F.col("rank") <= top)) if top else ranked.filter(F.col("cert_ub") >= F.col("threshold"))
    rows = wanted.select("id", "rank", "est", "cert_lb", "cert_ub", "inflation", "hidden", "mass", "threshold").collect()
    return [(Item(r.est, r.cert_lb, r.cert_ub, r.inflation, r.hidden), r) for r in rows], rows[0] if rows else None


def next_head(rows: list[Row], policy: str, n: int) -> list[str]:
    """The ids that a policy takes into the next head, from a window's frontier and top: see hybrid.select_head."""
    rules = {
        "topn": lambda r: r.rank <= n, "top2n": lambda r: r.rank <= 2 * n, "frontier": lambda r: r.cert_ub >= r.threshold, "topn-frontier": lambda r: r.rank <= n or r.cert_ub >= r.threshold,
        "confirmed": lambda r: r.cert_lb >= r.threshold, "threshold": lambda r: r.cert_ub >= r.threshold and r.rank > n,
    }
    return [r.id for r in sorted(rows, key=lambda r: r.rank) if rules[policy](r)]


def run_static(events: DataFrame, method: Method, n: int, memory: int | None = None) -> DataFrame:
    """(window, id, est, cert_lb, cert_ub, mass, threshold, ...) of all windows in one plan, for a fixed capacity."""
    budget = Capacity(memory) if memory else None
    if method.name == "oracle":
        return reduce.certify(*reduce.from_sketch(sketches.exact_report(events), "head", hold=False), n, prune=False)
    if method.name == "ss":
        q = multiple(method.get("q", "n"), n)
        q = min(q, budget.counters()) if budget else q
        return reduce.certify(*reduce.from_sketch(sketches.space_saving(events, q, method.get("ss-eps", "per-item") == "per-item")), n, prune=False, reducer=method.get("reducer", "hash"))
    if method.name == "chk":
        found = sketches.cuckoo_keeper(events, budget.cuckoo_buckets() if budget else n, theta=1 / n)
        return reduce.certify(*reduce.from_sketch(found, "plain"), n, prune=False)
    if method.name == "hl":
        depth, width = int(method.get("hl-d", 6)), method.get("hl-w", "auto")
        width = (budget.width(depth) if budget else -(-8 * n // 25)) if width == "auto" else int(width)
        return _buckets(events, method, n, width, depth, bool(method.get("hl-cert", False)))[0]
    raise ValueError(f"{method.name} is adaptive")


RUN = (
    "window long, method string, n int, q long, q_next long, head_size int, head_next int, tail_floor int, tail_cap long, margin double, violation boolean, q_up long, probe_issued boolean, probe_failed boolean, "
    "required long, effective long, miss_required boolean, miss_effective boolean, over_required double, over_effective double, service_ok boolean, control_ok boolean, calibration_ok boolean, "
    "head_removed int, head_added int, head_delta boolean, head_bytes long, mass long"
)


def staged(events: DataFrame) -> tuple[str, list[int]]:
    """Events of positive weight by window in the shared folder, and the windows: each window's step then reads its own files."""
    path = scratch(events.sparkSession, "events")
    rows = events.filter("weight > 0 and window is not null").select("window", "part", "pos", "key", "weight")
    rows.repartition("window", "part").write.partitionBy("window").parquet(path)
    back = events.sparkSession.read.schema(EVENT).parquet(path)
    return path, sorted(r[0] for r in back.select("window").distinct().collect())


@dataclass
class Adaptive:
    """An adaptive run of Space-Saving or of a hybrid: what the next window gets, from what this one showed.

    A hybrid's tail is bounded by what memory leaves beside the head, and its floor
    is n times the share of mass that a partition has outside the head. Both bound
    the controller's decision, and the floor wins.
    """

    method: Method
    n: int
    memory: int | None
    partitions: int = 1
    head: hybrid.Head = field(default_factory=hybrid.Head)
    planned: tuple[int, int] | None = None

    def __post_init__(self):
        self.is_hybrid = self.method.name == "hybrid"
        self.capacity = Capacity(self.memory) if self.memory else None
        self.controller = Controller(policy_of(self.method, self.n, self.capacity.counters() if self.capacity else None))
        self.q = self.controller.policy.clamp(self._static() or self.n)

    def _static(self) -> int | None:
        """The fixed capacity of a method without control."""
        if self.is_hybrid:
            tail = self.method.get("hyb-tail", "difficulty")
            return None if tail == "difficulty" else multiple(tail, self.n)
        return multiple(self.method.get("q", "n"), self.n) if self.method.get("policy", "difficulty") == "static" else None

    def reports(self, spark, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        per_item = self.method.get("ss-eps", "per-item") == "per-item"
        if self.is_hybrid:
            return hybrid.hybrid_report(events, self.head.frame(spark), self.q, self.head.generation, per_item)
        return reduce.from_sketch(sketches.space_saving(events, self.q, per_item))

    def step(self, label: int, rows: list[tuple[Item, Row]], total: Row | None, head_share: float) -> tuple:
        """The window's row of RUN; then the state is that of the next window."""
        mass, threshold = (total.mass, total.threshold) if total else (0, 1)
        known, q, policy = set(self.head.ids), self.q, self.controller.policy
        change = None
        if self.is_hybrid:
            wanted = next_head([r for _, r in rows], self.method.get("hyb-head", "topn-frontier"), self.n)
            change = hybrid.update(self.head, wanted, 4 * self.n, self.method.get("head-delta-eta", 0.8), int(self.method.get("head-checkpoint", 32)))
            cap = self.capacity.tail(len(change.head.ids)) if self.capacity else None
            policy = replace(policy, floor=hybrid.tail_floor(1, self.n, head_share), cap=cap, most=cap)
        self.controller.policy = policy
        residual = [i for i, r in rows if r.id not in known and r.cert_ub >= r.threshold]
        decision = self.controller.next(q, residual, mass, threshold)
        check = verify_plan(q, decision, policy, self.planned)
        fixed = self._static()
        following = policy.clamp(fixed) if fixed else deployed(self.method.get("diff-mode", "predictive"), decision, policy, q)
        self.q = max(policy.least, following)
        self.planned = None if fixed else (self.q, decision.wanted)
        if change:
            self.head = change.head
        return (
            label, self.method.label, self.n, q, self.q, len(known), len(self.head.ids), policy.least, policy.cap, decision.margin, decision.violation, decision.q_up, decision.probe_issued, decision.probe_failed,
            *astuple(check), len(change.removed) if change else 0, len(change.added) if change else 0, bool(change and change.is_delta), change.bytes * self.partitions if change else 0, mass,
        )


def run_adaptive(events: DataFrame, method: Method, n: int, memory: int | None = None, topk: int | None = None) -> DataFrame:
    """One row per window of an adaptive run: capacities, margin, probes, the plan's check, head updates, and quality.

    Windows follow each other, as each one's capacity comes from the one before. A
    window's certified items are written once; its frontier and its top, a few
    times n rows, reach the driver. Quality is one more plan over all the items.
    hl with hl-adaptive=on climbs its width ladder instead.
    """
    if method.name == "hl":
        return _run_widths(events, method, n, topk)
    spark = events.sparkSession
    path, labels = staged(events)
    items_at = scratch(spark, "items")
    every = spark.read.schema(EVENT).parquet(path)
    run = Adaptive(method, n, memory, every.select("part").distinct().count())
    rows = []
    for label in labels:
        parts, reports = run.reports(spark, every.filter(F.col("window") == label))
        reduce.certify(parts, reports, n, prune=False, reducer=method.get("reducer", "hash")).write.mode("append").partitionBy("window").parquet(items_at)
        items = spark.read.parquet(f"{items_at}/window={label}").withColumn("window", F.lit(label).cast("long"))
        share = hybrid.least_head_share(parts).first().share if run.is_hybrid else 0.0
        rows.append(run.step(label, *_control_rows(items, 2 * n), share))
    control = spark.createDataFrame(rows, RUN)
    return _with_quality(control, every, items_at, labels, n, topk)


def _with_quality(control: DataFrame, events: DataFrame, items_at: str, labels: list[int], n: int, topk: int | None) -> DataFrame:
    names = ["precision", "recall", "f1", "aae", "are"] + ["overlap"] * (topk is not None)
    if not labels:
        return control.select("*", *[F.lit(None).cast("double").alias(x) for x in names])
    items = control.sparkSession.read.parquet(items_at).withColumn("window", F.col("window").cast("long"))
    score = metrics.evaluate(exact.global_counts(events).withColumnRenamed("key", "id"), items, n, topk)
    return control.join(score.select("window", *names), "window", "left")


def _run_widths(events: DataFrame, method: Method, n: int, topk: int | None) -> DataFrame:
    """(window, method, n, q, q_next, complete, mass, quality): q is the width, one rung up after a window that could not certify its candidates."""
    spark = events.sparkSession
    path, labels = staged(events)
    items_at = scratch(spark, "items")
    every = spark.read.schema(EVENT).parquet(path)
    width, depth, rows = method.get("hl-w", "auto"), int(method.get("hl-d", 6)), []
    width = width_ladder(n)[0] if width == "auto" else int(width)
    for label in labels:
        one = every.filter(F.col("window") == label)
        items, summary = _buckets(one, method, n, width, depth, True)
        items.write.mode("append").partitionBy("window").parquet(items_at)
        told = summary.first()
        after = next_width(width, told.complete, n)
        rows.append((label, method.label, n, width, after, told.complete, told.mass))
        width = after
    control = spark.createDataFrame(rows, "window long, method string, n int, q long, q_next long, complete boolean, mass long")
    return _with_quality(control, every, items_at, labels, n, topk)


def _buckets(events: DataFrame, method: Method, n: int, width: int, depth: int, certified: bool) -> tuple[DataFrame, DataFrame]:
    cells = held(sketches.locked_buckets(events, width, depth, method.get("hl-L", 0.7), 1 / n, int(method.get("hl-lossy", 2))))
    rest = cells.select("window", "part", "bucket", "residual").distinct() if certified else None
    parts = cells.groupBy("window", "part").agg(F.max("n_local").alias("n_local"))
    return reduce.reduce_buckets(cells.withColumnRenamed("key", "id"), n, depth, rest, parts)


def adaptive(method: Method) -> bool:
    return method.name == "hybrid" or method.name == "ss" and method.get("policy", "difficulty") == "difficulty" or method.name == "hl" and bool(method.get("hl-adaptive", False))


def benchmark(events: DataFrame, methods: str, n: int, memory: int | None = None, topk: int | None = None) -> DataFrame:
    """Quality per (window, method) of a list of methods against the exact counts; the list must name oracle. With topk, the overlap of the top k too."""
    parsed = parse_methods(methods)
    if not any(m.name == "oracle" for m in parsed):
        raise ValueError("the list needs oracle")
    truth = held(exact.global_counts(events).withColumnRenamed("key", "id"))
    names = ["precision", "recall", "f1", "aae", "are"] + ["overlap"] * (topk is not None)
    out = None
    for m in parsed:
        if m.name == "oracle":
            continue
        one = run_adaptive(events, m, n, memory, topk) if adaptive(m) else metrics.evaluate(truth, run_static(events, m, n, memory), n, topk).withColumn("method", F.lit(m.label))
        part = one.select("window", "method", *names)
        out = part if out is None else out.unionByName(part)
    return out


# Run configurations


def load_run(path: str, overrides: dict | None = None) -> dict:
    """A run preset with its generation, partitioning and scenario files read in: those it names lie beside it, those of overrides by themselves.

    The n of all three must agree.
    """
    preset = json.loads(Path(path).read_text())
    out = dict(preset)
    for part in ("generation", "partitioning", "scenario"):
        named = (overrides or {}).get(part)
        source = Path(named) if named else Path(path).parent / preset[part] if isinstance(preset.get(part), str) else None
        if source:
            out[part] = json.loads(source.read_text())
    validate_topology(out)
    return out


def validate_topology(config: dict) -> int | None:
    """The n of a run, which its parts may not contradict."""
    found = {x["n"] for p in ("generation", "partitioning") if isinstance(x := config.get(p), dict) and "n" in x}
    found |= {s["n"] for s in (config.get("scenario") or []) if isinstance(s, dict) and "n" in s}
    if len(found) > 1:
        raise ValueError(f"n differs between the parts of the run: {sorted(found)}")
    return found.pop() if found else None


def write_manifest(config: dict, folder: str) -> None:
    """The exact inputs of a run beside its results."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "run.json").write_text(json.dumps(config, indent=1, sort_keys=True))
