"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source. A budget of tokens flows down by the
weights of siblings; what a branch can't supply goes to its siblings first, and
on to its ancestors' siblings only when a whole branch is short. Each leaf gives
whole seeded epochs of its documents, then the token-prefix of one more. The
prefix ends at a hash value per leaf, so a map-side comparison selects and no
text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a hash bucket in which prefixes are summed row by row.
BUCKET = 5_000


@dataclass(frozen=True)
class Mixture:
    """weights: by path of the tree, e.g. ("d0",) or ("d0", "en"); other siblings weigh 1. share: budget over all tokens."""

    weights: dict[tuple, float] = field(default_factory=dict)
    share: float = 0.6
    epochs: int = 4
    seed: int = 11
    most_leaves: int = 100_000


def fill(amount: float, weights: list[float], capacity: list[float]) -> list[float]:
    """amount over siblings by weight, none beyond its capacity; what one can't take goes to the others by weight."""
    given, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    amount = min(amount, sum(capacity[i] for i in open_))
    while open_ and amount > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if capacity[i] <= amount * weights[i] / total]
        if not full:
            for i in open_:
                given[i] = amount * weights[i] / total
            break
        for i in full:
            given[i] = capacity[i]
        amount -= sum(capacity[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budget(leaves: dict[tuple, int], amount: float, mixture: Mixture) -> dict[tuple, int]:
    """Target tokens of each leaf, from its available tokens. Branches of weight 0 get nothing."""
    depth = len(next(iter(leaves))) if leaves else 0
    capacity: dict[tuple, float] = {}
    weigh = lambda path: mixture.weights.get(path, 1.0)
    for path, tokens in leaves.items():
        usable = all(weigh(path[:d]) > 0 for d in range(1, depth + 1))
        for d in range(depth + 1):
            capacity[path[:d]] = capacity.get(path[:d], 0.0) + tokens * mixture.epochs * usable
    given: dict[tuple, float] = {(): min(amount, capacity.get((), 0.0))}
    for d in range(depth):
        below: dict[tuple, list[tuple]] = {}
        for path in sorted((p for p in capacity if len(p) == d + 1), key=lambda p: tuple((x is not None, str(x)) for x in p)):
            below.setdefault(path[:d], []).append(path)
        for parent, paths in below.items():
            given.update(zip(paths, fill(given[parent], [weigh(p) for p in paths], [capacity[p] for p in paths])))
    return {p: math.floor(given[p] + 1e-6) for p in leaves}


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def mix(docs: DataFrame, levels: list[Column], mixture: Mixture, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """docs' rows that the mixture takes, once an epoch, with columns mix_epoch, mix_tokens and mix_target.

    levels are the columns of the tree from the top. A leaf's rows go in the order
    of a seeded hash of the id; the prefix is the longest whose tokens stay within
    the target, and rows of equal hash (repeated ids) go together. Null levels are
    a branch of their own. A row without tokens (null or empty text) goes with its
    place in the prefix. Columns of docs named mix_* are replaced. The leaves must
    be mixture.most_leaves at most: their plan is made on the driver and broadcast.
    """
    spark = docs.sparkSession
    names = [f"level{i}" for i in range(len(levels))]
    tokens = word_count(docs["text"]) if tokens is None else tokens
    meta = cut(docs.select(docs[id_col].alias("id"), tokens.alias("tokens"), *[x.cast("string").alias(n) for x, n in zip(levels, names)]))
    found = meta.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(mixture.most_leaves + 1).collect()
    if len(found) > mixture.most_leaves:
        raise ValueError(f"the tree has more than {mixture.most_leaves} leaves")
    leaves = {tuple(r[n] for n in names): r["tokens"] for r in found}
    targets = budget(leaves, mixture.share * sum(leaves.values()), mixture)
    rows = []
    for r in found:
        path = tuple(r[n] for n in names)
        whole, rest = divmod(targets[path], r["tokens"]) if r["tokens"] else (0, 0)
        rows.append((*path, int(whole), int(rest), max(0, math.ceil(math.log2(max(1, r["n"]) / BUCKET))), targets[path]))
    plan = F.broadcast(spark.createDataFrame(rows, ", ".join(f"p_{n} string" for n in names) + ", whole int, rest long, bits int, mix_target long"))

    def planned(df: DataFrame) -> DataFrame:
        same = [df[n].eqNullSafe(plan[f"p_{n}"]) for n in names]
        on = same[0]
        for x in same[1:]:
            on = on & x
        return df.join(plan, on).withColumn("at", F.xxhash64(F.lit(mixture.seed), "whole", "id"))

    # The last hash of each leaf's prefix: by buckets of leading bits, then row by row in the bucket where it ends.
    leaf = [f"p_{n}" for n in names]
    some = planned(meta).filter("rest > 0").withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftright(at, 64 - bits)")).otherwise(F.lit(0).cast("long")))
    sums = some.groupBy(*leaf, "bucket", "rest").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    ends = cut(sums.filter("before <= rest and before + held > rest").select(*leaf, "bucket", "before"))
    last = F.broadcast(ends.select(*[F.col(x).alias(f"e_{x}") for x in leaf], F.col("bucket").alias("e_bucket"), "before"))  # a row a leaf at most
    same = some["bucket"] == last["e_bucket"]
    for x in leaf:
        same = same & some[x].eqNullSafe(last[f"e_{x}"])
    # rows of one hash count as one, however often an id repeats
    inside = some.join(last, same).groupBy(*leaf, "bucket", "bits", "rest", "before", "at").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("at"))  # with rows of equal hash
    cuts = inside.withColumn("sum", F.col("before") + running).groupBy(*leaf, "bucket", "bits").agg(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("at"))).alias("last"))
    # without a row that fits, the prefix ends before the bucket
    least = F.when(F.col("bits") > 0, F.expr("shiftleft(bucket, 64 - bits)")).otherwise(F.lit(-(2**63)))
    cuts = cuts.select(*[F.col(x).alias(f"c_{x}") for x in leaf], F.coalesce("last", least - F.when(least > -(2**63), 1).otherwise(0)).alias("last"), F.lit(True).alias("ends"))
    cuts = F.broadcast(cut(cuts))

    keep = [c for c in docs.columns if not c.startswith("mix_")]
    body = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[id_col].alias("id"), tokens.alias("mix_tokens"), *[x.cast("string").alias(n) for x, n in zip(levels, names)])
    taken = planned(body)
    on = F.lit(True)
    for x in leaf:
        on = on & taken[x].eqNullSafe(cuts[f"c_{x}"])
    taken = taken.join(cuts, on, "left")
    fits = (F.col("rest") > 0) & F.when(F.col("ends"), F.col("at") <= F.col("last")).otherwise(F.lit(True))
    times = F.col("whole") + fits.cast("int")
    taken = taken.filter(times > 0).select("row", "mix_tokens", "mix_target", F.explode(F.sequence(F.lit(0), times - 1)).alias("mix_epoch"))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "mix_epoch", "mix_tokens", "mix_target")
