"""Balanced label propagation over linked documents, in DataFrame operations only.

Large groups of equal texts are packed into shards first. Other linked documents
start in shards by hash. In each round a join brings every
document its neighbours' shards; documents that gain move, as far as the quotas
of the shards allow (flows between shards are cut down on the driver, a
shards-by-shards matrix). Documents without links then fill the shards to equal
counts, so that evenness never costs a link. Ranks inside a shard come from
counts of hash buckets, so no task sorts a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a rank bucket, and about the most members of a star of equal texts.
BUCKET = 20_000


def ranked(rows: DataFrame, part: str, bucket_of: Column, order: list[str], total: int, name: str) -> DataFrame:
    """rows with the rank from 0 of each row in its part, by hash bucket and then by `order`.

    Buckets have about BUCKET rows. Counts of buckets are summed up to where each
    begins; a window numbers the rows of each bucket by itself.
    """
    buckets = max(1, total // BUCKET)
    rows = rows.withColumn("bucket", F.pmod(bucket_of, F.lit(buckets)).cast("int"))
    counts = rows.groupBy(part, "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy(part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(part, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy(part, "bucket").orderBy(*order))
    return rows.join(begins, [part, "bucket"]).withColumn(name, (F.col("begin") + inside - 1).cast("long")).drop("bucket", "begin")


def quotas(flows: dict[tuple[int, int], int], held: list[int], limits: list[int]) -> dict[tuple[int, int], int]:
    """How many of each wished flow (from, to) may go, so that no shard ends over its limit by taking rows."""
    flows = dict(flows)
    while True:
        after = list(held)
        for (a, b), n in flows.items():
            after[a] -= n
            after[b] += n
        over = [b for b in range(len(held)) if after[b] > limits[b] and any(n for (_, to), n in flows.items() if to == b)]
        if not over:
            return flows
        for b in over:
            excess = after[b] - limits[b]
            for key in sorted((k for k in flows if k[1] == b), key=lambda k: (-flows[k], k)):
                less = min(excess, flows[key])
                flows[key] -= less
                excess -= less


@dataclass(frozen=True)
class Propagation:
    labels: DataFrame  # vertex, shard, anchor
    moved: int


def _lookup(values: dict[int, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, v)]), key)


def propagate(labels: DataFrame, edges: DataFrame, limits: list[int], rounds: int = 3) -> DataFrame:
    """labels (vertex, anchor, shard) after some rounds over undirected edges (src, dst), listed in both directions.

    In the first round a vertex hears only smaller neighbours, so that stars
    gather at their anchor; later, half of the vertices, by turns, hear all.
    A vertex moves to the shard that most of its neighbours have, if more of them
    than its own has. Movers within a quota go by their anchor's hash, so that what
    is linked is accepted together.
    """
    shards = len(limits)
    for r in range(rounds):
        heard = edges.filter("src < dst") if r == 0 else edges.filter(F.pmod(F.xxhash64("dst"), F.lit(2)) == r % 2)
        votes = heard.join(labels.select(F.col("vertex").alias("src"), "shard"), "src").groupBy("dst", "shard").agg(F.count("*").alias("votes"))
        here = labels.select(F.col("vertex").alias("dst"), F.col("shard").alias("now"), "anchor")
        wish = votes.join(here, "dst").groupBy("dst", "now", "anchor").agg(F.max(F.struct("votes", (-F.col("shard")).alias("s"))).alias("best"), F.coalesce(F.max(F.when(F.col("shard") == F.col("now"), F.col("votes"))), F.lit(0)).alias("own"))
        movers = cut(wish.filter((F.col("best.votes") > F.col("own"))).select(F.col("dst").alias("vertex"), "anchor", "now", (-F.col("best.s")).cast("int").alias("to")))
        flows = {(a, b): n for a, b, n in movers.groupBy("now", "to").count().collect()}  # shards by shards at most
        total = sum(flows.values())
        if not total:
            break
        held = dict(labels.groupBy("shard").count().collect())
        allowed = quotas(flows, [held.get(s, 0) for s in range(shards)], limits)
        if allowed != flows:
            pair = movers.withColumn("pair", F.col("now") * shards + F.col("to"))
            order = ranked(pair, "pair", F.xxhash64("anchor"), ["anchor", "vertex"], total, "rank")
            movers = order.filter(F.col("rank") < _lookup({a * shards + b: n for (a, b), n in allowed.items()}, F.col("pair")))
        labels = cut(labels.join(movers.select("vertex", "to"), "vertex", "left").select("vertex", "anchor", F.coalesce("to", "shard").alias("shard")))
    return labels


def packed(groups: list[tuple[str, int]], limits: list[int]) -> list[tuple[str, int, int, int]]:
    """(key, begin, end, shard) of groups (key, rows), the largest first: whole into the fullest shard that has room, else over the emptiest ones."""
    room, out = list(limits), []
    for key, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        begin = 0
        while begin < n:
            fits = [s for s in range(len(room)) if room[s] >= n - begin]
            s = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            take = min(n - begin, room[s])
            out.append((key, begin, begin + take, s))
            room[s] -= take
            begin += take
    return out


def _dealt(value: Column, room: list[int]) -> Column:
    """The shard of a hash, as often as the shard has room."""
    at, ends = F.pmod(value, F.lit(max(1, sum(room)))), []
    for n in room:
        ends.append(n + (ends[-1] if ends else 0))
    shard = F.lit(len(room) - 1)
    for s in reversed(range(len(room) - 1)):
        shard = F.when(at < ends[s], F.lit(s)).otherwise(shard)
    return shard.cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of each row of docs.

    Law "rows": the shards' row counts are at most one apart. Equal texts are
    linked (null texts with each other) and kept in one shard as far as that law
    allows: groups of over a sixteenth of a shard are packed first, the largest
    ahead, whole where a shard has room and else over the fewest. Smaller groups
    propagate, in stars of about BUCKET rows whose anchors are linked. size is the text's
    UTF-8 bytes plus 1; slots are gapless from 0 in each shard. Ids may be null or
    repeat: each row is placed by itself. Other columns of docs are ignored.
    """
    text = docs[text_col]
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("none")).alias("key"),
    )
    base = cut(rows.withColumn("vertex", F.monotonically_increasing_id()))
    total = base.count()
    limits = [total // shards + (s < total % shards) for s in range(shards)]

    groups = base.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # groups of over a sixteenth of a shard, so few that the driver packs them whole
    large = groups.filter(F.col("n") > total // shards // 16)
    chunks = packed([(r.key, r.n) for r in large.collect()], limits)
    fields = ("key string", "begin long", "end long", "shard int")
    given = F.array(*[F.struct(*[F.lit(x).cast(f.split()[1]).alias(f.split()[0]) for f, x in zip(fields, c)]) for c in chunks or [("", 0, 0, 0)]])
    where = F.broadcast(base.sparkSession.range(1).select(F.inline(given)))
    big = ranked(base.select("key", "vertex").join(F.broadcast(large.select("key")), "key"), "key", F.xxhash64("vertex"), ["vertex"], total, "rank")
    pinned = big.join(where, "key").filter("rank >= begin and rank < end").select("vertex", "shard")
    pinned = cut(ranked(pinned, "shard", F.xxhash64("vertex"), ["vertex"], total, "slot").select("vertex", "shard", "slot"))
    taken = dict(pinned.groupBy("shard").count().collect())
    rest = [limits[s] - taken.get(s, 0) for s in range(shards)]

    # the others are linked in stars, which start where their group does
    small = base.select("key", "vertex").join(F.broadcast(large.select("key")), "key", "left_anti")  # no key of more than a sixteenth of a shard is shuffled
    parted = small.join(groups, "key").withColumn("part", F.pmod(F.xxhash64("vertex"), F.ceil(F.col("n") / BUCKET)))
    anchors = parted.groupBy("key", "part").agg(F.min("vertex").alias("anchor"))
    begin = F.when(F.col("vertex") == F.col("anchor"), F.xxhash64("key")).otherwise(F.xxhash64("vertex"))
    linked = cut(parted.join(anchors, ["key", "part"]).select("vertex", "anchor", _dealt(begin, rest).alias("shard")))
    first = parted.groupBy("key").agg(F.min("vertex").alias("first"))
    chained = anchors.join(first, "key").filter("anchor <> first").select(F.col("first").alias("a"), F.col("anchor").alias("b"))
    spokes = linked.filter("vertex <> anchor").select(F.col("anchor").alias("a"), F.col("vertex").alias("b")).union(chained)
    edges = spokes.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(spokes.select("b", "a"))
    labels = propagate(linked, edges, rest, rounds)

    # linked rows keep their shards up to the limits; what is over, and rows without links, fill the shards
    kept = cut(ranked(labels, "shard", F.xxhash64("anchor"), ["anchor", "vertex"], total, "slot"))
    loose = kept.filter(F.col("slot") < _lookup(dict(enumerate(rest)), F.col("shard"))).select("vertex", "shard", (F.col("slot") + _lookup({s: taken.get(s, 0) for s in range(shards)}, F.col("shard"))).alias("slot"))
    inside = cut(pinned.unionByName(loose))
    held = dict(inside.groupBy("shard").count().collect())
    free = base.select("vertex").join(inside.select("vertex"), "vertex", "left_anti").withColumn("all", F.lit(0))
    order = ranked(free, "all", F.xxhash64("vertex"), ["vertex"], total, "rank")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        end = begin + limits[s] - held.get(s, 0)
        mine = (F.col("rank") >= begin) & (F.col("rank") < end)
        shard = F.when(mine, F.lit(s)).otherwise(shard)
        slot = F.when(mine, F.col("rank") - begin + held.get(s, 0)).otherwise(slot)
        begin = end
    placed = inside.unionByName(order.select("vertex", shard.alias("shard"), slot.alias("slot")))
    out = base.join(placed, "vertex")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
