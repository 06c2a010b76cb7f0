"""Exact n-gram Jaccard join with T-occurrence search.

1. One pass turns each text into its set of word n-gram hashes, and that into a
   digest and signatures. Texts of equal sets are one class; of those that one task
   meets, the first alone keeps its signatures.
2. Sets are cut into parts by hash. Two sets that link differ in at most h elements,
   so of h + 1 + x parts at least x + 1 agree whole; each set emits the signatures of
   its h + 1 fullest parts, and the fullest part that agrees is always among them.
   Equal signatures give candidate groups (their connected components): no link
   crosses two groups, and a signature of many texts makes a star, not all pairs.
   The larger the corpus, the more groups hang together by chance: those too large
   for one search are split by their n-grams. In order of the texts of the group that
   hold them, rarest first, two sets that link share one of their first n - least
   overlap + 1; only n-grams of two texts or more can be that one.
3. Within a candidate group, inverted lists of the n-grams answer T-occurrence
   searches: DivideSkip sets a query's longest lists aside, heap-merges the short
   ones, and probes the long ones by binary search for what the merge found. Large
   groups are cut into blocks, and all pairs of blocks searched. Every link between
   classes is found and counted; equal texts are links by their class.
4. The links' connected components are the components of the documents.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, lean, let_go, mix64, slices, with_columns, written
from .graph import components, forest

MIX = np.uint64(0xD1342543DE82EF95)


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; of fewer words, one of the whole; of none, none."""
    from xxhash import xxh3_64_intdigest

    words = [(t or "").encode().lower().split() for t in texts]  # lower() of bytes changes A-Z only; split() at ASCII white space
    code = {w: xxh3_64_intdigest(w) for x in words for w in x}
    out = []
    for x in words:
        h = np.fromiter(map(code.__getitem__, x), np.uint64, len(x))
        if not len(h):
            out.append(h)
            continue
        n = min(width, len(h))
        rolled = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            rolled = mix64(rolled * MIX + h[j : len(h) - n + 1 + j])
        out.append(np.unique(rolled))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    lo, hi = mix64(s).sum(dtype=np.uint64), mix64(s ^ MIX).sum(dtype=np.uint64)
    return int(lo.astype(np.int64)), int(hi.astype(np.int64))


class Parts:
    """Signatures of sets such that any two that reach `percent` similarity share one."""

    def __init__(self, percent: int):
        self.percent, self.tops, self.plan = percent, [1], []

    def _reach(self, n: int) -> int:
        """The largest set that one of n elements can link with."""
        return 100 * n // self.percent

    def _class(self, n: int) -> int:
        """Sizes are classed so that only sets of the same or neighbouring classes can link."""
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, self._reach(self.tops[-1])))
        while len(self.plan) < len(self.tops):
            top = self.tops[len(self.plan)]
            differ = (top + self._reach(top)) * (100 - self.percent) // (100 + self.percent)
            spare = (differ + 1) // 4
            self.plan.append((differ + 1 + spare, spare))
        return bisect_left(self.tops, n)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        k, weight = self._class(len(s)), mix64(s)
        found = []
        for group in ([k - 1, k] if k else [k]):
            parts, spare = self.plan[group]
            part = ((s >> np.uint64(9)) % np.uint64(parts)).astype(np.int64)
            count = np.bincount(part, minlength=parts)
            run = np.concatenate([[np.uint64(0)], np.cumsum(weight[np.argsort(part, kind="stable")], dtype=np.uint64)])
            end = np.cumsum(count)
            total = run[end] - run[end - count]
            full = np.argsort(count, kind="stable")[spare:]  # by elements, then by number: the same order in every set
            found.append(mix64(total[full] ^ mix64((group << 32) + full)))
        return np.concatenate(found).view(np.int64)


#: Runs that one step of a merge takes from the heap.
WAYS = 16


def heap_merge(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(id, occurrences) of sorted runs of ids, in order. The heap gives the shortest runs, which are merged into one and go back."""
    heap = [(len(x), i, x, np.ones(len(x), np.int64)) for i, x in enumerate(runs) if len(x)]
    heapq.heapify(heap)
    while heap:
        some = [heapq.heappop(heap) for _ in range(min(WAYS, len(heap)))]
        ids, counts = np.concatenate([x[2] for x in some]), np.concatenate([x[3] for x in some])
        order = np.argsort(ids, kind="stable")  # of sorted runs, a merge
        ids, counts = ids[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        ids, counts = ids[first], np.add.reduceat(counts, first)
        if not heap:
            return ids, counts
        heapq.heappush(heap, (len(ids), some[0][1], ids, counts))
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def t_occurrence(sets: list[np.ndarray], percent: int, asks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """All links of the sets as (i, its j's): asking sets search the others, or each other where all ask, each pair once."""
    n = len(sets)
    both = bool(asks.all())
    size = np.array([len(s) for s in sets], np.int64)
    held = np.arange(n) if both else np.flatnonzero(~asks)
    grams = np.concatenate([sets[i] for i in held]) if len(held) else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    owner = np.repeat(held, size[held])[order]
    grams, first = np.unique(grams[order], return_index=True)
    last = np.append(first[1:], len(owner))
    for r in np.flatnonzero(asks).tolist():
        s = sets[r]
        need = -(-percent * len(s) // 100)  # of any set that links with s
        at = np.searchsorted(grams, s)
        at = at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == s)] if len(grams) else at[:0]
        if len(at) < need:
            continue
        at = at[np.argsort(last[at] - first[at], kind="stable")]
        short = at[: len(at) - need + 1]  # one occurrence here at least
        lists = [owner[first[i] : last[i]] for i in short.tolist()]
        lists = [x[(size[x] * 100 >= percent * len(s)) & (len(s) * 100 >= percent * size[x])] for x in lists]
        found, seen = heap_merge([x[x < r] if both else x for x in lists])
        long = at[len(at) - need + 1 :].tolist()
        for k, i in enumerate(long):
            if not len(found):
                break
            x = owner[first[i] : last[i]]
            p = np.searchsorted(x, found)
            seen = seen + (x[np.minimum(p, len(x) - 1)] == found)
            if k % 16 == 15:  # those that can't reach the least overlap any more
                on = seen + len(long) - 1 - k >= need
                found, seen = found[on], seen[on]
        ok = 100 * seen >= percent * (len(s) + size[found] - seen)
        if ok.any():
            yield r, found[ok]


#: Classes that a task remembers as met.
MET = 1 << 16


def _sets(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, met = Parts(percent), set()
        for part in slices(batches, "text", 1 << 20):
            found = shingles(part.column("text").to_pylist(), width)
            digests, signatures = [*map(digest, found)], []
            for s, d, has_id in zip(found, digests, part.column("doc").is_valid().to_pylist()):
                one = (d[1] << 64) + d[0]
                new = len(s) and has_id and one not in met
                signatures.append(parts.signatures(s) if new else None)
                if new:
                    met = met if len(met) < MET else set()
                    met.add(one)
            lo, hi = zip(*digests)
            cols = [part.column("row"), part.column("doc"), part.column("carry"), pa.array([len(s) for s in found], pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc", "carry", "n", "lo", "hi", "signatures"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and row: each run's first row with each other of the run."""
    sig_before = doc_before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, doc = np.asarray(batch.column("sig")), np.asarray(batch.column("row"))
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        start = doc[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
        if sig_before is not None and sig[0] == sig_before:
            run = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(sig)
            start[:run] = doc_before
        sig_before, doc_before = sig[-1], start[-1]
        on = start != doc
        a, b = start[on], doc[on]
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


FOUND = "a long, b long, links long"


def _search(percent: int, pairs: bool):
    """Rows (a, b) of links, all with pairs, else as many as connect the same classes; and rows (a, links) of documents that a class links with."""

    def run(group: pa.Table) -> pa.Table:
        node, size = np.asarray(group["node"]), np.asarray(group["size"])
        asks = np.asarray(group["asks"].combine_chunks())
        once = np.sort(np.unique(np.stack([node, asks]), axis=1, return_index=True)[1])  # rows that repeat
        node, size, asks = node[once], size[once], asks[once]
        grams = group["grams"].take(pa.array(once)).to_pylist()
        links, a, b = np.zeros(len(node), np.int64), [], []
        both = group["i"][0].as_py() == group["j"][0].as_py()
        for r, found in t_occurrence([np.frombuffer(x, np.uint64) for x in grams], percent, np.ones(len(node), bool) if both else asks):
            links[r] += size[found].sum()
            links[found] += size[r]
            a.append(np.full(len(found), r))
            b.append(found)
            if not pairs and sum(map(len, a)) > 8 * len(node) + 1024:
                a, b = ([x] for x in forest(np.concatenate(a), np.concatenate(b)))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if not pairs:
            a, b = forest(a, b)
        some = np.flatnonzero(links)
        none = pa.nulls(len(some), pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(node[some])]),
            "b": pa.concat_arrays([pa.array(np.maximum(node[a], node[b])), none]),
            "links": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(links[some])]),
        })

    return run


def _grams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found = shingles(part.column("text").to_pylist(), width)
            same = [digest(s) == (x, y) for s, x, y in zip(found, part.column("lo").to_pylist(), part.column("hi").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("place"), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "place", "grams"]).filter(pa.array(same))

    return run


def _loose_grams(width: int):
    """(root, gram, node): each n-gram of the texts by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found = shingles(part.column("text").to_pylist(), width)
            same = [digest(s) == (x, y) for s, x, y in zip(found, part.column("lo").to_pylist(), part.column("hi").to_pylist())]
            found = [s if ok else s[:0] for s, ok in zip(found, same)]
            count = [len(s) for s in found]
            root, node = (np.repeat(np.asarray(part.column(c)), count) for c in ("root", "node"))
            yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(np.concatenate(found).view(np.int64)), pa.array(node)], names=["root", "gram", "node"])

    return run


#: Texts of an n-gram that are counted; n-grams of more are equally common.
COMMON = 1 << 12


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by root, gram and node: those of n-grams that several nodes of a root hold, each once, with their number (COMMON at most)."""
    kept, many = np.zeros((3, 0), np.int64), False  # the last run so far; many: it has COMMON, and what it had went on

    def several(rows: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray]:
        """The rows of runs of two and more, and their counts; more: the first run is one of COMMON."""
        new = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        run = np.cumsum(new) - 1
        count = np.minimum(np.bincount(run), COMMON)
        count[0] = COMMON if more else count[0]
        on = count[run] > 1
        return rows[:, on], count[run][on]

    def out(rows: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, count)], names=["root", "gram", "node", "held"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([kept, np.stack([np.asarray(batch.column(c)) for c in ("root", "gram", "node")])], axis=1)
        rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])]
        last = (rows[:2] == rows[:2, -1:]).all(axis=0)
        start = int(np.argmax(last))  # of the last run, which may go on
        grown = len(last) - start >= COMMON or (many and not start)
        # of a run that is long enough its last node alone waits, so that a repeated one is seen
        cut_at = len(last) - 1 if grown else start
        if cut_at:
            here, count = several(rows[:, :cut_at], many)
            if grown:  # its last node isn't among these rows, but it counts
                tail = (here[:2] == rows[:2, -1:]).all(axis=0)
                count[tail] = COMMON
            yield out(here, count)
        kept, many = rows[:, cut_at:], grown
    if kept.shape[1]:
        yield out(*several(kept, many))


@dataclass(frozen=True)
class Join:
    documents: DataFrame  # id, n_shingles, n_links, component_id, component_row (one number a component), carry
    links: DataFrame  # a, b: linked classes, a < b, each pair once
    members: DataFrame  # class, id: the rows of each class, of equal sets


#: Most classes whose place in the search is broadcast; more are joined by shuffle.
BROADCAST = 1 << 17

#: Most blocks of a candidate group that is searched as it is, in all pairs of blocks; larger ones are split first.
PAIRED = 4

#: Most words of the filter by which rows of other ids are left out of such a shuffle.
WORDS = 1 << 20


def _with_texts(rows: DataFrame, places: DataFrame, count: int) -> DataFrame:
    """rows joined by doc with places, of which there are `count`. Of many, a filter with two of 16 bits an id comes first, so that hardly a text is shuffled in vain."""
    if count <= BROADCAST:
        return rows.join(F.broadcast(places), "doc")
    word = F.pmod(F.xxhash64("doc"), F.lit(min(WORDS, count // 4 + 1))).cast("int")
    mask = F.expr("shiftleft(1L, CAST(shiftrightunsigned(xxhash64(doc), 58) AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(xxhash64(doc), 52) & 63 AS INT))")
    words = places.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    some = rows.withColumn("word", word).join(F.broadcast(words), "word").filter(F.col("bits").bitwiseAND(mask) == mask)
    return some.drop("word", "bits").join(places, "doc")


def _sized(placed: DataFrame, block: int, most_sets: int) -> DataFrame:
    """(root, k, grams, blocks) of the groups; those of one class have nothing to search."""
    totals = placed.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("grams")).filter("k > 1")
    return totals.withColumn("blocks", F.greatest(F.ceil(F.col("grams") / block), F.ceil(F.col("k") / most_sets)).cast("int"))


def _rooted(pairs: DataFrame) -> DataFrame:
    """(node, root) of all nodes of what components gives, roots included."""
    return pairs.select(F.col("v").alias("node"), "root").union(pairs.select(F.col("root").alias("node"), "root").distinct())


def _split(rows: DataFrame, placed: DataFrame, large: DataFrame, width: int, percent: int) -> DataFrame:
    """placed, with the groups of `large` split by the n-grams that their sets' prefixes share; sets that share none are left out."""
    own = cut(placed.join(large.select("root"), "root"))
    texts = _with_texts(rows, own.select("doc", "lo", "hi", "node", "root"), own.count()).select("text", "lo", "hi", "node", "root")
    loose = texts.mapInArrow(lean(_loose_grams(width)), "root long, gram long, node long")
    common = loose.repartition("root", "gram").sortWithinPartitions("root", "gram", "node").mapInArrow(lean(_common), "root long, gram long, node long, held long")
    # n-grams of one text come first in a prefix, and link nothing
    ranked = common.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("held", "gram"))).withColumn("m", F.count("*").over(Window.partitionBy("node")))
    prefix = ranked.join(own.select("node", "n"), "node").filter(F.col("nth") <= F.col("m") + 1 - F.ceil(F.col("n") * percent / 100))
    marks = prefix.select(F.xxhash64("root", "gram").alias("sig"), F.col("node").alias("row"))
    near = marks.repartition("sig").sortWithinPartitions("sig", "row").mapInArrow(lean(_stars), "a long, b long").distinct()
    again = own.drop("root").join(_rooted(components(near)), "node")
    return cut(placed.join(large.select("root"), "root", "left_anti").unionByName(again))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 21, most_sets: int = 1 << 13, pairs: bool = True, carry: Column | None = None) -> Join:
    """The rows of docs with their links; every link between classes; and the classes' members.

    A text's set is that of its distinct width-word n-grams, A-Z in lower case;
    of fewer words, the whole sequence. Two texts link when 100 * intersection >=
    percent * union. component_id is the smallest id reachable by links, itself
    included; n_links is the number of other rows that a row links with, whether
    of its class (equal sets) or of a linked one. Null texts and texts without
    words have an empty set and link with nothing. Ids may be of any type that has
    an order; rows may repeat an id, with the same text or another, and each is a
    row by itself. Rows with a null id have a null component_id and link nothing.
    Other columns of docs are ignored. A search task holds `block` n-grams and
    `most_sets` sets of a side at about most. Without pairs, links has only as many
    as connect what is connected; n_links counts them all in either case. `carry`
    comes back with its row.
    """
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), (F.lit(None).cast("int") if carry is None else carry).alias("carry"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    sets = written(numbered.mapInArrow(lean(_sets(width, percent)), with_columns({"row": LongType(), "doc": rows.schema["doc"].dataType, "carry": rows.schema["carry"].dataType}, "n long, lo long, hi long, signatures array<long>")), "sets")
    met = F.when(F.col("signatures").isNotNull(), F.struct("row", "doc"))
    classes = sets.filter("n > 0 and doc is not null").groupBy("lo", "hi").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.count("*").alias("size"), F.min(met).alias("met"))
    classes = cut(classes.select("lo", "hi", "rep", "n", "size", F.col("met.row").alias("node"), F.col("met.doc").alias("doc")))

    marks = sets.filter("signatures is not null").select(F.explode("signatures").alias("sig"), "row")
    near = marks.repartition("sig").sortWithinPartitions("sig", "row").mapInArrow(lean(_stars), "a long, b long").distinct()
    placed = cut(classes.join(_rooted(components(near)), "node"))
    let_go(docs.sparkSession)
    large = cut(_sized(placed, block, most_sets).filter(F.col("blocks") > PAIRED))
    if large.count():
        placed = _split(rows, placed, large, width, percent)
        let_go(docs.sparkSession)
    totals = cut(_sized(placed, block, most_sets))
    everything, searched = totals.agg(F.coalesce(F.sum("grams"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    buckets = int(everything // (block // 2)) + 1
    small = F.col("blocks") == 1
    key = F.when(small, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "mine").alias("i"), F.greatest(x, "mine").alias("j"), (F.col("mine") <= x).alias("asks")))
    asked = placed.join(totals.select("root", "blocks"), "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    places = asked.select("doc", "lo", "hi", "node", F.struct(small.alias("small"), key.alias("key"), "size", meets.alias("meets")).alias("place"))
    held = _with_texts(rows, places, searched).select("text", "lo", "hi", "node", "place")
    grams = held.mapInArrow(lean(_grams(width)), with_columns({"node": LongType(), "place": places.schema["place"].dataType}, "grams binary"))
    tasks = grams.select("node", "grams", "place.small", "place.key", "place.size", F.explode("place.meets").alias("p")).select("node", "grams", "size", "small", "key", "p.i", "p.j", "p.asks")
    found = cut(tasks.groupBy("small", "key", "i", "j").applyInArrow(_search(percent, pairs), FOUND))

    links = found.filter("b is not null").select("a", "b")
    across = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("across"))
    linked = components(links)
    member = classes.join(_rooted(linked), "node")
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    linked_classes = member.join(least, "root").select("node", "least", "root")
    final = classes.join(linked_classes, "node", "left").join(across, "node", "left")
    # a row alone in its class and without links is its own component
    final = final.filter("size > 1 or least is not null").select("lo", "hi", F.coalesce("least", "rep").alias("least"), F.coalesce("root", "node").alias("root"), (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    plain = sets.select("row", "doc", "carry", "n", "lo", "hi")
    live = F.col("doc").isNotNull() & (F.col("n") > 0)
    out = plain.join(final, ["lo", "hi"], "left")
    out = out.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(live, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(live, F.coalesce("least", "doc")).otherwise(F.col("doc")).alias("component_id"), F.when(live, F.coalesce("root", "row")).otherwise(F.col("row")).alias("component_row"), "carry",
    )
    members = plain.filter(live).join(classes.select("lo", "hi", "node"), ["lo", "hi"]).select(F.col("node").alias("class"), F.col("doc").alias(id_col))
    return Join(out, links, members)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 21, most_sets: int = 1 << 13) -> DataFrame:
    """id, n_shingles, n_links and component_id of each row of docs: see jaccard_join."""
    return jaccard_join(docs, width, percent, id_col, text_col, block, most_sets, pairs=False).documents.drop("component_row", "carry")
