"""Line dedup by a sharded minimal perfect hash.

A first pass hashes the long lines of every document to 128 bits and counts the
documents of each hash. The distinct hashes that more than one document holds are
dealt to shards; each shard becomes a minimal perfect hash (levels of bit arrays,
the rank of a key's bit is its index) with arrays of fingerprints, counts and
keepers in its order. In a second pass the documents' lines probe these arrays,
whose counts decide.

Arrays of broadcast_bytes in all reach the documents by broadcast, and no line is
shuffled a second time. Larger ones stay where they are: the lines' hashes are
dealt to the shards, hot shards to several tasks, and what is to go comes back to
its document. No task holds more than a shard in that case, whatever their number.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, mix64, slices, with_columns, written

WS = b" \t\n\x0b\x0c\r"
GAMMA = 2


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: index() maps each to its own number below their number."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # size, bits, ones before each byte
        before, level = 0, 0
        while len(lo):
            size = max(64, GAMMA * len(lo) + 7 & ~7)
            at = self._at(lo, hi, level, size)
            single = np.bincount(at, minlength=size) == 1
            bits = np.packbits(single, bitorder="little")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))[:-1]]) + before
            self.levels.append((size, bits, ones))
            before += int(single.sum())
            lo, hi, level = lo[~single[at]], hi[~single[at]], level + 1
            if level > 200:
                raise ValueError("keys repeat")

    @staticmethod
    def _at(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix64(lo ^ salt ^ hi * np.uint64(level)) % np.uint64(size)).astype(np.int64)  # keys of equal lo part at the second level

    def index(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Each key's number; of other keys some number, or -1."""
        out, left = np.full(len(lo), -1, np.int64), np.arange(len(lo))
        for level, (size, bits, ones) in enumerate(self.levels):
            at = self._at(lo[left], hi[left], level, size)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8))
            out[left[hit]] = ones[at[hit] >> 3] + below[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class Shard:
    """Arrays in the order of a perfect hash."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        self.hash = PerfectHash(lo, hi)
        at = self.hash.index(lo, hi)
        self.fingerprint, self.count, self.keeper = np.empty_like(hi), np.empty(len(lo), np.uint32), np.empty(len(lo), np.int64)
        self.fingerprint[at], self.count[at], self.keeper[at] = hi, np.minimum(count, 2**32 - 1), keeper

    def probe(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: how many documents hold it (0: unknown here), and the one that keeps its lines."""
        at = self.hash.index(lo, hi)
        known = at >= 0
        known[known] = self.fingerprint[at[known]] == hi[known]
        count, keeper = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        count[known], keeper[known] = self.count[at[known]], self.keeper[at[known]]
        return count, keeper


def line_keys(text: str | None, min_chars: int) -> tuple[list[int], bytes]:
    """Numbers of the lines whose key has min_chars code points or more, and the 128-bit hashes of those keys."""
    from xxhash import xxh3_128_digest

    at, hashes = [], []
    for i, line in enumerate((text or "").encode().lower().split(b"\n")):  # lower() of bytes changes A-Z only
        if len(line) >= min_chars and len(key := line.strip(WS)) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            at.append(i)
            hashes.append(xxh3_128_digest(key))
    return at, b"".join(hashes)


def _halves(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])


def line_counts(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(hi, lo, n, keeper): each distinct line key, the number of documents that hold it, and the largest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lo, hi, ids = [], [], []
            for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                _, raw = line_keys(text, min_chars)
                if raw and doc is not None:
                    one = np.unique(np.frombuffer(raw, "<i8").reshape(-1, 2), axis=0)
                    lo.append(one[:, 0])
                    hi.append(one[:, 1])
                    ids.append(np.full(len(one), doc, np.int64))
            if lo:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hi, lo, ids)], names=["hi", "lo", "doc"])

    lines = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), "hi long, lo long, doc long")
    return lines.groupBy("hi", "lo").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, size, held, body): a perfect hash with its arrays for each shard of keys, their bytes, and the lines that they stand for."""

    def run(group: pa.Table) -> pa.Table:
        lo, hi = (np.asarray(group[x]).astype(np.int64).view(np.uint64) for x in ("lo", "hi"))
        n = np.asarray(group["n"])
        body = pickle.dumps(Shard(lo, hi, n, np.asarray(group["keeper"])), 5)
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "size": pa.array([len(body)], pa.int64()), "held": pa.array([int(n.sum())], pa.int64()), "body": pa.array([body], pa.binary())})

    return keys.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(run, "shard int, size long, held long, body binary")


#: Lines of one shard that a task probes at about most; a shard of more goes to several tasks.
LINES_PER_TASK = 1 << 20


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keys_per_shard: int = 1 << 18, broadcast_bytes: int = 64 << 20) -> DataFrame:
    r"""docs with repeated lines taken out of the text, and columns n_lines and n_dropped.

    A text's lines end at \n; a line's key is the line without ASCII white space
    at its ends and with A-Z in lower case. A key of min_chars code points or
    more that min_docs different ids hold loses all its lines, except in the
    largest of these ids. Null and empty texts have one empty line; a null text
    stays null. Ids are whole numbers. Rows with a null id count for no key but
    lose lines like others. Rows that repeat an id count as one document. Other
    columns stay as they are; columns of docs named n_lines or n_dropped are
    replaced.
    """
    spark = docs.sparkSession
    keys = cut(line_counts(docs, id_col, text_col, min_chars).filter("n > 1"))
    total = keys.count()
    shards = max(1, math.ceil(total / keys_per_shard))
    built = written(build_shards(keys, shards), "shards")
    weights = built.select("shard", "size", "held").collect()  # a row for keys_per_shard keys
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text_col)]
    n_lines = F.coalesce(F.length(docs[text_col]) - F.length(F.translate(docs[text_col], "\n", "")), F.lit(0)) + 1
    frame = docs.select(F.struct(*[docs[c] for c in rest]).alias("rest"), docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), n_lines.cast("long").alias("n_lines"))
    kind = with_columns({"rest": frame.schema["rest"].dataType}, "text string, n_lines long, n_dropped long")
    if sum(r.size for r in weights) <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r.shard: bytes(r.body) for r in built.select("shard", "body").collect()})
        done = frame.mapInArrow(lean(_probe(shared, shards, min_chars, min_docs)), kind)
    else:
        tasks = {r.shard: math.ceil(r.held / LINES_PER_TASK) for r in weights}
        frame = frame.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
        gone = _routed(frame, built, spark.sparkContext.broadcast(tasks), shards, min_chars, min_docs)
        same = frame["id"].eqNullSafe(gone["g_id"]) & (frame["t1"] == gone["g1"]) & (frame["t2"] == gone["g2"])
        done = frame.join(gone, same, "left").select("rest", "text", "n_lines", "gone").mapInArrow(lean(_without_lines), kind)
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*cols, "n_lines", "n_dropped")


def _to_go(shard: Shard, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, has_id: np.ndarray, min_docs: int) -> np.ndarray:
    """Which lines go: those whose key min_docs documents hold, in all of them but the keeper."""
    n, keeper = shard.probe(lo, hi)
    return (n >= min_docs) & ~(has_id & (keeper == doc))


def _lines(part: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, ...]:
    """Of each long line of the texts: its row, its number, the halves of its hash, its document's id, and whether it has one."""
    found = [line_keys(t, min_chars) for t in part.column("text").to_pylist()]
    counts = np.array([len(a) for a, _ in found])
    lo, hi = _halves(b"".join(h for _, h in found))
    row = np.repeat(np.arange(len(found)), counts)
    line = np.fromiter((i for a, _ in found for i in a), np.int64, int(counts.sum()))
    ids = part.column("id")
    return row, line, lo, hi, np.asarray(ids.fill_null(0)).astype(np.int64)[row], np.asarray(ids.is_valid())[row]


def _probe(shared, shards: int, min_chars: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {k: pickle.loads(v) for k, v in shared.value.items()}
        for part in slices(batches, "text"):
            row, line, lo, hi, doc, has_id = _lines(part, min_chars)
            shard = hi.view(np.int64) % shards
            drop = np.zeros(len(lo), bool)
            for k, s in arrays.items():
                at = np.flatnonzero(shard == k)
                drop[at] = _to_go(s, lo[at], hi[at], doc[at], has_id[at], min_docs)
            gone: list[list[int]] = [[] for _ in range(part.num_rows)]
            for r, i in zip(row[drop].tolist(), line[drop].tolist()):
                gone[r].append(i)
            yield _kept(part, gone)

    return run


def _routed(frame: DataFrame, built: DataFrame, tasks, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """(g_id, g1, g2, gone): the numbers of the lines to go, of each id and text (by hash) that loses some."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = np.ones(shards, np.int64)
        several[[*tasks.value]] = [*tasks.value.values()]
        for part in slices(batches, "text"):
            row, line, lo, hi, doc, has_id = _lines(part, min_chars)
            shard = hi.view(np.int64) % shards
            t1, t2 = (np.asarray(part.column(c))[row] for c in ("t1", "t2"))
            deal_to = (mix64(t1.view(np.uint64)) % several[shard].astype(np.uint64)).astype(np.int32)
            cols = [pa.array(shard.astype(np.int32)), pa.array(deal_to), part.column("id").take(pa.array(row)), pa.array(t1), pa.array(t2), pa.array(line.astype(np.int32)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "nth", "id", "t1", "t2", "line", "lo", "hi"])

    def probe(lines: pa.Table, arrays: pa.Table) -> pa.Table:
        if lines.num_rows and arrays.num_rows:
            lo, hi = (np.asarray(lines[c]).view(np.uint64) for c in ("lo", "hi"))
            ids = lines["id"]
            drop = _to_go(pickle.loads(arrays["body"][0].as_py()), lo, hi, np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), min_docs)
            lines = lines.filter(pa.array(drop))
        else:
            lines = lines.slice(0, 0)
        return pa.table({"id": lines["id"], "t1": lines["t1"], "t2": lines["t2"], "line": lines["line"]})

    lines = frame.select("id", "t1", "t2", "text").mapInArrow(lean(deal), "shard int, nth int, id long, t1 long, t2 long, line int, lo long, hi long")
    counted = F.greatest(F.lit(1), F.ceil(F.col("held") / LINES_PER_TASK)).cast("int")
    arrays = built.select("shard", F.explode(F.sequence(F.lit(0), counted - 1)).alias("nth"), "body")
    found = lines.groupBy("shard", "nth").cogroup(arrays.groupBy("shard", "nth")).applyInArrow(probe, "id long, t1 long, t2 long, line int")
    return found.groupBy(F.col("id").alias("g_id"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).agg(F.collect_set("line").alias("gone"))


def _kept(part: pa.RecordBatch, gone: list[list[int] | None]) -> pa.RecordBatch:
    """The rows of part without the lines that go."""
    text = part.column("text")
    if any(gone):
        text = pa.array([_without(t, g) if g else t for t, g in zip(text.to_pylist(), gone)], pa.string())
    dropped = pa.array([len(g or ()) for g in gone], pa.int64())
    return pa.RecordBatch.from_arrays([part.column("rest"), text, part.column("n_lines"), dropped], names=["rest", "text", "n_lines", "n_dropped"])


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        yield _kept(part, part.column("gone").to_pylist())


def _without(text: str, gone: list[int]) -> str:
    out = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
