"""Byte-level BPE over length-bucketed padded numpy matrices.

The pieces of a batch of texts are made distinct, laid out as rows of token ids
in matrices of similar length, and merged together: in each round every row
merges its leftmost pair of least rank. Ranks come from an open-addressing hash
table of token pairs; rows without a mergeable pair leave the matrix. A piece
that is itself a token is that token, as in the tiktoken library. Rows over
LONG bytes, whose rounds would cost the square of the length, are merged with a
heap over a linked list, to the same result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import KEPT, HashTable, lean, slices, with_columns

NONE = np.int32(2**31 - 1)
#: Code points that became letters or numbers after Unicode 16, the
#: version of the tiktoken library's tables; for the split they are unassigned.
NEWER_RANGES = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NEWER = re.compile("[" + "".join("-".join(re.escape(chr(int(x, 16))) for x in part.split("-")) for part in NEWER_RANGES.split()) + "]")
UNASSIGNED = "\u0378"
LONG = 192
#: Most pieces that a worker remembers between batches, and the longest such piece.
REMEMBERED, REMEMBERED_LENGTH = 120_000, 64


class Bpe:
    """A vocabulary of ranked byte strings, with numpy encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.token[r] = b
        self.split = regex.compile(pattern).findall
        self.text = [str(i) for i in range(len(self.token))]
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {}
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = r
        self.ranked = HashTable(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)), NONE)
        self.known: dict[str, tuple[int, ...]] = {}
        self.dictionary: dict[int, int] | None = None

    def pairs(self) -> dict[int, int]:
        """The table of pairs as a dictionary: only long rows look pairs up one by one."""
        if self.dictionary is None:
            used = np.flatnonzero(self.ranked.keys >= 0)
            self.dictionary = dict(zip(self.ranked.keys[used].tolist(), self.ranked.values[used].tolist()))
        return self.dictionary

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, NONE where they don't merge or one is padding (-1)."""
        return self.ranked.get((x.astype(np.int64) << 32 | y.astype(np.int64) & 0xFFFFFFFF).ravel()).reshape(x.shape)

    def _merge_rows(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        n, width = len(pieces), max(map(len, pieces))
        ids = np.full((n, width), -1, np.int32)
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids[np.arange(width) < size[:, None]] = flat
        rank = np.full((n, width), NONE, np.int32)  # rank[:, i] is of the pair at i, i + 1
        rank[:, :-1] = self.pair_rank(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(n), [()] * n
        while len(row):
            at = rank.argmin(axis=1)
            every = np.arange(len(row))
            least = rank[every, at]
            done = least == NONE
            if done.any():
                for k, i, x in zip(row[done].tolist(), size[done].tolist(), ids[done].tolist()):
                    out[k] = tuple(x[:i])
                on = ~done
                row, ids, rank, size, at, least = row[on], ids[on], rank[on], size[on], at[on], least[on]
                if not len(row):
                    break
                every = np.arange(len(row))
                width = int(size.max())
                ids, rank = ids[:, :width], rank[:, :width]
            ids[every, at] = least
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns > at[:, None])
            ids = np.take_along_axis(ids, source, 1)
            # the pair at `at` goes with the merge; those behind it move up
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), 1)
            size -= 1
            last = ids.shape[1] - 1
            after = np.where(at < last, ids[every, np.minimum(at + 1, last)], -1)
            rank[every, at] = self.pair_rank(ids[every, at], after)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pair_rank(ids[before, at[before] - 1], ids[before, at[before]])
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, pairs = [*range(1, n + 1)], [*range(-1, n - 1)], self.pairs()
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := pairs.get(r << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[after[i]]))
            if (k := before[i]) >= 0 and (s := pairs.get(ids[k] << 32 | r)) is not None:
                heapq.heappush(heap, (s, k, ids[k], r))
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """The token ids of distinct pieces, bucketed by length."""
        coded = [p.encode() for p in pieces]
        whole = list(map(self.ranks.get, coded))
        out = {p: (r,) for p, r in zip(pieces, whole) if r is not None}
        rest = [(len(b), b, p) for b, p, r in zip(coded, pieces, whole) if r is None]
        rest.sort(key=itemgetter(0))
        while rest and rest[-1][0] > LONG:
            _, b, p = rest.pop()
            out[p] = self._merge_long(b)
        k = 0
        while k < len(rest):
            top = max(rest[k][0] + 1, rest[k][0] * 5 // 4)
            stop = min(k + 8192, bisect_right(rest, top, key=itemgetter(0)))
            part = rest[k:stop]
            out.update(zip(map(itemgetter(2), part), self._merge_rows([b for _, b, _ in part])))
            k = stop
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.pieces(t) for t in texts]
        distinct = set(chain.from_iterable(split))
        new = distinct - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, distinct
        known = self.known
        known.update(self.encode_pieces([*new]))
        out = [list(chain.from_iterable(map(known.__getitem__, x))) for x in split]
        for p in new:
            if len(p) > REMEMBERED_LENGTH:
                del known[p]
        return out

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, each merged by itself."""
        if not text.isascii() and (NEWER.search(text)):
            out, at = [], 0
            for m in self.split(NEWER.sub(UNASSIGNED, text)):
                out.append(text[at : at + len(m)])
                at += len(m)
            return out
        return self.split(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


LOADED: dict[tuple[str, str], Bpe] = {}


def _forget(everything: bool) -> None:
    for x in LOADED.values():
        x.known, x.dictionary = {}, None
    if everything:
        LOADED.clear()


KEPT["bpe"] = _forget


def load(path: str, pattern: str) -> Bpe:
    """The vocabulary of a rank file: lines of a base64 token and its rank. Each Python worker reads it once."""
    if (path, pattern) not in LOADED:
        LOADED.clear()  # one at a time
        with open(path, "rb") as f:
            LOADED[path, pattern] = Bpe({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)
    return LOADED[path, pattern]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes its ids: one row per row of docs.

    n_tokens; ids_sha256 of the decimal ids joined by commas; decoded_sha256 of
    the bytes decoded from the ids; with with_ids also the ids themselves. A null
    text is an empty one: no ids. Ids may be null or repeat; other columns of docs
    are ignored. `path` names a rank file that is installed on every node.
    """
    schema = with_columns({id_col: docs.schema[id_col].dataType}, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches, "text", 1 << 20):
            counts, coded, decoded, all_ids = [], [], [], []
            for ids in bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]):
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(bpe.text.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            cols = [part.column("id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run, "bpe"), schema)
