"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of a bounded sample of labelled text. A text is
parsed into phrases, each the longest match that continues in the automaton; the
language that needs the fewest phrases, normalised by the number of symbols and
the size of the sample (bits a symbol), wins. Texts are read whole. All stretches
of a batch walk the automaton together, one numpy gather a symbol; a walk goes on
beyond its stretch until it starts a phrase where the next one does, from where on
both are the same. The count of phrases is that of one parse from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashTable, lean, slices, with_columns

STRETCH = 256
ROOT = np.int64(1 << 32)  # states are kept with room for a symbol below
UNDETERMINED = "und"


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned: of each language the documents of least seeded hash, as many whole ones as `chars` characters hold; `languages` at most."""

    documents: int = 128
    chars: int = 30_000
    languages: int = 32
    seed: int = 7


def is_letter() -> np.ndarray:
    """For each code point: is it a letter? (general category L*)"""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def fold(text: str, letter: np.ndarray) -> np.ndarray:
    """Code points of the text in lower case, with each run of other characters than letters as one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    cp = np.where(letter[cp], cp, 32)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    return cp[keep]


class Automaton:
    """The suffix automaton of a sequence: its edges in a hash table of (state, symbol), three times the sequence at most. State 1 is the root."""

    def __init__(self, codes: np.ndarray):
        self.alphabet, seq = np.unique(codes, return_inverse=True)
        to, link, longest = [{}, {}], [0, 0], [0, 0]  # state 0 stays unused
        last = 1
        for c in (seq + 1).tolist():  # symbol 0 stands for all that the sequence lacks
            now = len(to)
            to.append({})
            longest.append(longest[last] + 1)
            link.append(1)
            p = last
            while p and c not in to[p]:
                to[p][c] = now
                p = link[p]
            if p:
                q = to[p][c]
                if longest[p] + 1 == longest[q]:
                    link[now] = q
                else:
                    copy = len(to)
                    to.append(dict(to[q]))
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    while p and to[p].get(c) == q:
                        to[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        edges = np.array([(s << 32 | c, t) for s, ways in enumerate(to) for c, t in ways.items()], np.int64).reshape(-1, 2)
        self.edges = HashTable(edges[:, 0], edges[:, 1] << 32, 0)  # keys are state << 32 | symbol
        self.size = len(seq)
        self.root = np.full(len(self.alphabet) + 1, ROOT)  # where a phrase's first symbol leads; back to the root where there is no way
        self.root[[*to[1]]] = np.fromiter(to[1].values(), np.int64) << 32

    def symbols(self, cp: np.ndarray) -> np.ndarray:
        known = np.zeros(int(self.alphabet[-1]) + 2, np.int32)
        known[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return known[np.minimum(cp, len(known) - 1)]

    def phrases(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of phrases of each text, of so many symbols each, one text after another."""
        end = np.cumsum(size)
        parts = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), parts)
        first = (np.cumsum(parts) - parts)[text]
        begin, limit = (end - size)[text], end[text]
        start = begin + (np.arange(len(text)) - first) * STRETCH
        begun = np.zeros(len(symbols), bool)  # phrases, by the walk in whose stretch they begin
        beyond, joins = np.zeros(len(text), np.int64), limit.copy()  # phrases a walk begins after its stretch; where it falls in with another
        walk, at, state, step = np.arange(len(text)), start.copy(), np.full(len(text), ROOT), 0
        while len(walk):
            c = symbols[at]
            to = self.edges.get(state | c)
            new = (state == ROOT) | (to == 0)
            on = np.ones(len(walk), bool)
            if step < STRETCH:
                begun[at[new]] = True
            else:
                on = ~(new & begun[at])
                joins[walk[~on]] = at[~on]
                beyond[walk[new & on]] += 1
            to[new] = self.root[c[new]]
            state, at = to, at + 1
            on &= at < limit[walk]
            if not on.all():
                walk, at, state = walk[on], at[on], state[on]
            step += 1
        # of each text the walks that its one parse follows: the first, and those fallen in with
        after = np.where(joins < limit, first + (joins - begin) // STRETCH, first + parts[text])
        followed = np.ones(len(text), bool)
        for k in np.flatnonzero(after > np.arange(len(text)) + 1).tolist():
            if followed[k]:
                followed[k + 1 : after[k]] = False
        k = np.flatnonzero(followed)
        came = np.where(k == first[k], start[k], np.concatenate([[0], joins[k[:-1]]])[: len(k)])
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(begun, dtype=np.int32)])
        count = total[np.minimum(start[k] + STRETCH, limit[k])] - total[came] + beyond[k]
        return np.bincount(text[k], weights=count, minlength=len(size)).astype(np.int64)


def learn(docs: DataFrame, sample: Sample, id_col: str, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """A bounded sample of folded text of each language, from rows of known language.

    Languages are counted first, so that a bound on the seeded hash leaves about
    twice the wanted rows of each; no task sorts more.
    """
    rows = docs.filter(docs[text_col].isNotNull() & docs[lang_col].isNotNull())
    rows = rows.select(docs[lang_col].alias("lang"), F.xxhash64(F.lit(sample.seed), docs[id_col]).alias("at"), docs[text_col].alias("text"))
    held = rows.groupBy("lang").count().limit(sample.languages + 1).collect()
    if len(held) > sample.languages:
        raise ValueError(f"more than {sample.languages} languages")
    if not held:
        return {}
    bound = [(r.lang, min(2**63 - 1, 2**65 * sample.documents // r["count"] - 2**63)) for r in held]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bound, "lang string, most long"))  # a row a language
    order = Window.partitionBy("lang").orderBy("at", "text")
    few = rows.join(bounds, "lang").filter("at <= most").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample.documents)
    fits = few.filter(F.length("text") <= sample.chars).withColumn("held", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = fits.filter(F.col("held") <= sample.chars).select("lang", "n", "text").collect()
    return sequences([(r.lang, r.text) for r in sorted(found, key=lambda r: (r.lang, r.n))])


def sequences(rows: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The languages' sequences: their texts one after another. Languages without a letter can't be told."""
    letter, out = is_letter(), {}
    for lang, text in rows:
        out.setdefault(lang, []).append(fold(text + " ", letter))
    return {k: x for k, v in out.items() if letter[x := np.concatenate(v)].any()}


def parse(texts: list[str | None], automata: dict[str, Automaton], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits a symbol of each text (row) in each language (column), and the number of letters of each text."""
    folded = [fold(t, letter) if t else np.zeros(0, np.uint32) for t in texts]
    letters = np.array([int((x != 32).sum()) for x in folded], np.int64)
    size = np.array([len(x) for x in folded], np.int64)
    flat = np.concatenate(folded) if len(folded) else np.zeros(0, np.uint32)
    bits = np.zeros((len(texts), len(automata)))
    for k, a in enumerate(automata.values()):
        if len(flat):
            bits[:, k] = a.phrases(a.symbols(flat), size) * np.log2(max(2, a.size)) / np.maximum(size, 1)
    return bits, letters


def identify(docs: DataFrame, learned_from: DataFrame, sample: Sample | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """Predicts each text's language: id, lang_pred, score (0 to 1, the winner's share by softmax).

    Only learned_from's texts and languages are learned from, rows of null text or
    language not; a text longer than the sample's characters is never sampled.
    With keep, all columns of docs come back too, and columns of docs named
    lang_pred or score are replaced. A text that is null or has no letter is "und"
    with score 0, as is every text where nothing could be learned. Ties go to the
    first language by name. Rows may repeat, and ids may be null. More languages
    than the sample allows raise.
    """
    spark = docs.sparkSession
    samples = learn(learned_from, sample or Sample(), id_col, text_col, lang_col)
    # built once, on the driver; some 200 bytes a sampled character, so bounded by Sample
    shared = spark.sparkContext.broadcast({k: Automaton(samples[k]) for k in sorted(samples)})
    names = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep else [id_col]
    place = names.index(text_col) if text_col in names else None

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch if place is None else batch.append_column("text", batch.column("row").field(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        letter, langs = is_letter(), [*automata]
        for part in slices(with_text(batches), "text", 1 << 20):
            bits, letters = parse(part.column("text").to_pylist(), automata, letter)
            if langs:
                best = bits.argmin(axis=1)
                share = np.exp(-4 * (bits - bits.min(axis=1, keepdims=True)))
                score = np.where(letters > 0, 1 / share.sum(axis=1), 0.0)
                pred = [langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist())]
            else:
                pred, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
            cols = [part.column("row"), pa.array(pred, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "lang_pred", "score"])

    # a text that comes back with its row goes to Python once
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *[docs[text_col].alias("text")] * (place is None))
    out = rows.mapInArrow(lean(run), with_columns({"row": rows.schema["row"].dataType}, "lang_pred string, score double"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "lang_pred", "score")
