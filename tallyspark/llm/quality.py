"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths measure, for each document, the share
of its word characters inside n-grams that occur twice or more in it, and inside
lines that repeat an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import ASCII_WS, lean, mix64, slices, with_columns

SYMBOLS = b"#*$%&|<>"
BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that powers of it stay invertible mod 2**64


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict: the largest share of word characters inside repeated n-grams, and inside repeated lines."""

    ngram_share: dict[int, float] = field(default_factory=lambda: {3: 0.60, 5: 0.45, 8: 0.42, 10: 0.40})
    line_share: float = 0.30
    min_words: int = 20
    repeat_window: int = 8
    repeat_percent: int = 30


def _covered(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, n: int, power: dict[int, np.ndarray], exact: bool) -> np.ndarray:
    """Mask of the words inside windows of n words that occur twice or more in their document."""
    total = len(ids)
    if total < n:
        return np.zeros(total, bool)
    rolled = power[n]
    fits = np.arange(total - n + 1) + n <= end[: total - n + 1]
    at = np.flatnonzero(fits)
    key = mix64(rolled[at] ^ mix64(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if exact and same.any():
        a, b = at[order[1:][same]], at[order[:-1][same]]
        ok = doc[a] == doc[b]
        for j in range(n):
            ok &= ids[a + j] == ids[b + j]
        same[np.flatnonzero(same)] = ok
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(total + 1, np.int64)
    change[at[twice]] += 1
    change[at[twice] + n] -= 1
    return np.cumsum(change[:-1]) > 0


def _rolled(values: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all windows of each length; the hash of a window of n+1 words rolls on from that of n."""
    out, now = {}, values.copy()
    for n in range(2, max(lengths) + 1):
        now = now[:-1] * BASE + values[n - 1 :] if len(now) > 1 else now[:0]
        if n in lengths:
            out[n] = now
    return out


def measure(texts: list[str | None], rules: QualityRules) -> dict[str, np.ndarray]:
    """The measures of some texts, each text by itself. A null text has no words and no lines."""
    raw = [(t or "").encode() for t in texts]
    words: list[bytes] = []
    counts = np.zeros(len(raw), np.int64)
    for i, b in enumerate(raw):
        w = b.split()  # bytes split at ASCII white space only
        counts[i] = len(w)
        words += w
    total, m = len(words), len(raw)
    doc = np.repeat(np.arange(m), counts)
    code = dict(zip(dict.fromkeys(words), range(total)))
    ids = np.fromiter(map(code.__getitem__, words), np.int64, total)
    size = np.fromiter((len(w.decode()) for w in code), np.int64, len(code))[ids] if total else np.zeros(0, np.int64)
    end = np.repeat(np.cumsum(counts), counts)
    lengths = sorted({rules.repeat_window, *rules.ngram_share})
    rolled = _rolled(mix64(ids.astype(np.uint64)), lengths)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=m).astype(np.int64)
    chars = per_doc(size)
    out = {"n_words": counts, "word_chars": chars}
    out["n_symbols"] = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], np.int64)
    dup_lines, line_chars, dup_chars = np.zeros((3, m), np.int64)
    for i, t in enumerate(texts):
        seen = set()
        for line in (t or "").split("\n"):
            if not line.strip(ASCII_WS):
                continue
            line_chars[i] += len(line)
            if line in seen:
                dup_lines[i] += 1
                dup_chars[i] += len(line)
            seen.add(line)
    out["n_dup_lines"] = dup_lines
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    passed = np.ones(m, bool)
    for n in lengths:
        inside = _covered(ids, doc, end, n, rolled, exact=n == rules.repeat_window)
        if n == rules.repeat_window:
            out["n_repeat_words"] = per_doc(inside)
        if n in rules.ngram_share:
            part = share(per_doc(inside * size), chars)
            out[f"dup_{n}gram_share"] = part
            passed &= part <= rules.ngram_share[n]
    out["dup_line_share"] = share(dup_chars, line_chars)
    passed &= out["dup_line_share"] <= rules.line_share
    out["base_failed"] = (counts < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * counts)
    out["kept"] = passed & ~out["base_failed"]
    return out


def repetition_quality(docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, counts, shares, base_failed and kept.

    A null text counts as no text (no words, so base_failed). Texts of any length
    are measured whole. Repeated rows give repeated results; a null id is kept.
    Columns of docs other than the two named are ignored, whatever their names.
    An empty table gives an empty result.
    """
    rules = rules or QualityRules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [f"dup_{n}gram_share" for n in sorted(rules.ngram_share)] + ["dup_line_share"]
    schema = ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, " + ", ".join(f"`{x}` double" for x in shares)
    schema = with_columns({id_col: docs.schema[id_col].dataType}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            got = measure(part.column("text").to_pylist(), rules)
            cols = [part.column("id")] + [pa.array(got[x]) for x in [*names, "base_failed", "kept", *shares]]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *names, "base_failed", "kept", *shares])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema)
