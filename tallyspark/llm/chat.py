"""Chat formatting by token-level assembly.

Each turn is assembled from segments that are encoded by themselves, between
reserved ids above the vocabulary:

    <turn>### Assistant:text</turn>
    <turn>### Role:any other role### Text:text</turn>

A loss mask over the tokens comes from prefix sums of the segments' lengths.
Reserved strings, and backslashes, that occur in a role or text are escaped with
a backslash before encoding, so that reading back is exact. The rows stay turns:
a conversation is its turns' tokens in order, and no task holds a whole one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .bpe import Bpe, load
from .common import lean, slices, with_columns

RESERVED = ("<turn>", "</turn>", "### System:", "### User:", "### Assistant:", "### Role:", "### Text:")
OPEN, CLOSE, ROLE, TEXT = 0, 1, 5, 6
ROLES = {"system": 2, "user": 3, "assistant": 4}
NAMES = {v: k for k, v in ROLES.items()}
_CONTROL = "|".join(map(re.escape, ("\\", *RESERVED)))
_ESCAPE, _UNESCAPE = re.compile(_CONTROL), re.compile(rf"\\({_CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def assemble(bpe: Bpe, turns: list[tuple[str | None, str | None]], loss_roles: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all (role, text) one after another, their loss mask, and where each turn begins and the last one ends. Null counts as empty."""
    first = len(bpe.token)
    texts = [part for role, text in turns for part in (escape(text or ""), "" if role in ROLES else escape(role or ""))]
    coded = bpe.encode_batch(texts)
    ids: list[int] = []
    lengths, flags = [], []  # of each segment: head, text, tail
    for i, (role, _) in enumerate(turns):
        text, other = coded[2 * i], coded[2 * i + 1]
        head = [first + OPEN, first + ROLES[role]] if role in ROLES else [first + OPEN, first + ROLE, *other, first + TEXT]
        ids += head
        ids += text
        ids.append(first + CLOSE)
        lengths += (len(head), len(text), 1)
        flags += (0, role in loss_roles, 0)
    ends = np.cumsum(np.array(lengths, np.int64))
    flag = np.array(flags, np.int8)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, ends - np.array(lengths, np.int64), flag)
    np.subtract.at(change, ends, flag)
    return np.array(ids, np.int32), np.cumsum(change[:-1]) > 0, np.concatenate([[0], ends[2::3]]).astype(np.int32)


def render(bpe: Bpe, ids: list[int]) -> str:
    """The formatted text of tokens."""
    first = len(bpe.token)
    return b"".join(RESERVED[x - first].encode() if x >= first else bpe.token[x] for x in ids).decode()


def characters(bpe: Bpe) -> np.ndarray:
    """Of each token and reserved id, the code points that begin in it: bytes that don't continue one."""
    return np.array([sum(x & 0xC0 != 0x80 for x in t) for t in [*bpe.token, *map(str.encode, RESERVED)]], np.int64)


def read_turn(bpe: Bpe, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
    """(role, text, text under the mask) of a turn's tokens."""
    first = len(bpe.token)
    marks = np.flatnonzero(ids >= first)
    words = lambda x: unescape(bpe.decode(x.tolist()).decode())
    kind = int(ids[1]) - first
    role = NAMES[kind] if kind in NAMES else words(ids[marks[1] + 1 : marks[2]])
    body = ids[marks[-2] + 1 : marks[-1]]
    text, said = words(body), ids[mask]
    return role, text, text if np.array_equal(said, body) else words(said)


def format_turns(rows: DataFrame, path: str, pattern: str, loss_roles: tuple[str, ...] = ("assistant",), columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """conv_id, turn, and the turn's ids (array<int>) and mask (array<boolean>), one row per row.

    A conversation's tokens are those of its rows by turn. Null roles and texts
    count as empty; null conversation ids and turns stay. Rows may repeat. Roles
    may be any string. Other columns of rows are ignored.
    """
    conv, turn, role, text = columns
    schema = with_columns({"conv_id": rows.schema[conv].dataType, "turn": rows.schema[turn].dataType}, "ids array<int>, mask array<boolean>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches, "text", 1 << 20):
            ids, mask, ends = assemble(bpe, [*zip(part.column("role").to_pylist(), part.column("text").to_pylist())], frozenset(loss_roles))
            ids, mask = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids, mask))
            yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("turn"), ids, mask], names=["conv_id", "turn", "ids", "mask"])

    return rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), rows[role].alias("role"), rows[text].alias("text")).mapInArrow(lean(run, "bpe"), schema)


def read_back(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests per conversation of what format_turns made, read from its tokens alone.

    conv_id; n_turns; turns_sha256 of role, \\n, text, \\n of each turn; loss_chars
    and loss_sha256 of the unescaped text under the mask; formatted_chars of the
    rendered conversation. Turns go by turn (nulls first), ties by their tokens.
    The rows of a conversation stream through one task in order, and only running
    digests are held. Rows of null conv_id are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        chars = characters(bpe)
        held = None  # conversation, turns, sha of turns, loss chars, sha of loss, chars

        def rows(found: list) -> pa.RecordBatch:
            cols = [[x[0] for x in found], [x[1] for x in found], [x[2].hexdigest() for x in found], [x[3] for x in found], [x[4].hexdigest() for x in found], [x[5] for x in found]]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            ids, mask = batch.column("ids"), batch.column("mask")
            ends = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            ids, mask = np.asarray(ids.flatten()), mask.flatten().to_numpy(zero_copy_only=False).astype(bool)
            total = np.concatenate([[0], np.cumsum(chars[ids])])
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if held is None or held[0] != conv:
                    done += [held] if held else []
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss = read_turn(bpe, ids[ends[i] : ends[i + 1]], mask[ends[i] : ends[i + 1]])
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                held[3] += len(loss)
                held[4].update(loss.encode())
                held[5] += int(total[ends[i + 1]] - total[ends[i]])
            if done:
                yield rows(done)
        if held:
            yield rows([held])

    schema = with_columns({"conv_id": turns.schema["conv_id"].dataType}, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids").mapInArrow(lean(run, "bpe"), schema)
