"""Sentences of the treebank view over the arrays of an Arrow batch; the rules are those of ``plans.views.with_syntax``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arbolex.functions.labels import DEPREL, ROOT, UPOS
from arbolex.functions.lockstep import offsets

#: bytes of text that are worked on at once; a longer text stands alone
BYTES = 1 << 22

SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and where each begins and the last one ends."""
    strings = pc.fill_null(strings, "").cast(pa.large_string())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of so many bytes each."""
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets(sizes).buffers()[1]), pa.py_buffer(np.ascontiguousarray(data)))


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts with at most ``BYTES`` of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + BYTES, side="right")))
        yield start, end - start
        start = end


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The bytes of all texts and where each begins, where words begin in them, and the words."""
    data, ends = buffers(texts)
    space = SPACES[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = ~space[begins]
    letters = data[~space]
    sizes = np.diff(np.flatnonzero(first[~space]), append=len(letters))
    return data, ends, np.flatnonzero(first), strings(letters, sizes)


def sentences(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Row and number in its text of every sentence, and ``n, forms, upos, heads, deprels``.

    A line of a text is one or more sentences of at most ``size`` words, none where it has no word.
    """
    data, ends, starts, words = cut(texts)
    row = np.searchsorted(ends, starts, side="right") - 1
    line = np.cumsum(data == 10)[starts]
    at = np.arange(len(starts))
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(row) != 0) | (np.diff(line) != 0)
    place = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % size
    heads_of = np.flatnonzero(place == 0)
    n = np.diff(heads_of, append=len(starts))
    rows = row[heads_of]
    number = np.arange(len(rows)) - np.searchsorted(rows, rows)

    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    t, root = place + 1, np.repeat((n + 1) // 2, n)
    near = np.where(t < root, t + 1, t - 1)
    heads = np.where(t == root, 0, np.where(np.abs(root - t) % 3 == 1, root, near))
    deprels = np.where(t == root, ROOT, 2 + (5 * t + chars) % (len(DEPREL) - 1))
    upos = (7 * chars + t) % len(UPOS) + 1
    bounds = offsets(n)
    columns = {"n": pa.array(n.astype(np.int32))}
    columns["forms"] = pa.ListArray.from_arrays(bounds, words)
    for name, values in (("upos", upos), ("heads", heads), ("deprels", deprels)):
        columns[name] = pa.ListArray.from_arrays(bounds, pa.array(values.astype(np.int32)))
    return rows, number, columns
