"""Words, lines and shingles of a batch of texts as numpy arrays over the batch's UTF-8 bytes.

A batch is cut into slices of whole texts of about ``SLICE`` bytes (a longer text is a slice of its own), so the
memory of a task follows its longest text and not its number of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import signature

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

# White space of the contracts (space and tab to carriage return) and the symbol characters.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def give_back() -> None:
    """Return freed memory to the system, since Spark keeps a worker, and what it holds, for the tasks after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def tidy(function: Callable) -> Callable:
    """The function of one group or batch, or of two, which gives its working memory back when it is done."""

    def one(value):
        out = function(value)
        give_back()
        return out

    def two(left, right):
        out = function(left, right)
        give_back()
        return out

    # Spark counts the arguments of the function that it is given
    return wraps(function)(one if len(signature(function).parameters) == 1 else two)


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


IS_WORD = ~byte_set(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection of xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_weights = np.empty(0, np.uint64)


def weights(n: int) -> np.ndarray:
    """A fixed random 64-bit weight for each of the first ``n`` positions of a string."""
    global _weights
    if len(_weights) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _weights[:n]


def hash_runs(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the consecutive non-empty byte strings of the given sizes."""
    if not len(sizes):
        return np.empty(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(first, sizes)
    parts = (data.astype(np.uint64) + np.uint64(1)) * weights(int(sizes.max()))[place]
    return mix(np.add.reduceat(parts, first) + sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class Texts:
    """Some whole texts: their bytes, and the bounds of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte for each text."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each word, size in bytes, hash), in order."""
        data = LOWER[self.data] if lower else self.data
        inside = IS_WORD[data]
        if not inside.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = self.bounds[:-1][self.bounds[:-1] < len(data)]
        opens[edges] = inside[edges]
        first = np.flatnonzero(opens)
        # word bytes before each word's start tell where the previous word ends
        inner = np.cumsum(inside)
        sizes = np.diff(np.append(inner[first] - 1, inner[-1]))
        of = np.searchsorted(self.bounds, first, side="right") - 1
        return of, sizes, hash_runs(data[inside], sizes)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each non-empty line, hash, whether it holds a word), in order; lines are split at newlines."""
        data = self.data
        body = data != 10
        if not body.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        opens = body.copy()
        opens[1:] &= ~body[:-1]
        edges = self.bounds[:-1][self.bounds[:-1] < len(data)]
        opens[edges] = body[edges]
        first = np.flatnonzero(opens)
        inner = np.cumsum(body)
        sizes = np.diff(np.append(inner[first] - 1, inner[-1]))
        held = np.add.reduceat(IS_WORD[data[body]].astype(np.int32), np.cumsum(sizes) - sizes) > 0
        of = np.searchsorted(self.bounds, first, side="right") - 1
        return of, hash_runs(data[body], sizes), held


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[Texts]:
    """Cut an Arrow string column (null: empty) into runs of whole texts, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield Texts(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def windows(of: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``width`` words that stays inside one text."""
    n = len(of) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(of[:n] == of[width - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k, weight in enumerate(weights(width)):
        total += hashes[first + k] * weight
    return first, mix(total)


def repeated(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (text, key) items in order: does the pair occur twice or more; is there an equal one before it."""
    pair = mix(keys + mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(pair, kind="stable")
    same = pair[order][1:] == pair[order][:-1]
    again = np.zeros(len(pair), bool)
    again[order[1:]] = same
    often = again.copy()
    often[order[:-1]] |= same
    return often, again
