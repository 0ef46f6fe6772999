"""Vectorised work on Arrow text buffers: words, hashes, shingles and lockstep automaton walks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets from 0; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of whole rows of about ``most`` bytes of text, so working memory is bounded by it or by one text."""
    _, at = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _ODD), ("down", _INV)):
            out = np.full(size, base, _U)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _tables[name] = out
    return _tables["up"], _tables["down"]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each space-separated word, and the offsets of each text's words."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    if "letters" not in _tables:
        _tables["letters"] = mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
    inside = data != 32
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_tables["letters"][data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, at)


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``size`` words, and the index of its text.

    A text of 1 to ``size`` - 1 words has one shingle, all its words; a text of none has none.
    """
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), counts)
    out, of = np.zeros(0, _U), np.zeros(0, np.int64)
    if len(words) >= size:
        n = len(words) - size + 1
        total = np.zeros(n, _U)
        for k in range(size):
            total = (total ^ words[k : k + n]) * _U(_ODD) + (total >> _U(32))
        whole = text[:n] == text[size - 1 :]
        out, of = mix(total[whole]), text[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        total = np.full(len(short), size, _U)
        for k in range(size - 1):
            has = counts[short] > k
            w = words[np.minimum(at[short] + k, len(words) - 1)]
            total = np.where(has, (total ^ w) * _U(_ODD) + (total >> _U(32)), total)
        out, of = np.concatenate([out, mix(total)]), np.concatenate([of, short])
    return out, of


def walk(moves: np.ndarray, width: int, shift: int, classes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, root: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Run a complete automaton over many byte ranges in lockstep.

    ``moves[state * width + class]`` holds ``(next_state * width) << shift | output``. Returns the sum
    of outputs and the last state of each range. Ranges are sorted by size, so those that have ended
    drop off the end of the working arrays.
    """
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    total, state = np.zeros(len(at), np.int64), np.full(len(at), root * width, np.int64)
    low = (1 << shift) - 1
    longest = int(left[0]) if len(left) else 0
    live = len(left) - np.searchsorted(left[::-1], np.arange(longest), "right")
    for i in range(longest):
        n = live[i]
        v = moves[state[:n] + classes[data[at[:n] + i]]]
        total[:n] += v & low
        state[:n] = v >> shift
    back = np.empty(len(at), np.int64)
    back[order] = np.arange(len(at))
    return total[back], state[back] // width


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys`` in batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), n]
        if held and tuple(c[0] for c in cols) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:]):
            held.append(batch.slice(a, b - a))
            if b < n:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
