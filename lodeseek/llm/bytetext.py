"""Words, hashes and shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What is worked on at once: bytes of text, and texts.
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 4096

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Words of letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: Words between white space: [^\x20\x09-\x0D].
SPACED = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: Spans of more bytes are hashed one at a time.
LONG = 256
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, size: int = BLOCK_BYTES, most: int = BLOCK_TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, of about `size` bytes; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, i + most, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield i, j
        i = j


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    w = inside[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start, stop = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | edge[1:n]
    stop[:-1] &= ~w[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, at)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span; A-Z count as a-z where `fold`.

    Eight bytes at a time are mixed into the state, for all spans at once; long spans go through BLAKE2.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = FOLD[data] if fold else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = e - s
    h = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + U(1))
    own, at, left = None, s, size
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(blake2b(padded[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
    while True:
        more = (left > 0) & (size <= LONG) if own is None else left > 0
        if not more.all():
            own = np.flatnonzero(more) if own is None else own[more]
            at, left = at[more], left[more]
        if not len(at):
            return h
        step = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        if own is None:
            h = mix(h ^ step)
        else:
            h[own] = mix(h[own] ^ step)
        at, left = at + 8, left - 8


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (one more at the end).

    A text of more than BLOCK_BYTES, which stands alone, is gone through in pieces cut between words.
    """
    if len(at) != 2 or len(data) <= BLOCK_BYTES:
        s, e, first = words(data, at, inside)
        return hash_spans(data, s, e), first
    got, low = [], 0
    while low < len(data):
        high = min(len(data), low + BLOCK_BYTES)
        while high < len(data):
            within = inside[data[high : high + BLOCK_BYTES]]
            high += len(within) if within.all() else int(np.argmin(within))
            if high < len(data) and not inside[data[high]]:
                break
        s, e, _ = words(data[low:high], np.array([0, high - low]), inside)
        got.append(hash_spans(data[low:high], s, e))
        low = high
    h = np.concatenate(got)
    return h, np.array([0, len(h)])


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (fewer words in a text: one run of all), and the texts they are in, ascending."""
    m = np.diff(first)
    count = np.where(m >= k, m - k + 1, (m > 0).astype(m.dtype))
    text = np.repeat(np.arange(len(m), dtype=np.int32), count)
    out = np.zeros(len(text), np.uint64)
    offset = np.repeat(first[:-1] - np.cumsum(count) + count, count)
    short = np.minimum(m, k)
    plain = bool((m[m > 0] >= k).all())
    for low in range(0, len(text), 1 << 19):  # so that temporaries stay small
        at = offset[low : low + (1 << 19)] + np.arange(low, min(low + (1 << 19), len(text)))
        part = out[low : low + (1 << 19)]
        n = None if plain else short[text[low : low + (1 << 19)]]
        for j in range(k):
            step = h[at + j] if plain else np.where(n > j, h[np.minimum(at + j, len(h) - 1)], U(0))
            part += step
            part *= U(0x9E3779B97F4A7C15 + 2 * j)
            part ^= part >> U(29)
        part += U(k) if plain else n.astype(np.uint64)
        out[low : low + (1 << 19)] = mix(part)
    return out, text


def distinct(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes distinct within each of n texts, sorted, and their number by text. `text` ascends; h is used up."""
    low = np.searchsorted(text, np.arange(n + 1)).tolist()
    for i in range(n):
        if low[i + 1] - low[i] > 1:
            h[low[i] : low[i + 1]].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
    return h, np.bincount(text, minlength=n)


class Lookup:
    """Positions of 64-bit hashes in a sorted array of distinct ones, through a table on their upper bits."""

    def __init__(self, keys: np.ndarray, spare: int = 2):
        self.keys, bits = keys, max(4, int(len(keys)).bit_length() + spare)
        self.shift = np.uint64(64 - bits)
        slots = (keys >> self.shift).astype(np.int64)
        self.low = np.searchsorted(slots, np.arange((1 << bits) + 1)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """1 + position, 0 where absent."""
        last = len(self.keys) - 1
        if last < 0:
            return np.zeros(len(h), np.int32)
        slot = (h >> self.shift).astype(np.int64)
        at = self.low[slot]
        out = np.minimum(at, last)
        same = self.keys[out] == h
        out += 1
        out[~same] = 0
        rest = np.flatnonzero(~same)
        at, high = at[rest] + 1, self.low[slot[rest] + 1]
        while len(rest):
            more = at < high
            rest, at, high = rest[more], at[more], high[more]
            same = self.keys[at] == h[rest]
            out[rest[same]] = at[same] + 1
            rest, at, high = rest[~same], at[~same] + 1, high[~same]
        return out


def tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each stands."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of tallies."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of numbers from all values and the length of each list."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of packed values from the number of values in each."""
    at = (np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize).astype(np.int64)
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
    return made.cast(pa.binary())
