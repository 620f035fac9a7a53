"""Vectorised passes over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; arrays of eight bytes a position follow from it.
SLICE_BYTES = 1 << 20

_LIBC = ctypes.CDLL(None)
_kept: dict[str, object] = {}
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_BASE = U(0xD1342543DE82EF95)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _wrap(x: int) -> np.uint64:
    return U(x & 0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) for runs of rows of about ``limit`` bytes.

    ``bounds`` has one entry more than rows, relative to ``bytes``.  A longer row comes
    alone and whole.  A null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def tidy() -> None:
    """Give memory that Arrow and the C library hold for reuse back to the system; a worker's next task may be of another stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def keep(name: str, make: Callable[[], object]) -> object:
    """What a worker holds from one task to the next under ``name``, made when first asked for."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drop what earlier tasks of other stages left in this worker: Spark hands workers on from stage to stage."""
    if _kept or len(_powers[0]) > 1:
        _kept.clear()
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        tidy()


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and where each row's words begin (n + 1 entries)."""
    solid = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    fresh, closed = solid.copy(), solid.copy()
    fresh[1:] &= ~solid[:-1] | cut[1:-1]
    closed[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(closed) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one prefix sum over the bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive hashes (shorter by width - 1)."""
    n = len(hashes) - width + 1
    total = np.full(max(n, 0), _wrap(width * int(_MULT)), np.uint64)
    for k in range(width):
        total += mix64(hashes[k : k + n] + _wrap((k + 1) * int(_MULT))) * _wrap((2 * k + 1) * int(_BASE))
    return mix64(total)


class Counts:
    """Running totals of 64-bit keys, merged whenever the pending ones outgrow the merged."""

    def __init__(self) -> None:
        self.keys, self.totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, totals: np.ndarray) -> None:
        self.pending.append((keys, totals))
        self.waiting += len(keys)
        if self.waiting > (1 << 20) + len(self.keys):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.pending)])
        totals = np.concatenate([self.totals, *(t for _, t in self.pending)])
        order = np.argsort(keys, kind="stable")
        keys, totals = keys[order], totals[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[heads]
        self.totals = np.add.reduceat(totals, heads) if len(heads) else totals
        self.pending, self.waiting = [], 0
        return self.keys, self.totals


class Lookup:
    """Values of 64-bit keys by open addressing, added and looked up a whole array at a time.

    ``room`` is how many keys it will hold in all, if more than the first ones.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0) -> None:
        bits = max(4, int(2 * max(len(keys), room) + 1).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.full = np.zeros(1 << bits, bool)
        self.values = np.zeros(1 << bits, values.dtype)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in yet."""
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(~self.full[slot])
            # Of those that want the same free slot, the last written gets it.
            self.values[slot[free]], self.keys[slot[free]], self.full[slot[free]] = values[left[free]], keys[left[free]], True
            won = self.keys[slot] == keys[left]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        slot = self._slot(keys)
        found = self.full[slot] & (self.keys[slot] == keys)
        out = np.where(found, self.values[slot], default)
        open_ = np.flatnonzero(~found & self.full[slot])
        at = slot[open_]
        while len(open_):
            at = (at + 1) & self.mask
            hit = self.full[at] & (self.keys[at] == keys[open_])
            out[open_[hit]], found[open_[hit]] = self.values[at[hit]], True
            more = ~hit & self.full[at]
            open_, at = open_[more], at[more]
        return out, found
