"""Vectorised text kernels shared by the document operators.

Everything works on the Arrow buffers of a batch of texts: one flat byte array
and document offsets.  Hashes are polynomial over 64-bit words (wrapping), so
that the hash of any span follows from two prefix sums; they are mixed before
use.  Long spans of few different values have known collisions there (words of
the Thue-Morse kind), so that words of more than LONG bytes are hashed otherwise,
and nothing longer than two windows is hashed by a polynomial.  No function looks
at more than ``CHUNK`` bytes at once unless a single document is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
#: Tokens whose k-grams are compared at once (or one longer document).
BLOCK = 1 << 17
#: Bytes of a word beyond which it is hashed by blake2b.
LONG = 64
POSITION_BITS = 26
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of at most ``most`` bytes, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def texts(batch_column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) for each run of documents of a column."""
    raw, offsets = flat(batch_column)
    for i, j in chunks(offsets, most):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i in [0, n], modulo 2**64."""
    if 0 not in _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, CHUNK + 1024)
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if size > 8 * CHUNK:
            return both[0], both[1]
        _powers[0] = (both[0], both[1])
    return _powers[0]


class Spans:
    """Hashes of spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        p, self.inverse = powers(len(values))
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.multiply(values, p[: len(values)], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))

    def grams(self, k: int, first: int = 0, end: int | None = None) -> np.ndarray:
        """Hash of each k consecutive values of [first, end), by their start."""
        n = (len(self.sums) - 1 if end is None else end) + 1 - k
        return mix((self.sums[first + k : n + k] - self.sums[first:n]) * self.inverse[first:n]) if n > first else np.zeros(0, np.uint64)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all documents, and each document's first word (n + 1)."""
    edge = np.empty(len(raw) + 1, bool)
    inside = ~_SPACE[raw]
    edge[1:-1] = inside[1:] != inside[:-1] if len(raw) else False
    edge[0] = edge[-1] = False
    if len(raw):
        edge[0], edge[-1] = inside[0], inside[-1]
    starts_mask = edge[:-1] & inside
    ends_mask = edge[1:] & inside
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    if len(cuts):
        starts_mask[cuts] = inside[cuts]
        ends_mask[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_spans(raw: np.ndarray) -> Spans:
    return Spans(_TABLE[raw])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: Spans | None = None) -> np.ndarray:
    """Hashes of words or other spans of any length; ``spans``: those of ``raw``, if known."""
    out = (spans or byte_spans(raw)).hash(starts, ends)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = int.from_bytes(blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` has the bytes of its partner in ``b``: eight bytes of all at once, long ones by themselves."""
    n = a_ends - a_starts
    same = n == b_ends - b_starts
    for k in np.flatnonzero(same & (n > LONG)).tolist():
        same[k] = a[a_starts[k] : a_ends[k]].tobytes() == b[b_starts[k] : b_ends[k]].tobytes()
    x, y = _eights(a), _eights(b)
    rest = np.flatnonzero(same & (n > 0) & (n <= LONG))
    for at in range(0, LONG, 8):
        left = n[rest] - at
        differ = (x[a_starts[rest] + at] ^ y[b_starts[rest] + at]) & _FIRST[np.minimum(left, 8)] != 0
        same[rest[differ]] = False
        rest = rest[~differ & (left > 8)]
        if not len(rest):
            break
    return same


#: Masks of the first bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, a view of the bytes; zeros follow the end."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(16, np.uint8))), strides=(1,))


def numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, the same for equal bytes and for no others."""
    _, index, number = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    first = index[number]
    if equal_spans(raw, starts, ends, raw, starts[first], ends[first]).all():
        return number
    data, known = raw.tobytes(), {}
    return np.array([known.setdefault(data[x:y], len(known)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the position of its least one (the first of equals)."""
    most = (1 << POSITION_BITS) - width
    if len(grams) > most + width:  # pieces that overlap by a run less one: positions count from a piece's start
        return np.concatenate([owners(grams[i : i + most + width - 1], width) + i for i in range(0, len(grams) - width + 1, most)])
    if len(grams) < width:
        return np.zeros(0, np.int64)
    mask = U((1 << POSITION_BITS) - 1)
    best = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        rest = width - span
        best = np.minimum(best[:-rest], best[rest:])
    return (best & mask).astype(np.int64)


def owned_windows(spans: Spans, firsts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``window`` tokens that share their least k-gram.

    Returns the document of each run, its first and last window start and the
    position of the k-gram.  ``firsts``: each document's first token (n + 1).
    Equal windows have equal least k-grams at equal places, wherever they are.
    Documents are gone through by runs of at most BLOCK tokens, which stay in the processor's cache.
    """
    found = [(np.zeros(0, np.int64),) * 4]
    for i, j in chunks(firsts, BLOCK):
        lo, own = int(firsts[i]), firsts[i : j + 1] - firsts[i]
        owner = owners(spans.grams(k, lo, int(firsts[j])), window - k + 1)
        if not len(owner):
            continue
        ends = own[:-1] + np.maximum(np.diff(own) - window + 1, 0)  # behind each document's last window
        new = np.empty(len(owner), bool)
        new[0] = True
        new[1:] = owner[1:] != owner[:-1]
        for cuts in (own[:-1], ends):
            new[cuts[cuts < len(owner)]] = True
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(owner)) - 1
        document = np.searchsorted(own[:-1], at, "right") - 1
        inside = at < ends[document]
        at, last, document = at[inside], last[inside], document[inside]
        found.append((document + i, at + lo, last + lo, owner[at] + lo))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
