"""Vectorised text primitives shared by the Python-side operators.

Everything works on the UTF-8 bytes of an Arrow column, a few megabytes at a time, so the memory of
a worker is bounded by CHUNK_BYTES (or by one document, if that is longer), whatever the batch size.
Word and n-gram hashes are polynomial sums modulo 2**64 over a random byte table, made independent of
their place by the inverse power, and finished with a bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_MASK = (1 << 64) - 1


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry mask that is true in the given inclusive byte ranges."""
    mask = np.zeros(256, bool)
    for low, high in spans:
        mask[low : high + 1] = True
    return mask


#: Everything but ASCII white space (0x20 and 0x09 to 0x0D).
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: Maps A-Z to a-z and keeps all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; works on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=8)
def _base(seed: int) -> tuple[int, int, np.ndarray]:
    rng = np.random.default_rng(seed + 0x5EED)
    base = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5 & _MASK
    return base, pow(base, -1, 1 << 64), rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's base and of its inverse, n of each; the last arrays are kept."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base, inverse, _ = _base(seed)
        size = max(n, 1 << 16)
        both = []
        for x in (base, inverse):
            p = np.full(size, x, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        have = _POWERS[seed] = (both[0], both[1])
    if n > 2 * CHUNK_BYTES:  # one huge document: don't keep its arrays
        _POWERS.pop(seed)
    return have


class Words:
    """The words of a run of documents.

    data: the chunk's bytes; starts, ends: byte bounds of each word; first: for each document the
    index of its first word, and one more entry for the end; row: index of the first document.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, row: int):
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        here = inside[1:-1]
        self.data, self.offsets, self.row = data, offsets, row
        self.starts = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """The document (from 0 in this chunk) of each word."""
        return np.repeat(np.arange(self.docs), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        n = len(self.data)
        power, inverse = _powers(seed, n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_base(seed)[2][self.data] * power[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(_U) * _U(0x9E3779B97F4A7C15))

    def text(self, i: int, j: int, sep: bytes = b" ") -> bytes:
        """Words i to j - 1, joined."""
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return sep.join([raw[a:b] for a, b in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist())])


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all k consecutive entries of h (across document bounds too: mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    base = _base(seed + 101)[0]
    if k <= 16:
        acc = h[:n].copy()
        for t in range(1, k):
            acc *= _U(base)
            acc += h[t : t + n]
        return mix(acc)
    power, inverse = _powers(seed + 101, len(h) + 1)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:n])


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive entries, in about log2(w) passes."""
    if len(g) < w:
        return g[:0]
    size, m = 1, g
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def inside_doc(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first n word places start k words that end in the same document."""
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= end


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is taken as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, table: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """The column's documents as Words, about `most` bytes at a time, never splitting a document."""
    data, offsets = utf8(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        yield Words(part if fold is None else fold[part], offsets[row : end + 1] - offsets[row], table, row)
        row = end
    relax()


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim.restype = ctypes.c_int
        return libc
    except (OSError, AttributeError):  # another C library
        return None


def relax() -> None:
    """Give freed memory back to the system: a worker waits for further tasks beside those that run."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
