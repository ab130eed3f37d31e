"""Vectorised text primitives over Arrow batches: words, hashes, lines, without a Python loop per word.

A chunk is a slice of a batch whose texts hold at most CHUNK_BYTES together; a longer
single text makes a chunk of its own, so no text is ever cut. All functions work
on the concatenated UTF-8 bytes of a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 19
#: Arrow batches that go to Python hold about so many bytes, on both sides of the pipe.
BATCH_BYTES = 4 << 20
U = np.uint64
#: White space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that continue a UTF-8 code point.
CONTINUES = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLDEN = 0x9E3779B97F4A7C15
#: The Mersenne prime 2**31 - 1; a product of two residues fits in 64 bits.
_P = (1 << 31) - 1


def through_python(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow in batches of bounded bytes: by default a batch is ten thousand rows or 64 MB, however many tasks share an
    executor. This is a setting of the session; no result depends on it."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**63."""
    x = (x & U(_P)) + (x >> U(31))
    x = (x & U(_P)) + (x >> U(31))
    return np.where(x >= U(_P), x - U(_P), x)


@lru_cache(maxsize=16)
def byte_codes(which: int, lower: bool = False) -> np.ndarray:
    """A random residue for each byte; with lower, A-Z have the codes of a-z."""
    codes = _residue(mix(np.arange(1 + 256 * which, 257 + 256 * which, dtype=U) * U(_GOLDEN)) >> U(1))
    return codes[LOWER] if lower else codes


#: Bases of the hashes: fixed residues drawn at random.
_BASES = (1_273_514_309, 934_012_877, 1_888_442_611, 527_900_041)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _rising(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of base, by doubling."""
    out = np.ones(1, U)
    while len(out) <= n:
        out = np.concatenate([out, _residue(out * U(pow(base, len(out), _P)))])
    return out


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least of a hash's base and of its inverse."""
    got = _powers.get(which)
    if got is None or len(got[0]) <= n:
        size = max(n, CHUNK_BYTES)
        got = _powers[which] = (_rising(_BASES[which], size), _rising(pow(_BASES[which], -1, _P), size))
    return got


class SpanHash:
    """62-bit hashes of any byte spans of one buffer: two polynomials modulo the prime 2**31 - 1, by prefix sums.

    A prime modulus has no strings that collide for every base, as a power of two has. salt gives an independent hash.
    """

    def __init__(self, data: np.ndarray, lower: bool = False, salt: int = 0):
        self.parts = []
        for which in (2 * salt, 2 * salt + 1):
            up, down = powers(which, len(data))
            x = byte_codes(which, lower)[data]
            x *= up[: len(data)]
            x = (x & U(_P)) + (x >> U(31))
            sums = np.zeros(len(data) + 1, U)
            np.cumsum(x, out=sums[1:])
            self.parts.append((sums, down))

    @staticmethod
    def _joined(values: list[np.ndarray], lengths) -> np.ndarray:
        return mix(((values[0] << U(32)) | values[1]) + np.multiply(lengths, U(0xA0761D6478BD642F), dtype=U))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span."""
        return self._joined([_residue(_residue(sums[end] - sums[start]) * down[start]) for sums, down in self.parts], (end - start).astype(U))

    def sliding(self, a: int, b: int, size: int) -> np.ndarray:
        """Hashes of all spans of size bytes within [a, b), in order."""
        n = max(b - a - size + 1, 0)
        return self._joined([_residue(_residue(sums[a + size : a + size + n] - sums[a : a + n]) * down[a : a + n]) for sums, down in self.parts], U(size))


@dataclass
class Chunk:
    """Texts of some rows: their bytes and the offsets of each text in them."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len+1 offsets into them; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of whole rows of at most limit text bytes, or of one longer text."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < len(offsets) - 1:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(offsets) - 1)
            own = offsets[first : last + 1]
            yield Chunk(batch.slice(first, last - first), data[own[0] : own[-1]], own - own[0])
            first = last


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n+1 offsets of each text's words among them."""
    inside = ~SPACE[chunk.data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(chunk.n + 1, np.int64)
    before = np.empty(len(inside) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[chunk.offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(inside) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    after[chunk.offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; empty stretches sum to 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each element, the index of the text that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(codes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size codes that stay within one text, and their n+1 offsets."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - size + 1, 0)
    own = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=own[1:])
    at = np.arange(own[-1]) + np.repeat(offsets[:-1] - own[:-1], counts)
    out = np.zeros(len(at), U)
    for k in range(size):
        out = mix(out * U(0xE7037ED1A0B428DB) + codes[at + k])
    return out, own
