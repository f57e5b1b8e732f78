"""Words of a UTF-8 text as numpy arrays: byte spans and 64-bit hashes, without a string per word.

A word's hash is a polynomial in its bytes modulo 2**64. Prefix sums give the hash of any span, of
bytes or of words, in constant time. Hashes find candidates; callers that need certainty compare
the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes scanned at a time; a text is cut only between words.
PIECE = 1 << 22

#: Rows of an Arrow batch that are worked on at a time, which bounds what a worker holds.
ROWS = 4096

_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.pairs = [(base, np.ones(1, np.uint64)), (pow(base, -1, 1 << 64), np.ones(1, np.uint64))]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs[0][1]) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for k, (base, _) in enumerate(self.pairs):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                self.pairs[k] = (base, np.multiply.accumulate(row))
        return self.pairs[0][1][:n], self.pairs[1][1][:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_GRAM)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)

#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

#: Bytes of words ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def prefix_sums(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a, out=out[1:])
    return out


class Words:
    """Spans ``[start, end)`` in bytes, and hashes, of the words of one text; also hashes of their first
    and last bytes (``heads``, ``tails``), as many as asked for, or of short words as a whole."""

    def __init__(
        self,
        data: bytes,
        inside: np.ndarray,
        lower: bool = True,
        heads: tuple[int, ...] = (),
        tails: tuple[int, ...] = (),
    ):
        self.data = data
        parts = [self._scan(a, at, inside, heads, tails) for at, a in _pieces(data, inside, lower)]
        self.starts, self.ends, self.hashes, *affixes = (
            (np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k])
            if parts
            else np.zeros(0, np.int64 if k < 2 else np.uint64)
            for k in range(3 + len(heads) + len(tails))
        )
        self.heads, self.tails = affixes[: len(heads)], affixes[len(heads) :]

    @staticmethod
    def _scan(
        a: np.ndarray, at: int, inside: np.ndarray, heads: tuple[int, ...], tails: tuple[int, ...]
    ) -> list[np.ndarray]:
        edges = np.zeros(len(a) + 2, np.int8)
        edges[1:-1] = inside[a]
        cuts = np.flatnonzero(np.diff(edges))
        starts, ends = cuts[::2], cuts[1::2]
        power, inverse = _BYTE_POWERS(len(a) + 1)
        sums = prefix_sums(_BYTE_VALUES[a] * power[: len(a)])

        def span(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            return (sums[e] - sums[s]) * inverse[s]

        affixes = [span(starts, np.minimum(starts + n, ends)) for n in heads]
        affixes += [span(np.maximum(ends - n, starts), ends) for n in tails]
        return [starts + at, ends + at, span(starts, ends), *affixes]

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].lower()


def _pieces(data: bytes, inside: np.ndarray, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    a = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(a):
        end = min(at + PIECE, len(a))
        while end < len(a) and inside[LOWER[a[end]]]:
            gap = np.flatnonzero(~inside[LOWER[a[end : end + PIECE]]])
            end = end + int(gap[0]) if len(gap) else min(end + PIECE, len(a))
        piece = a[at:end]
        yield at, LOWER[piece] if lower else piece
        at = end


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, mixed so that their order is as good as random."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    power, inverse = _WORD_POWERS(len(hashes) + 1)
    sums = prefix_sums(hashes * power[: len(hashes)])
    return mix((sums[n:] - sums[:-n]) * inverse[: len(hashes) - n + 1])


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words of each span, equal for equal words wherever they stand."""
    power, inverse = _WORD_POWERS(len(hashes) + 1)
    sums = prefix_sums(hashes * power[: len(hashes)])
    return (sums[ends] - sums[starts]) * inverse[starts]


class SpanHashes:
    """As :func:`span_hashes`, for many calls on the same words."""

    def __init__(self, hashes: np.ndarray):
        power, self.inverse = _WORD_POWERS(len(hashes) + 1)
        self.sums = prefix_sums(hashes * power[: len(hashes)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every ``n`` consecutive values."""
    have = 1
    while have < n and len(a):
        step = min(have, n - have)
        a = np.minimum(a[:-step], a[step:]) if len(a) > step else a[:0]
        have += step
    return a


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string column in UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """``df`` with every Arrow batch, a few thousand rows at a time, replaced by the columns that ``make``
    returns for it."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = make(batch.slice(at, ROWS))
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def _column(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)
