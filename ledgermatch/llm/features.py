"""Hashed n-gram indicators of texts, samples of labelled documents, and what the classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.textscan import LETTERS, SOLID, Words, as_bytes, grams, map_rows, mix

BITS = 18
DIMENSIONS = 1 << BITS
#: Labelled documents that a classifier is fitted on at most.
SAMPLE = 8_000

_MISSING = np.zeros(0, np.int32)


def _ids(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Feature numbers of hashes of one kind."""
    return (mix(hashes + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)


def style_features(data: bytes) -> np.ndarray:
    """Distinct features of a whole text as written: words between blanks, pairs of them, their first
    four and last two bytes, pairs of endings, and whether a word is repeated at once."""
    words = Words(data, SOLID, lower=False, heads=(4,), tails=(2,))
    kinds = [words.hashes, grams(words.hashes, 2), *words.heads, *words.tails, grams(words.tails[0], 2)]
    again = words.hashes[1:][words.hashes[1:] == words.hashes[:-1]][:1] * np.uint64(0)
    return np.unique(np.concatenate([_ids(h, k) for k, h in enumerate([*kinds, again])]))


def word_features(data: bytes) -> np.ndarray:
    """Distinct features of a whole text, A-Z lower-cased: words of letters and digits, pairs of
    them, and their first four, five and six and last three bytes, as stems may be inflected."""
    words = Words(data, LETTERS, heads=(4, 5, 6), tails=(3,))
    kinds = [words.hashes, grams(words.hashes, 2), *words.heads, *words.tails]
    return np.unique(np.concatenate([_ids(h, k + 8) for k, h in enumerate(kinds)]))


def low_hashes(df: DataFrame, key: Column, size: int) -> DataFrame:
    """The rows of ``df`` with the lowest hashes ``key``, about twice ``size``: what a following
    ``orderBy(key).limit(size)`` has to gather then doesn't grow with the number of tasks."""
    rows = df.count()
    if rows <= 4 * size:
        return df
    return df.where(key < int((2 * size / rows) * 2.0**64) - (1 << 63))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], make, size: int = SAMPLE):
    """Labels and features of at most ``size`` labelled documents: those first by hash of their id, so
    any labels that the caller leaves in have the same chance. The labels of the sample, at most
    ``size`` rows, go to all tasks; documents are not shuffled.

    A document labelled twice has the greatest of its labels; of repeated documents one counts.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    known = known.dropna(subset=columns)
    order = F.xxhash64("doc_id")
    chosen = low_hashes(known, order, size).orderBy(order, "doc_id").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kinds = dict(rows.dtypes)

    def extract(batch: pa.RecordBatch) -> dict[str, object]:
        found = [make(x or b"").tolist() for x in as_bytes(batch.column("text"))]
        return {c: batch.column(c) for c in ("doc_id", *columns)} | {"features": found}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *columns)), "features array<int>"])
    rows = map_rows(rows, extract, schema).groupBy("doc_id").agg(F.min(F.struct(*columns, "features")).alias("x"))
    found = rows.select("doc_id", "x.*").toArrow()
    order = pc.sort_indices(found["doc_id"]).to_numpy()
    values = np.stack([found[c].to_numpy() for c in columns], axis=1).astype(np.float64)
    lists = found["features"].combine_chunks()
    return values[order], Rows(lists.flatten().to_numpy(), np.asarray(lists.offsets, np.int64)).take(order)


class Rows:
    """Sparse indicator rows: feature numbers of all rows on end, and where each row begins. Sums go over
    some rows at a time, so that they need little memory besides."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids, self.offsets = ids.astype(np.int32, copy=False), np.asarray(offsets, np.int64) - offsets[0]
        self.lengths = np.diff(self.offsets)

    def __len__(self) -> int:
        return len(self.lengths)

    def row(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]

    def take(self, at: np.ndarray) -> Rows:
        parts = [self.row(k) for k in at]
        return Rows(np.concatenate([_MISSING, *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))

    def _blocks(self) -> Iterator[slice]:
        for at in range(0, len(self), 256):
            yield slice(at, min(at + 256, len(self)))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for own in self._blocks():
            at = self.offsets[own.start : own.stop + 1]
            sums = np.concatenate([[0.0], np.cumsum(weights[self.ids[at[0] : at[-1]]], dtype=np.float64)])
            out[own] = np.diff(sums[at - at[0]])
        return out

    def back(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (one for each row) by feature."""
        out = np.zeros(DIMENSIONS)
        for own in self._blocks():
            ids = self.ids[self.offsets[own.start] : self.offsets[own.stop]]
            np.add.at(out, ids, np.repeat(values[own], self.lengths[own]))
        return out


def folds(n: int, k: int) -> np.ndarray:
    """Fold of each row: in turn, so that folds differ by one row at most."""
    return np.arange(n) % k


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(doc_id: Column, folds_of: int = 5) -> Column:
    """Documents whose labels are never learnt: crc32 of the id as text leaves no rest."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds_of == 0, F.lit(False))
