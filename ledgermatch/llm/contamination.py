"""Benchmark decontamination by winnowing.

Every text is a sequence of words. The hashes of all k-word grams are winnowed: of each window of
w = 13 - k + 1 consecutive grams the smallest hash is kept as fingerprint. A span of 13 words holds
one whole window of grams, so two texts that share such a span share that window's smallest hash:
no shared span of 13 words or more can be missed. Equal fingerprints of a document and an item are
then extended to the longest equal run on their diagonal, found by halving with hashes of spans and compared byte
by byte; runs of 13 words count. Places that a run covers are not extended again, so repetitive texts
cost as many steps as they have pairs of equal grams, not more.

An item of fewer than 13 words is one window as a whole: its single fingerprint is the hash of all
its words, looked up among the document's grams of the same length.

Items go to the tasks in blocks of a stated size (``block_bytes``), each a broadcast index; every
document is read once for each block and is never shuffled. One block holds a usual benchmark. A block takes
about five times its bytes in every Python worker.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.textscan import LETTERS, SpanHashes, Words, as_bytes, grams, map_rows, sliding_min
from ledgermatch.sources.rounds import RunFolder

WINDOW = 13
GRAM = 5
BLOCK_BYTES = 32 << 20
#: Pairs of equal grams of a document and an item that are looked at together.
PAIRS = 1 << 20


class Index:
    """Fingerprints of the items of one block."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)
        self.items: list[tuple[int | None, Words]] = []
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = Words(text, LETTERS)
            if len(words):
                self._add(len(self.items), words)
                self.items.append((item_id, words))
        self.texts: dict[int, _Text] = {}
        self.known = {n: np.array(sorted(at), np.uint64) for n, at in self.at.items()}
        self.at = {n: dict(at) for n, at in self.at.items()}

    def _add(self, k: int, words: Words) -> None:
        """Fingerprints by length of the window that they stand for."""
        n = len(words)
        if n < self.window:
            self.at[n][int(grams(words.hashes, n)[0])].append((k, 0))
            return
        hashes = grams(words.hashes, self.gram)
        for value in np.unique(sliding_min(hashes, self.window - self.gram + 1)):
            self.at[self.window][int(value)] += [(k, int(q)) for q in np.flatnonzero(hashes == value)]

    def spans(self, words: Words) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans of ``words`` that hold an item's window, and the numbers of those items."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        text = _Text(words)
        for n, known in self.known.items():
            if len(words) < n:
                continue
            hashes = grams(words.hashes, n if n < self.window else self.gram)
            kept = hashes if n < self.window else sliding_min(hashes, self.window - self.gram + 1)
            place = np.minimum(np.searchsorted(known, kept), len(known) - 1)
            for value in np.unique(kept[known[place] == kept]):
                here = np.flatnonzero(hashes == value)
                there: dict[int, list[int]] = defaultdict(list)
                for k, q in self.at[n][int(value)]:
                    there[k].append(q)
                for k, own in there.items():
                    if more := self._extended(text, here, self._text(k), np.array(own), n):
                        found = merged(found + more)
                        items.add(k)
        return found, items

    def _text(self, k: int) -> _Text:
        if k not in self.texts:
            self.texts[k] = _Text(self.items[k][1])
        return self.texts[k]

    def _extended(self, a: _Text, here: np.ndarray, b: _Text, there: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Runs of at least ``least`` equal words around equal grams, at ``here`` in ``a`` and ``there`` in ``b``.
        Of the places on one diagonal only the first that no run covers yet is extended."""
        found: list[tuple[int, int]] = []
        step = max(1, PAIRS // len(there))
        for at in range(0, len(here), step):
            p = np.repeat(here[at : at + step], len(there))
            q = np.tile(there, len(here[at : at + step]))
            order = np.lexsort((p, p - q))
            p, q = p[order], q[order]
            while len(p):
                diagonal = p - q
                head = np.flatnonzero(np.diff(diagonal, prepend=diagonal[0] - 1))
                right = _equal(a, p[head], b, q[head], np.minimum(len(a) - p[head], len(b) - q[head]), 1)
                left = _equal(a, p[head], b, q[head], np.minimum(p[head], q[head]), -1)
                long = np.flatnonzero((right > 0) & (left + right >= least))
                for k in long:
                    s, e, own = int(p[head[k]] - left[k]), int(p[head[k]] + right[k]), int(q[head[k]] - left[k])
                    if a.slice(s, e) == b.slice(own, own + e - s):
                        found.append((s, e))
                    elif span := self._extend(a.words, int(p[head[k]]), b.words, int(q[head[k]]), least):
                        found.append(span)
                sizes = np.diff(head, append=len(p))
                past = np.repeat(p[head] + np.maximum(right, 1), sizes)
                p, q = p[p >= past], q[p >= past]
            found = merged(found)
        return found

    def _extend(self, a: Words, p: int, b: Words, q: int, least: int) -> tuple[int, int] | None:
        """The longest run of equal words around gram ``p`` of ``a`` and gram ``q`` of ``b``, word by word."""
        left = right = 0
        while p + right < len(a) and q + right < len(b) and a.word(p + right) == b.word(q + right):
            right += 1
        while right and left < min(p, q) and a.word(p - left - 1) == b.word(q - left - 1):
            left += 1
        return (p - left, p + right) if right and left + right >= least else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "texts"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, texts={})


class _Text:
    """Words of a text, hashes of their spans and, once asked for, the words in one string."""

    def __init__(self, words: Words):
        self.words, self.spans = words, SpanHashes(words.hashes)

    def __len__(self) -> int:
        return len(self.words)

    @cached_property
    def joined(self) -> tuple[bytes, np.ndarray]:
        words, parts = self.words, []
        for at in range(0, len(words), 1 << 16):
            parts.append(b" ".join(map(words.word, range(at, min(at + (1 << 16), len(words))))))
        return b" ".join(parts), np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])

    def slice(self, start: int, end: int) -> bytes:
        data, places = self.joined
        return data[places[start] : places[end] - 1]


def _equal(a: _Text, p: np.ndarray, b: _Text, q: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words, ``most`` at most, are equal from ``p`` and ``q`` on (``way`` 1) or before them (-1), going by
    the hashes of spans, for all places at once by halving."""
    low, high = np.zeros(len(p), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        x = a.spans(p, p + middle) if way > 0 else a.spans(p - middle, p)
        y = b.spans(q, q + middle) if way > 0 else b.spans(q - middle, q)
        same = x == y
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in groups of about ``block_bytes``; one pass reads one group at a time."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r[0], r[1].encode()) for r in items.where(part == k).collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row for each row of ``docs``: its columns ``carry``, ``n_words``, ``n_hit``, ``spans`` (hit
    word spans, flattened start and end), ``items`` (ids of the items found) and ``n_items``.

    Null and empty texts have no words and no hits. Long texts are taken whole: spans and hashes of all words
    are held at once, 24 bytes a word. Repeated rows each get their row. Items without
    words match nothing; an item with a null id marks words but is not listed; an item given twice is
    listed once. An empty benchmark hits nothing. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    folder = RunFolder(spark)
    kinds = dict(docs.dtypes)
    fixed = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    state, first = docs.select(*carry, F.col(text).alias("__text")), True
    for items in _blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast(Index(items, window, gram))
        if not first:
            state = folder.scratch(state)
        state = _mark(state, index, carry, fixed, first)
        first = False
    return state.select(
        *carry,
        "n_words",
        "n_hit",
        "spans",
        "items",
        F.size("items").cast("long").alias("n_items"),
    )


def _mark(state: DataFrame, index, carry: tuple[str, ...], fixed: str, first: bool) -> DataFrame:
    """One block's hits, added to those of earlier blocks."""

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        block: Index = index.value
        out: dict[str, object] = {c: batch.column(c) for c in (*carry, "__text")}
        n_words, n_hit, spans, items = [], [], [], []
        old = None if first else (batch.column("spans").to_pylist(), batch.column("items").to_pylist())
        for k, data in enumerate(as_bytes(batch.column("__text"))):
            words = Words(data or b"", LETTERS)
            found, numbers = block.spans(words)
            ids = {block.items[n][0] for n in numbers} - {None}
            if old:
                flat = old[0][k]
                found = merged(found + list(zip(flat[::2], flat[1::2], strict=True)))
                ids |= set(old[1][k])
            n_words.append(len(words))
            n_hit.append(sum(e - s for s, e in found))
            spans.append([x for span in found for x in span])
            items.append(sorted(ids, key=str))
        return out | {"n_words": n_words, "n_hit": n_hit, "spans": spans, "items": items}

    schema = f"{fixed}, __text string, n_words bigint, n_hit bigint, spans array<bigint>, items array<bigint>"
    return map_rows(state, make, schema)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
