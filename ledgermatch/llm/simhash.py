"""Near-duplicate documents by SimHash, found with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that codes which differ in few bits come in long runs with
many bits in common. Runs of eight codes become leaves, runs of eight nodes upper nodes. A node
keeps the bits that all its codes share and that no node above it keeps already: a mask and the
bits under it. A search goes down from the top with all its queries at once, adds up the differing
bits under the masks, and leaves a whole group as soon as they are more than allowed.

To spread the index over tasks, it is built on four rotations of the fingerprints, by 0, 16, 32 and
48 bits. Codes at distance 3 or less agree on one of the four 16-bit quarters, so in one of the
rotations they hang below the same root node, which has the first bits of that quarter, as many as leave
a few hundred codes below it, 16 at most; other roots are left at the first difference. All roots of a task
are searched in one index. A root with many codes is dealt out as pairs of chunks, so that no task gets it whole.
Tasks return a spanning forest of the links they find instead of the links, at most one edge for each code.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.links import components
from ledgermatch.llm.textscan import as_bytes, map_rows
from ledgermatch.sources.rounds import RunFolder

#: Words of a shingle, seed of its hash, differing bits allowed.
SHINGLE = 3
SEED = 42
DISTANCE = 3

#: Codes below a root on average.
CROWD = 512

_FAN = 8
_QUARTER = 16


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes; no words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        h = np.fromiter((digest(x, SEED) for x in shingles), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` and ``fp``, the 64-bit fingerprint as a signed long, for every row. Null and
    empty texts get 0."""
    kinds = dict(docs.dtypes)

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        codes = np.array([fingerprint(x or b"") for x in as_bytes(batch.column("__text"))], np.uint64)
        return {c: batch.column(c) for c in carry} | {"fp": pa.array(codes.view(np.int64))}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "fp bigint"])
    return map_rows(docs.select(*carry, F.col(text).alias("__text")), make, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _first_of(groups: np.ndarray) -> np.ndarray:
    """Where each group of a sorted array begins."""
    return np.flatnonzero(np.diff(groups, prepend=-1))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


class GrayIndex:
    """Hierarchy over codes in Gray order, of one group or of several (``groups``: their numbers from 0 on, sorted)
    that have a part of their own each. ``levels[0]`` are the leaves; a level holds, for each node, the mask of
    bits it adds to those of the nodes above, their values, and which nodes or codes are below it.
    ``compared`` counts the codes that searches came down to."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray | None = None):
        self.codes, self.compared = codes, 0
        of = np.zeros(len(codes), np.int64) if groups is None else groups
        ones, zeros = codes, ~codes
        shared: list[tuple[np.ndarray, ...]] = []
        while True:
            first = _first_of(of)
            sizes = np.diff(first, append=len(of))
            if shared and (sizes <= _FAN).all():
                break
            cuts = np.flatnonzero((np.arange(len(of)) - np.repeat(first, sizes)) % _FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            shared.append((ones | zeros, ones, cuts, np.diff(cuts, append=len(of))))
            of = of[cuts]
        self.first, self.sizes = first, sizes
        self.levels = []
        for k, (mask, bits, starts, counts) in enumerate(shared):
            if k + 1 < len(shared):
                mask = mask & ~np.repeat(shared[k + 1][0], shared[k + 1][3])
            self.levels.append((mask, bits, starts, counts))

    def search(
        self, queries: np.ndarray, distance: int, groups: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries and of codes at most ``distance`` apart, each query in its group."""
        of = np.zeros(len(queries), np.int64) if groups is None else groups
        q, node = np.repeat(np.arange(len(queries)), self.sizes[of]), _spread(self.first[of], self.sizes[of])
        differ = np.zeros(len(q), np.uint8)
        for mask, bits, starts, counts in reversed(self.levels):
            differ = differ + np.bitwise_count((queries[q] ^ bits[node]) & mask[node])
            stay = differ <= distance
            q, node, differ = q[stay], node[stay], differ[stay]
            below = counts[node]
            q, differ, node = np.repeat(q, below), np.repeat(differ, below), _spread(starts[node], below)
        self.compared += len(q)
        near = np.bitwise_count(queries[q] ^ self.codes[node]) <= distance
        return q[near], node[near]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while not np.array_equal(up, nxt := parent[up]):
        up = nxt
    return up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each pair of ``a`` and ``b``; returns the roots of ``a``. A root is the
    smallest number of its set."""
    first = a
    while True:
        a, b = _roots(parent, a), _roots(parent, b)
        if not (apart := a != b).any():
            return _roots(parent, first)
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(groups: np.ndarray, codes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, code) that connect, within each group, what links of at most ``distance`` bits
    connect. ``groups`` are numbers without gaps in their order."""
    order = np.lexsort((gray_rank(codes), groups))
    groups, codes = groups[order], codes[order]
    parent = np.arange(len(codes))
    if len(codes):
        index = GrayIndex(codes, groups)
        # Queries at a time are so many that what is open at once stays small.
        open_at_once = np.cumsum(np.bincount(groups)[groups])
        at = 0
        while at < len(codes):
            before = open_at_once[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(open_at_once, before + (1 << 21), side="right")))
            q, found = index.search(codes[at:end], distance, groups[at:end])
            unite(parent, at + q, found)
            at = end
    top = _roots(parent, np.arange(len(codes)))
    child = np.flatnonzero(top != np.arange(len(codes)))
    return codes[child], codes[top[child]]


def root_bits(count: int) -> int:
    """Bits of a root, so that a root has about ``CROWD`` of ``count`` codes, a quarter at most."""
    return max(1, min(_QUARTER, (count // CROWD).bit_length() - 1))


def linked(codes: DataFrame, folder: RunFolder, distance: int = DISTANCE) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) whose components are those of
    all links. ``distance`` may be 3 at most, or a quarter could differ in all four rotations."""
    if not 0 <= distance <= 3:
        raise ValueError("four rotations find distances of 0 to 3")
    turn = F.explode(F.array(*(F.lit(k * _QUARTER) for k in range(4)))).alias("turn")
    code = F.expr("case when turn = 0 then fp else shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn) end")
    rows = codes.select("fp", turn).select("turn", code.alias("code"))
    count = codes.count()
    rows = rows.withColumn("root", F.shiftrightunsigned("code", 64 - root_bits(count)))
    # A root may have twice the rows of a mean task before it is dealt out.
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = min(1 << 18, max(2 * CROWD, 4 * count // tasks))
    hot = folder.scratch(rows.groupBy("turn", "root").count().where(F.col("count") > chunk))
    chunks = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")
    dealt = (
        rows.join(hot, ["turn", "root"], "left")
        .select("turn", "root", "code", chunks.alias("chunks"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .where("chunks = 1 or own <> other")
        .select(
            "turn",
            "code",
            F.struct("turn", "root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        )
    )
    dealt = dealt.select("turn", "code", F.xxhash64("cell").alias("cell")).repartition("cell")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        turn, code, cell = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(3))
        groups = np.unique(cell, return_inverse=True)[1]
        # Codes go through as they were rotated; all of a cell have the same turn.
        a, b, back = _forest_of(groups, code.view(np.uint64), turn, distance)
        a, b = (_turned_back(x, back).view(np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _forest_of(groups, codes, turns, distance):
    out = []
    for turn in np.unique(turns):
        at = turns == turn
        a, b = forest(np.unique(groups[at], return_inverse=True)[1], codes[at], distance)
        out.append((a, b, np.full(len(a), turn, np.uint64)))
    return (np.concatenate([x[k] for x in out]) for k in range(3))


def _turned_back(codes: np.ndarray, turns: np.ndarray) -> np.ndarray:
    turned = (codes >> turns) | (codes << ((np.uint64(64) - turns) % np.uint64(64)))
    return np.where(turns == 0, codes, turned)


def _roots_of(rows: DataFrame, folder: RunFolder, distance: int) -> DataFrame:
    """``fp`` and ``root``, the same fingerprint for all that links connect, of the column ``fp``."""
    classes = folder.scratch(rows.select("fp").distinct())
    roots = components(linked(classes, folder, distance), folder)
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE
) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the smallest doc_id
    that links of at most ``distance`` bits reach.

    Null and empty texts have fingerprint 0 and are linked like others. Of a long text all words are held at
    once, some 60 bytes each; shingles are hashed in pieces. Rows with a null doc_id are
    linked too; their component is null only if it holds no other id. Repeated rows each get their
    row. Other columns are not read.
    """
    folder = RunFolder(docs.sparkSession)
    rows = folder.scratch(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    roots = folder.scratch(_roots_of(rows, folder, distance))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(folder.scratch(ids), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: of each group of linked documents the
    one with the smallest doc_id stays. Ids decide with null last, then a hash of the text; of rows
    equal in both one stays."""
    folder = RunFolder(docs.sparkSession)
    key = F.xxhash64(doc_id, text)
    given = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = folder.scratch(fingerprints(given, carry=("key", "doc_id")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    best = rows.groupBy("fp").agg(first.alias("first"))
    best = best.join(_roots_of(rows, folder, distance), "fp").groupBy("root").agg(F.min("first").alias("first"))
    stay = best.select(F.col("first.key").alias("__key"))
    keyed = docs.withColumn("__key", key).join(stay, "__key", "left_semi")
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return keyed.withColumn("__turn", turn).where("__turn = 1").drop("__key", "__turn")
