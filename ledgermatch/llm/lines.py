"""Reversible line deduplication: sharded cuckoo filters over an exact table of reference counts.

The table counts, for each line key, the documents that hold it; inserting documents adds to the
counts and deleting them takes away again. Keys that reach the threshold enter the cuckoo filter of
their shard, keys that fall below it leave their filter, so the filters follow insertions and
deletions without a rebuild. Lines are dropped by filter: a compact set that goes to the tasks which
read the documents, whose texts are then never shuffled. What the filters say wrongly is exact
knowledge too: the few counted keys below the threshold that a filter holds by accident are listed
beside it, and lines with those keys stay.

The filters are broadcast only up to ``filter_bytes``. Beyond that, lines meet the exact table in a
join, with the same result.

Keys are identified by their 128-bit XXH3 hash.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm.textscan import as_bytes, map_rows, mix
from ledgermatch.sources.rounds import RunFolder

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
BUCKETS = 1 << 14
#: Keys of a shard at most, on average, before there are more shards: a load of 3 in 4.
SHARD_KEYS = BUCKETS * SLOTS * 3 // 4
FILTER_BYTES = 256 << 20


class CuckooFilter:
    """32-bit fingerprints in buckets of four. A key has two buckets, each computed from the other
    and the fingerprint, so that entries can move without their keys."""

    def __init__(self, table: np.ndarray | None = None, buckets: int = BUCKETS):
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = np.maximum(h2.astype(np.uint64) & np.uint64(0xFFFFFFFF), np.uint64(1))
        first = h1.astype(np.uint64) & np.uint64(len(self.table) - 1)
        return prints.astype(np.uint32), first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ (mix(np.asarray(prints, np.uint64)) & np.uint64(len(self.table) - 1))

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(h1, h2)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if there was no room; the filter is then to be built anew, over more shards."""
        prints, first, second = self.places(h1, h2)
        return all(self._insert(*x) for x in zip(prints, first, second, strict=True))

    def _insert(self, value: np.uint32, first: np.uint64, second: np.uint64) -> bool:
        for turn in range(500):
            for bucket in (first, second):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = value
                    return True
            slot = turn % SLOTS
            value, self.table[second, slot] = self.table[second, slot], value
            first, second = second, self.other(second, np.array([value], np.uint64))[0]
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out keys that are in the filter."""
        for value, first, second in zip(*self.places(h1, h2), strict=True):
            for bucket in (first, second):
                found = np.flatnonzero(self.table[bucket] == value)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break


def line_keys(data: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys: stripped at both ends, A-Z lower-cased."""
    lines = data.split(b"\n")
    return lines, [line.strip(BLANKS).lower() for line in lines]


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit halves for each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode()) >= least)


class Filters:
    """The filters of all shards and the keys that they hold by accident, as tasks use them."""

    def __init__(self, tables: list[bytes], exceptions: Iterable[tuple[int, int]] = ()):
        self.shards = [CuckooFilter.from_bytes(x) for x in tables]
        self.exceptions = set(exceptions)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        shard = shard_of(hashes[:, 0], len(self.shards))
        out = np.zeros(len(hashes), bool)
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            out[at] = self.shards[k].holds(hashes[at, 0], hashes[at, 1])
        if self.exceptions:
            for k in np.flatnonzero(out):
                out[k] = (int(hashes[k, 0]), int(hashes[k, 1])) not in self.exceptions
        return out


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """By the upper half of the hash; buckets go by the lower one."""
    return ((h1.astype(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


class LineIndex:
    """Counts and filters of the documents inserted so far, as written tables in the shared folder.

    ``threshold``: documents from which on a key's lines are dropped; ``least``: code points that a
    key has at least to be counted and dropped. A row is a document; repeated rows count apart. Null
    and empty texts are one empty line. Delete only documents that were inserted.
    """

    def __init__(
        self,
        spark: SparkSession,
        threshold: int,
        least: int = 1,
        text: str = "text",
        filter_bytes: int = FILTER_BYTES,
    ):
        self.folder = RunFolder(spark)
        self.spark, self.threshold, self.least, self.text = spark, threshold, least, text
        self.filter_bytes, self.shards = filter_bytes, 1
        self.counts = spark.createDataFrame([], "h1 bigint, h2 bigint, n bigint, before bigint")
        self.filters = self._empty_filters()

    def _empty_filters(self) -> DataFrame:
        blank = CuckooFilter().table.tobytes()
        rows = self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"))
        return rows.withColumn("table", F.lit(bytearray(blank)))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._count(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._count(docs, -1)

    def _count(self, docs: DataFrame, sign: int) -> LineIndex:
        least = self.least

        def make(batch: pa.RecordBatch) -> dict[str, object]:
            keys: list[bytes] = []
            for data in as_bytes(batch.column(0)):
                keys += {key for key in line_keys(data or b"")[1] if _long_enough(key, least)}
            pairs, n = np.unique(_hashes(keys), axis=0, return_counts=True)
            return {"h1": _signed(pairs[:, 0]), "h2": _signed(pairs[:, 1]), "n": pa.array(n.astype(np.int64))}

        new = map_rows(docs.select(self.text), make, "h1 bigint, h2 bigint, n bigint")
        both = self.counts.select("h1", "h2", "n", F.col("n").alias("before")).union(
            new.select("h1", "h2", F.lit(sign) * F.col("n"), F.lit(0))
        )
        summed = both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
        self.counts = self.folder.scratch(summed.where("n > 0 or before > 0"))
        self._follow()
        return self

    def _follow(self) -> None:
        """Bring the filters up to date with the counts."""
        hot = self.counts.where(F.col("n") >= self.threshold).count()
        enough = max(1, -(-hot // SHARD_KEYS))
        rebuild = enough > self.shards
        while not self._update(rebuild, max(enough, self.shards)):
            enough, rebuild = 2 * max(enough, self.shards), True

    def _update(self, rebuild: bool, shards: int) -> bool:
        enters, was = F.col("n") >= self.threshold, F.col("before") >= self.threshold
        if rebuild:
            self.shards, was = shards, F.lit(False)
            self.filters = self._empty_filters()
        number = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(self.shards)).cast("int").alias("shard")
        changes = self.counts.where(enters != was).select(number, "h1", "h2", enters.alias("enters"))

        def change(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            own = CuckooFilter.from_bytes(old["table"].iloc[0])
            h1, h2 = (keys[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
            into = keys["enters"].to_numpy().astype(bool)
            own.delete(h1[~into], h2[~into])
            fits = own.insert(h1[into], h2[into])
            return pd.DataFrame({"shard": old["shard"], "table": [own.table.tobytes()], "fits": [fits]})

        done = (
            changes.groupBy("shard")
            .cogroup(self.filters.groupBy("shard"))
            .applyInPandas(change, "shard int, table binary, fits boolean")
        )
        done = self.folder.scratch(done)
        if not done.where("fits").count() == self.shards:
            return False
        self.filters = done.select("shard", "table")
        return True

    def _shipped(self) -> Filters | None:
        """The filters with their exceptions, if they are small enough to go to all tasks."""
        if self.shards * BUCKETS * SLOTS * 4 > self.filter_bytes:
            return None
        tables = [bytes(r[0]) for r in self.filters.orderBy("shard").select("table").collect()]
        filters = self.spark.sparkContext.broadcast(Filters(tables))

        def make(batch: pa.RecordBatch) -> dict[str, object]:
            pairs = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(2)], axis=1)
            pairs = pairs[filters.value.holds(pairs)]
            return {"h1": _signed(pairs[:, 0]), "h2": _signed(pairs[:, 1])}

        rest = self.counts.where((F.col("n") < self.threshold) & (F.col("n") > 0)).select("h1", "h2")
        wrong = map_rows(rest, make, "h1 bigint, h2 bigint").limit(1 << 20).collect()
        if len(wrong) == 1 << 20:
            return None
        return Filters(tables, ((a % (1 << 64), b % (1 << 64)) for a, b in wrong))

    def drop(self, docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """A row for each row of ``docs``: columns ``carry``, ``n_lines``, ``n_dropped`` and ``kept``,
        the other lines joined by line feeds. ``docs`` must have been inserted."""
        filters = self._shipped()
        if filters is None:
            return self._drop_by_join(docs, carry)
        shared = self.spark.sparkContext.broadcast(filters)
        return self._rebuilt(docs, carry, lambda hashes, _: shared.value.holds(hashes))

    def _rebuilt(self, docs: DataFrame, carry: tuple[str, ...], dropped, extra: tuple[str, ...] = ()) -> DataFrame:
        kinds, least = dict(docs.dtypes), self.least

        def make(batch: pa.RecordBatch) -> dict[str, object]:
            texts = as_bytes(batch.column("__text"))
            split = [line_keys(data or b"") for data in texts]
            keys = [key for _, own in split for key in own]
            drop = dropped(_hashes(keys), batch) & np.array([_long_enough(key, least) for key in keys], bool)
            kept, n_lines, n_dropped, at = [], [], [], 0
            for lines, _ in split:
                own = drop[at : at + len(lines)]
                at += len(lines)
                n_lines.append(len(lines))
                n_dropped.append(int(own.sum()))
                kept.append(b"\n".join(line for line, gone in zip(lines, own, strict=True) if not gone))
            out = {c: batch.column(c) for c in carry}
            kept_column = pa.array(kept, pa.binary()).cast(pa.string())
            return out | {"n_lines": n_lines, "n_dropped": n_dropped, "kept": kept_column}

        schema = [*(f"`{c}` {kinds[c]}" for c in carry), "n_lines bigint", "n_dropped bigint", "kept string"]
        return map_rows(docs.select(*carry, F.col(self.text).alias("__text"), *extra), make, ", ".join(schema))

    def _drop_by_join(self, docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
        """The same by joins: lines with the exact table, and the keys found with the texts. Equal
        texts have equal lines, so the texts' hashes serve as their ids."""

        def make(batch: pa.RecordBatch) -> dict[str, object]:
            text, pairs = [], []
            for data in as_bytes(batch.column(0)):
                hashes = np.unique(_hashes(line_keys(data or b"")[1]), axis=0)
                pairs.append(hashes)
                text += [xxhash.xxh3_128_digest(data or b"")] * len(hashes)
            both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint64)
            return {"__id": text, "h1": _signed(both[:, 0]), "h2": _signed(both[:, 1])}

        lines = map_rows(docs.select(self.text), make, "__id binary, h1 bigint, h2 bigint").distinct()
        hot = self.counts.where(F.col("n") >= self.threshold).select("h1", "h2")
        found = lines.join(hot, ["h1", "h2"]).groupBy("__id").agg(F.collect_list(F.struct("h1", "h2")).alias("__hot"))
        kinds = dict(docs.dtypes)

        def name(batch: pa.RecordBatch) -> dict[str, object]:
            ids = [xxhash.xxh3_128_digest(data or b"") for data in as_bytes(batch.column(self_text))]
            return {c: batch.column(c) for c in batch.schema.names} | {"__id": ids}

        self_text = self.text
        columns = list(dict.fromkeys([*carry, self.text]))
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "__id binary"])
        named = map_rows(docs.select(*columns), name, schema).join(found, "__id", "left")

        def dropped(hashes: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            hot = [{(x["h1"], x["h2"]) for x in own or ()} for own in batch.column("__hot").to_pylist()]
            sizes = [len(line_keys(data or b"")[0]) for data in as_bytes(batch.column("__text"))]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            signed = hashes.view(np.int64)
            return np.array([tuple(map(int, h)) in hot[k] for h, k in zip(signed, owner, strict=True)], bool)

        return self._rebuilt(named, carry, dropped, ("__hot",))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))
