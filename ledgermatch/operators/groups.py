"""Totals, running totals and neighbours within match groups, for groups of any size.

Groups that fit a task use plain windows over one hash partitioning on the match keys, so a whole
sequence of matching passes needs a single shuffle. Groups above a row limit are cut into chunks
of consecutive rows; each chunk is a window of its own and gets what came before it from a small table
of chunk totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.sources.rounds import RunFolder, at_size

# A group with more rows than this is cut into chunks.
HOT_ROWS = 1_000_000
# Amount levels of a chunked group are compared within bands of this many cents (or four
# tolerances, if that is more), which bounds the levels a task sees.
BAND_CENTS = 100_000
# Rows of a task that runs a stretch of passes, and of a chunk: every window of the stretch sorts them, some 4 KB a row in all.
TASK_ROWS = 200_000
# Rows are first counted in this many buckets of a hash of the keys: a group has no more rows than its bucket.
COUNT_BUCKETS = 1 << 14

ORDER = ("tran_date", "tran_gid")
CHUNK = "_chunk"


@dataclass(frozen=True)
class HotGroups:
    """Groups to cut: the table of their keys, and how many rows they have in all."""

    keys: DataFrame
    rows: int


def hot_groups(
    df: DataFrame, keys: Sequence[str], folder: RunFolder, hot_rows: int = HOT_ROWS, most: int | None = None
) -> HotGroups | None:
    """All groups with more than ``hot_rows`` rows, as a written table; None if there are none. Groups are
    counted only if some bucket of them (``most`` rows, if known) has more than that."""
    if (bucket_sizes(df, keys)[1] if most is None else most) <= hot_rows:
        return None
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    rows = large.agg(F.sum("_rows")).first()[0]
    if rows is None:
        return None
    return HotGroups(folder.scratch(large).drop("_rows"), rows)


def bucket_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in all, and rows of the largest bucket of keys, in one job that moves no keys."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS)).alias("_bucket")
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows"))
    rows, most = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    return rows or 0, most or 0


def split_by_size(
    df: DataFrame, keys: Sequence[str], folder: RunFolder, hot_rows: int = HOT_ROWS
) -> list[tuple[WindowGroups | ChunkedGroups, DataFrame]]:
    """The rows of small groups and of large ones, each with what works on them."""
    rows, most = bucket_sizes(df, keys)
    hot = hot_groups(df, keys, folder, hot_rows, most)
    if hot is None:
        return [(WindowGroups(keys, rows), df)]
    return [
        (WindowGroups(keys, rows - hot.rows), df.join(hot.keys, list(keys), "left_anti")),
        (ChunkedGroups(keys, hot, folder, hot_rows), df),
    ]


class WindowGroups:
    """Groups that fit one task each; ``rows`` of them in all."""

    def __init__(self, keys: Sequence[str], rows: int = 0):
        self.keys = list(keys)
        self.rows = rows

    def prepare(self, df: DataFrame) -> DataFrame:
        """Partitions are numbered by rows: those that Spark puts together by the bytes of the shuffle grow with the
        input until one of them, in the memory of all the windows on it, is too much for a task."""
        if self.rows <= TASK_ROWS:
            return df.repartition(*self.keys)
        least = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(max(math.ceil(self.rows / TASK_ROWS), least), *self.keys)

    def in_order(self, df: DataFrame, within: str) -> DataFrame:
        """Rows sorted once for windows over the keys, and over the keys and ``within`` in the order of rows."""
        return df.sortWithinPartitions(*self.keys, within, *ORDER)

    def totals(self, df: DataFrame, by: Sequence[str], sums: dict[str, Column], maxima: dict[str, Column]) -> DataFrame:
        """Add group sums and group maxima as columns."""
        group = Window.partitionBy(*by)
        columns = {n: F.sum(c).over(group) for n, c in sums.items()}
        columns |= {n: F.max(c).over(group) for n, c in maxima.items()}
        return df.withColumns(columns)

    def running(self, df: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
        """Add the total of ``value`` over the group's earlier rows."""
        return df.withColumn(name, _earlier(value, Window.partitionBy(*by).orderBy(*ORDER)))

    def ranks(self, df: DataFrame, by: Sequence[str], value: Column, name: str, sums: dict[str, Column]) -> DataFrame:
        """:meth:`running` over ``by`` and the side, whose sort order also serves the :meth:`totals` over ``by``."""
        return self.totals(self.running(df, [*by, "side"], value, name), by, sums, {})

    def neighbours(self, df: DataFrame) -> DataFrame:
        return _neighbours(df, self.keys)


class ChunkedGroups:
    """Groups cut into chunks; ``hot`` comes from :func:`hot_groups`.

    Every operation reads its rows more than once, so they are first written to the run's folder,
    the first one's by :meth:`prepare`; otherwise each operation would repeat all that came before it. Rows go from one
    operation to the next, and what they were before goes once they are written again.
    """

    def __init__(self, keys: Sequence[str], hot: HotGroups, folder: RunFolder, hot_rows: int = HOT_ROWS):
        self.keys = list(keys)
        self.hot = hot
        self.folder = folder
        self.hot_rows = hot_rows
        self._as_prepared = False
        self._own = folder.below()

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add the chunk of a row: its partition in the order (keys, date, id). Ids are unique, so
        partitions come out even however the rows spread over keys, dates and ids. Writing the
        rows fixes the numbers."""
        chunks = math.ceil(self.hot.rows / min(self.hot_rows, TASK_ROWS))
        rows = df.join(self.hot.keys, self.keys, "left_semi")
        placed = rows.repartitionByRange(chunks, *self.keys, *ORDER).withColumn(CHUNK, F.spark_partition_id())
        self._as_prepared = True
        return self._own.scratch(placed)

    def in_order(self, df: DataFrame, within: str) -> DataFrame:
        """Nothing to sort ahead: chunks are written between windows."""
        return df

    def ranks(self, df: DataFrame, by: Sequence[str], value: Column, name: str, sums: dict[str, Column]) -> DataFrame:
        """As :meth:`running` over ``by`` and the side, and :meth:`totals` over ``by``, which has more columns than the
        groups. Of what is left of the groups most fits a task; only the rest goes by way of chunks. Rows
        that have none of ``by`` get nothing."""
        df = self._written(df)
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in by])
        missing = {name: F.lit(0).cast("long")} | {n: F.lit(None).cast("long") for n in sums}
        result = df.filter(~known).withColumns(missing)
        for groups, part in split_by_size(df.filter(known), by, self._own, self.hot_rows):
            if isinstance(groups, ChunkedGroups):
                part = part.join(groups.hot.keys, list(by), "left_semi")
                # Some of the rows only: their tables do not stand for the others.
                groups = ChunkedGroups(self.keys, groups.hot, self._own, self.hot_rows)
            else:
                part = groups.prepare(part)
            part = groups.totals(groups.running(part, [*by, "side"], value, name), by, sums, {})
            result = result.unionByName(part)
        return result

    def totals(self, df: DataFrame, by: Sequence[str], sums: dict[str, Column], maxima: dict[str, Column]) -> DataFrame:
        """Group totals by way of chunk totals. They come back per chunk, so no single key of the
        join has many rows."""
        df = self._written(df)
        chunks = df.groupBy(*by, CHUNK).agg(
            *[F.sum(c).alias(n) for n, c in sums.items()],
            *[F.max(c).alias(n) for n, c in maxima.items()],
        )
        groups = chunks.groupBy(*by).agg(
            *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima]
        )
        per_chunk = chunks.select(*by, CHUNK).join(groups, list(by))
        return df.join(self._table(per_chunk, by), [*by, CHUNK], "left")

    def _written(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table, unless it still is the one written by :meth:`prepare`, with columns added."""
        if self._as_prepared:
            self._as_prepared = False
            return df
        before, self._own = self._own, self.folder.below()
        table = self._own.scratch(df)
        before.remove()
        return table

    def _table(self, per_chunk: DataFrame, by: Sequence[str]) -> DataFrame:
        """What chunks get. Of whole groups or their sides these are few rows, written so that Spark knows it and
        leaves the chunks where they are; of amounts they may be as many as the rows of the chunks."""
        return self._own.scratch(per_chunk) if {*by} <= {*self.keys, "side"} else at_size(per_chunk)

    def running(self, df: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
        df = self._written(df)
        totals = df.groupBy(*by, CHUNK).agg(F.sum(value).alias("_total"))
        earlier = _earlier(F.col("_total"), Window.partitionBy(*by).orderBy(CHUNK))
        carried = totals.select(*by, CHUNK, earlier.alias("_carried"))
        within = Window.partitionBy(*by, CHUNK).orderBy(*ORDER)
        return (
            df.withColumn(name, _earlier(value, within))
            .join(self._table(carried, by), [*by, CHUNK], "left")
            .withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0)))
            .drop("_carried")
        )

    def neighbours(self, df: DataFrame) -> DataFrame:
        """As for small groups, on distinct amounts, within overlapping amount bands. Rows with no amount left stay where
        they are."""
        df = self._written(df)
        keys = self.keys
        reach = (F.col("tolerance") * 200).cast("long")
        band = F.greatest(F.lit(BAND_CENTS).cast("long"), reach * 2)
        open_rows = df.filter(F.col("_left").isNotNull())
        levels = (
            open_rows.groupBy(*keys, "_left")
            .agg(F.min("side").alias("side"), F.min("_n").alias("_n"), F.max("tolerance").alias("tolerance"))
            .withColumns({"_reach": reach, "_width": band})
            .withColumns(
                {
                    "_own": F.floor(F.col("_left") / F.col("_width")),
                    "_band": F.explode(
                        F.sequence(
                            F.floor((F.col("_left") - F.col("_reach")) / F.col("_width")),
                            F.floor((F.col("_left") + F.col("_reach")) / F.col("_width")),
                        )
                    ),
                }
            )
        )
        found = (
            _neighbours(levels, [*keys, "_band"])
            .filter(F.col("_band") == F.col("_own"))
            .select(*keys, "_left", "_lo", "_lo2", "_hi", "_hi2")
        )
        chunks = open_rows.select(*keys, "_left", CHUNK).distinct()
        per_chunk = chunks.join(found, [*keys, "_left"])
        near = open_rows.join(at_size(per_chunk), [*keys, "_left", CHUNK], "left")
        return near.unionByName(df.filter(F.col("_left").isNull()), allowMissingColumns=True)


def _earlier(value: Column, ordered) -> Column:
    frame = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0))


def _neighbours(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the next lower and next higher amount of the group (``_lo``, ``_hi``: cents ``c``, side
    ``s``, rows ``n``), and their own next ones (``_lo2``, ``_hi2``: ``c2``, ``s2``)."""
    amount = F.col("_left")
    lower = Window.partitionBy(*by).orderBy(amount.asc()).rangeBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(*by).orderBy(amount.desc()).rangeBetween(Window.unboundedPreceding, -1)
    level = F.when(amount.isNotNull(), F.struct(amount.alias("c"), F.col("side").alias("s"), F.col("_n").alias("n")))

    def beyond(name: str) -> Column:
        return F.when(
            amount.isNotNull(),
            F.struct(amount.alias("c"), F.col(f"{name}.c").alias("c2"), F.col(f"{name}.s").alias("s2")),
        )

    return (
        df.withColumn("_lo", F.max(level).over(lower))
        .withColumn("_lo2", F.max(beyond("_lo")).over(lower))
        .withColumn("_hi", F.min(level).over(higher))
        .withColumn("_hi2", F.min(beyond("_hi")).over(higher))
    )
