"""Commits as a log of changes beside the tables they started from.

A run changes few rows of tables that grow for years. Its delta holds what it moved to the matched trans, open
trans and breakups that are not as they were, and its KOs; reading merges the tables with the deltas in
order, and from time to time :meth:`DeltaLog.compact` writes the tables anew. A delta counts once its mark, an
empty file named after its number, is there, which is the last thing that is written.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.operators.state import ko_tables, state_split
from ledgermatch.plans.matching import all_lines
from ledgermatch.sources.ledger import Ledger

#: Parts of a delta: trans that are matched now, open trans and breakups that changed, new KOs.
MOVED, CHANGED, BREAKUPS, KOS, LINES = "moved", "changed", "breakups", "kos", "lines"


def changed_rows(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` that are in ``before`` under the same key, with other values."""
    values = [c for c in after.columns if c != key]
    held = before.select(F.col(key).alias("_key"), F.struct(*values).alias("_held"))
    same = F.struct(*values).eqNullSafe(F.col("_held"))
    return after.join(held, F.col(key) == F.col("_key")).filter(~same).select(*after.columns)


class DeltaLog:
    """Deltas of ``base`` below ``folder``, on storage that all executors share."""

    def __init__(self, base: Ledger, folder: str):
        self.base, self.folder = base.without_layout(), folder
        self.spark = base.open.sparkSession

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the deltas that count, in order."""
        place, files = self._place("marks")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(place)) if files.exists(place) else []

    def append(
        self, trans: DataFrame, breakups: DataFrame | None, breakups_after: DataFrame, ko_date: Column, job_gid: int
    ) -> int:
        """Add the outcome of a run on what :meth:`ledger` gives: its states of trans and breakups, and the
        table of breakups after it. Returns the delta's number."""
        now, number = self.ledger(), max(self.numbers(), default=0) + 1
        columns = now.open.columns
        still, gone = (df.select(*columns) for df in state_split(trans))
        kos, lines = ko_tables(all_lines(trans, breakups), ko_date, job_gid)
        parts = {
            MOVED: gone,
            CHANGED: changed_rows(still, now.open, "tran_gid"),
            BREAKUPS: changed_rows(breakups_after.select(*now.breakup.columns), now.breakup, "tranbrkp_gid"),
            KOS: kos,
            LINES: lines,
        }
        for name, rows in parts.items():
            # What a run that failed has left under this number is replaced.
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{number}")
        place, files = self._place(f"marks/{number}")
        files.create(place, False).close()
        return number

    def _read(self, name: str) -> DataFrame | None:
        """A part of all deltas, with their number."""
        found = None
        for number in self.numbers():
            rows = self.spark.read.parquet(f"{self.folder}/{name}/{number}").withColumn("_number", F.lit(number))
            found = rows if found is None else found.unionByName(rows)
        return found

    def touched(self, since: int = 0) -> DataFrame | None:
        """``tran_gid`` of the trans that deltas after number ``since`` moved, changed or gave KO lines; None
        if there are none. For :func:`ledgermatch.plans.rollup.refreshed`."""
        parts = [self._read(name) for name in (MOVED, CHANGED, LINES)]
        if parts[0] is None:
            return None
        own = [df.filter(F.col("_number") > since).select("tran_gid") for df in parts]
        return own[0].unionByName(own[1]).unionByName(own[2])

    def ledger(self) -> Ledger:
        """The tables with all deltas."""
        moved = self._read(MOVED)
        if moved is None:
            return self.base
        base, columns = self.base, self.base.open.columns
        still = base.open.join(moved.select("tran_gid"), "tran_gid", "left_anti")
        kos, lines = (self._read(n).drop("_number") for n in (KOS, LINES))
        return replace(
            base,
            open=_latest(still.select(*columns), self._read(CHANGED), "tran_gid"),
            matched=base.matched.unionByName(moved.select(*base.matched.columns)),
            breakup=_latest(base.breakup, self._read(BREAKUPS), "tranbrkp_gid"),
            ko=_as_text(base.ko, "ko_gid").unionByName(kos, allowMissingColumns=True),
            ko_line=_as_text(base.ko_line, "ko_gid", "kodtl_gid").unionByName(lines, allowMissingColumns=True),
        )

    def compact(self, folder: str) -> Ledger:
        """Write the tables with all deltas, laid out by recon, and read them: the base of a new log."""
        self.ledger().write_parquet(folder)
        return Ledger.from_parquet(self.spark, folder)


def _latest(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` as the last delta that changed them has them."""
    values = [c for c in rows.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*values), F.col("_number")).alias("_new"))
    joined = rows.join(newest, key, "left")
    kept = [F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(key, *kept).select(*rows.columns)


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
