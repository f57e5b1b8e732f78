"""Counts by day: a small table from which the count reports of any period and scope are added up.

A tran stands in one place of the universe, so every distinct count of the dashboard is a sum over trans and may
be kept as one. Where a tran stands depends on the period only through its own date and the date of its load; a
cell of the roll-up is therefore a (recon, tran date, load date), with sums of what its trans are worth as dated,
loaded and opening rows. Cells grow with recons and days, not with trans, and add up: :func:`merged` joins the
roll-ups of parts, and :func:`refreshed` takes out what a commit changed and puts in what it has become.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.money import count_if
from ledgermatch.functions.predicates import in_period, live, net_exception
from ledgermatch.operators.universe import by_load_date, by_tran_date, loads_in
from ledgermatch.params import Period
from ledgermatch.plans.dashboard import aging_report, counts_report, ko_flags
from ledgermatch.sources.ledger import Ledger

CELL = ("recon_code", "tran_date", "load_date")

#: Sums of a cell. Trans dated by their load count as units, so they have sums of their own.
MEASURES = (
    "tran_count",
    "ko_count",
    "manual_ko_count",
    "system_ko_count",
    "excp_count",
    "zero_count",
    "partial_count",
    "unit_excp_count",
    "unit_zero_count",
)


def rollup(ledger: Ledger, trans: DataFrame | None = None) -> DataFrame:
    """Cells of all live trans of the ledger, or of those whose ``tran_gid`` is in ``trans``. Each tran table is
    read once; KOs come to their trans as flags before anything is counted."""
    loads, flags = loads_in(ledger, None), ko_flags(ledger, trans)
    manual, system, exception = F.col("manual"), F.col("system"), net_exception()

    def part(rows: DataFrame, matched: bool) -> DataFrame:
        if trans is not None:
            rows = rows.join(trans.select("tran_gid"), "tran_gid", "left_semi")
        unit_exception = F.lit(False) if matched else F.col("roundoff_value") != 1
        return live(rows).select(
            "tran_gid",
            "recon_code",
            "tran_date",
            "scheduler_gid",
            exception.alias("_excp"),
            (F.col("excp_value") == 0).alias("_zero"),
            (exception & (F.col("tran_value") != F.col("excp_value"))).alias("_partial"),
            unit_exception.alias("_unit_excp"),
            F.lit(matched).alias("_unit_zero"),
        )

    rows = part(ledger.open, False).unionByName(part(ledger.matched, True))
    return (
        rows.join(flags, "tran_gid", "left")
        .join(loads, "scheduler_gid", "left")
        .groupBy(*CELL)
        .agg(
            F.count(F.lit(1)).alias("tran_count"),
            count_if(manual.isNotNull()).alias("ko_count"),
            count_if(manual).alias("manual_ko_count"),
            count_if(~manual & system).alias("system_ko_count"),
            count_if(F.col("_excp")).alias("excp_count"),
            count_if(F.col("_zero")).alias("zero_count"),
            count_if(F.col("_partial")).alias("partial_count"),
            count_if(F.col("_unit_excp")).alias("unit_excp_count"),
            count_if(F.col("_unit_zero")).alias("unit_zero_count"),
        )
    )


def merged(*cells: DataFrame) -> DataFrame:
    """One roll-up of several. Cells in which nothing is left go."""
    whole = cells[0]
    for more in cells[1:]:
        whole = whole.unionByName(more)
    sums = whole.groupBy(*CELL).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.filter(F.col("tran_count") != 0)


def refreshed(cells: DataFrame, before: Ledger, after: Ledger, touched: DataFrame) -> DataFrame:
    """The roll-up after a commit, from the one before it. ``touched`` has the ``tran_gid`` of every tran that was
    changed, moved, added or got a KO line; the others are not counted again. A tran may be in it twice."""
    old = rollup(before, touched).withColumns({m: -F.col(m) for m in MEASURES})
    return merged(cells, old, rollup(after, touched))


def _placed(cells: DataFrame, scope: DataFrame, period: Period) -> DataFrame:
    """Cells of the scope that have rows in the universe: ``_present`` as rows of the period, the others as opening
    exceptions. ``day`` is the date they have there, ``excp`` what of them is an exception."""
    loaded = F.coalesce(by_load_date() & in_period(period, "load_date"), F.lit(False))
    present = loaded | F.coalesce(by_tran_date() & in_period(period), F.lit(False))
    return (
        cells.join(scope.select("recon_code", "recontype_code"), "recon_code")
        .withColumns({"_loaded": loaded, "_present": present})
        .filter(F.col("_present") | (F.col("tran_date") < period.start_col))
        .withColumns(
            {
                "day": F.when(F.col("_loaded"), F.col("load_date")).otherwise(F.col("tran_date")),
                "excp": F.when(F.col("_loaded"), F.col("unit_excp_count")).otherwise(F.col("excp_count")),
            }
        )
    )


def _sum_where(condition: Column, measure: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(measure))), F.lit(0))


def counts_of(cells: DataFrame, ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """The counts dashboard, one row per recon of the scope; reads configuration and cells only."""
    present, loaded = F.col("_present"), F.col("_loaded")
    counts = _placed(cells, scope, period).groupBy("recon_code").agg(
        *[_sum_where(present, m).alias(m) for m in ("manual_ko_count", "system_ko_count", "ko_count", "tran_count")],
        F.sum("excp").alias("excp_gross"),
        _sum_where(~present, "excp").alias("opening_excp_count"),
        (_sum_where(loaded, "unit_zero_count") + _sum_where(present & ~loaded, "zero_count")).alias("ko_zeroexcp_count"),
        _sum_where(present & ~loaded, "partial_count").alias("ko_partialexcp_count"),
    )
    return counts_report(ledger, scope, counts)


def aging_of(cells: DataFrame, ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """Exceptions per aging bucket; reads configuration and cells only."""
    days = (
        _placed(cells, scope, period)
        .groupBy(F.col("day").alias("tran_date"))
        .agg(F.sum("excp").alias("n"))
        .filter("n > 0")
    )
    return aging_report(ledger, days, period)
