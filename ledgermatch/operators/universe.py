"""The facts behind the reports: tran universe, KO detail, KO lines.

Each tran row decides for itself whether and how it takes part, so the universe needs one scan
of the open trans and one of the matched trans, and no shuffle to remove duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.money import MONEY
from ledgermatch.functions.predicates import (
    DATED_BY_LOAD,
    DATED_BY_TRAN,
    acc_mode,
    in_period,
    live,
    net_exception,
)
from ledgermatch.params import Period
from ledgermatch.sources.ledger import KO_MONTH, LINE_MONTH, LINE_RECON, Ledger

UNIVERSE_COLUMNS = (
    "tran_gid",
    "recon_code",
    "tran_date",
    "tran_mult",
    "tran_value",
    "excp_value",
    "roundoff_value",
)


def by_tran_date() -> Column:
    return F.col("recontype_code").isin(*DATED_BY_TRAN)


def by_load_date() -> Column:
    return F.col("recontype_code").isin(*DATED_BY_LOAD)


def loads_in(ledger: Ledger, period: Period | None) -> DataFrame:
    """Feed loads with their date; with a period, those from its start to the end of its last day."""
    loads = ledger.scheduler
    if period is not None:
        loads = loads.filter(
            (F.col("insert_date") >= period.start_col)
            & (F.col("insert_date") < F.date_add(period.end_col, 1))
        )
    return loads.select("scheduler_gid", F.to_date("insert_date").alias("load_date"))


def scoped(trans: DataFrame, scope: DataFrame) -> DataFrame:
    """Live trans of the scope with their recon type."""
    return live(trans).join(scope.select("recon_code", "recontype_code"), "recon_code")


def in_window(trans: DataFrame, scope: DataFrame, period: Period) -> DataFrame:
    """Trans of recons dated by tran date, within the period."""
    return (
        scoped(trans.filter(in_period(period)), scope)
        .filter(by_tran_date())
        .select(*UNIVERSE_COLUMNS)
    )


def by_load(
    trans: DataFrame, loads: DataFrame, scope: DataFrame, matched: bool
) -> DataFrame:
    """Trans of recons dated by feed load, as unit counts: open 1/1, matched 0/0."""
    unit = 0 if matched else 1
    return (
        scoped(trans, scope)
        .filter(by_load_date())
        .join(loads, "scheduler_gid")
        .select(
            "tran_gid",
            "recon_code",
            F.col("load_date").alias("tran_date"),
            F.lit(1).alias("tran_mult"),
            F.lit(unit).cast(MONEY).alias("tran_value"),
            F.lit(unit).cast(MONEY).alias("excp_value"),
            (F.lit(0).cast(MONEY) if matched else F.col("roundoff_value")).alias("roundoff_value"),
        )
    )


def opening_exceptions(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """Exceptions older than the period, of any recon type."""
    before = (F.col("tran_date") < period.start_col) & net_exception()
    codes = scope.select("recon_code")
    return (
        live(ledger.all_trans()).filter(before).join(codes, "recon_code").select(*UNIVERSE_COLUMNS)
    )


def _placed(trans: DataFrame, scope: DataFrame, loads: DataFrame, period: Period) -> DataFrame:
    """Trans with the three ways a row can take part as flags."""
    return (
        scoped(trans, scope)
        .join(loads, "scheduler_gid", "left")
        .withColumns(
            {
                "_dated": by_tran_date() & in_period(period),
                "_loaded": by_load_date() & F.col("load_date").isNotNull(),
                "_opening": (F.col("tran_date") < period.start_col) & net_exception(),
            }
        )
    )


def tran_universe(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """Report universe, one row per tran.

    A tran loaded in the period but dated before it could take part twice; the row that is in the
    period wins (see :func:`universe_collisions`).
    """
    loads = loads_in(ledger, period)

    def part(trans: DataFrame, matched: bool) -> DataFrame:
        placed = _placed(trans, scope, loads, period).filter("_dated or _loaded or _opening")
        unit = F.lit(0 if matched else 1).cast(MONEY)

        def pick(loaded: Column, column: str) -> Column:
            return F.when(F.col("_loaded"), loaded).otherwise(F.col(column)).alias(column)

        return placed.select(
            "tran_gid",
            "recon_code",
            pick(F.col("load_date"), "tran_date"),
            pick(F.lit(1), "tran_mult"),
            pick(unit, "tran_value"),
            pick(unit, "excp_value"),
            pick(unit, "roundoff_value") if matched else F.col("roundoff_value"),
        )

    return part(ledger.open, False).unionByName(part(ledger.matched, True))


def universe_collisions(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """Trans that qualify both by load date and as opening exceptions."""
    loads = loads_in(ledger, period)
    return (
        _placed(ledger.all_trans(), scope, loads, period)
        .filter("_loaded and _opening")
        .select("recon_code", "tran_gid", "tran_date", "load_date")
    )


def value_universe(ledger: Ledger, scope: DataFrame) -> DataFrame:
    """All open trans of the scope, whatever their date, as the value dashboard sees them."""
    loads = loads_in(ledger, None)
    one = F.lit(1).cast(MONEY)

    def pick(loaded: Column, column: str) -> Column:
        return F.when(by_load_date(), loaded).otherwise(F.col(column)).alias(column)

    return (
        scoped(ledger.open, scope)
        .join(loads, "scheduler_gid", "left")
        .filter(by_tran_date() | (by_load_date() & F.col("load_date").isNotNull()))
        .select(
            "tran_gid",
            "recon_code",
            pick(F.col("load_date"), "tran_date"),
            pick(F.lit(1), "tran_mult"),
            pick(one, "tran_value"),
            pick(one, "excp_value"),
            "roundoff_value",
        )
    )


def ko_detail(ledger: Ledger, universe: DataFrame, period: Period) -> DataFrame:
    """KO lines of the universe's trans of the period."""
    trans = universe.filter(F.col("tran_date") >= period.start_col).select(
        "tran_gid", "recon_code", "tran_date"
    )
    lines = live(ledger.ko_line).select("kodtl_gid", "ko_gid", "tran_gid")
    kos = live(ledger.ko).select("ko_gid", "ko_date", "manual_matchoff")
    return trans.join(lines, "tran_gid").join(kos, "ko_gid")


def ko_line_fact(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """KO lines dated in the period with tran, recon and (if any) rule attributes. A KO's trans are of
    its recon, so trans of recons outside the scope are not read.

    Lines of a ledger that is laid out for it (:meth:`Ledger.write_catalog`) are limited to the period's months
    by their folders and meet their trans bucket by bucket; their KOs come last. Of other ledgers the KOs
    come first, as they limit the lines.
    """
    months = (period.start.year * 100 + period.start.month, period.end.year * 100 + period.end.month)
    kos = live(ledger.ko).filter(in_period(period, "ko_date"))
    if ledger.laid_out:
        kos = kos.filter(F.col(KO_MONTH).between(*months))
    kos = kos.join(scope, "recon_code").select(*scope.columns, "ko_gid", "manual_matchoff", "rule_code")
    rules = live(ledger.rule).select(
        "rule_code", "rule_name", "rule_order", "source_dataset_code", "comparison_dataset_code"
    )
    columns = ("kodtl_gid", "ko_gid", "tran_gid", "ko_value", "ko_mult")
    lines = live(ledger.ko_line)
    trans = live(ledger.all_trans()).join(scope.select("recon_code"), "recon_code").select("tran_gid", "dataset_code")
    if ledger.laid_out:
        lines = lines.filter(F.col(LINE_MONTH).between(*months))
        lines = lines.join(scope.select(F.col("recon_code").alias(LINE_RECON)), LINE_RECON, "left_semi")
        placed = lines.select(*columns).join(trans, "tran_gid").join(kos, "ko_gid")
    else:
        placed = lines.select(*columns).join(kos, "ko_gid").join(trans, "tran_gid")
    return (
        placed.join(rules, "rule_code", "left")
        .select(
            "kodtl_gid",
            *scope.columns,
            "tran_gid",
            "ko_value",
            "manual_matchoff",
            "dataset_code",
            acc_mode(F.col("ko_mult")).alias("tran_acc_mode"),
            F.col("ko_mult").alias("tran_mult"),
            "rule_name",
            "rule_order",
            "source_dataset_code",
            "comparison_dataset_code",
        )
    )
