"""Counts dashboard: counts, KO split and exception aging, for all recons of a scope at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgermatch.functions.money import count_if
from ledgermatch.functions.predicates import live, net_exception, partial_count
from ledgermatch.operators.scope import dataset_count
from ledgermatch.operators.universe import ko_detail, tran_universe
from ledgermatch.params import Period
from ledgermatch.sources.ledger import Ledger
from ledgermatch.sources.rounds import RunFolder

COUNTS = (
    "tran_count",
    "ko_count",
    "ko_system_count",
    "ko_manual_count",
    "excp_count",
    "opening_excp_count",
    "ko_zeroexcp_count",
    "ko_partialexcp_count",
)


def ko_split(ledger: Ledger, universe: DataFrame, period: Period) -> DataFrame:
    """Matched trans per recon: manual (any manual KO), system (system KOs only), total (gross)."""
    per_tran = (
        ko_detail(ledger, universe, period)
        .groupBy("tran_gid", "recon_code")
        .agg(
            F.bool_or(F.col("manual_matchoff") == "Y").alias("manual"),
            F.bool_or(F.col("manual_matchoff") == "N").alias("system"),
        )
    )
    return per_tran.groupBy("recon_code").agg(
        count_if(F.col("manual")).alias("manual_ko_count"),
        count_if(F.col("system") & ~F.coalesce("manual", F.lit(False))).alias("system_ko_count"),
        F.count(F.lit(1)).alias("ko_count"),
    )


def ko_flags(ledger: Ledger, trans: DataFrame | None = None) -> DataFrame:
    """``tran_gid`` of every tran (or of those in ``trans``) with live KO lines, and whether any KO is manual
    or of the system."""
    kos = live(ledger.ko).select("ko_gid", "manual_matchoff")
    lines = live(ledger.ko_line).select("ko_gid", "tran_gid")
    if trans is not None:
        lines = lines.join(trans.select("tran_gid"), "tran_gid", "left_semi")
    lines = lines.join(kos, "ko_gid")
    return lines.groupBy("tran_gid").agg(
        F.coalesce(F.bool_or(F.col("manual_matchoff") == "Y"), F.lit(False)).alias("manual"),
        F.coalesce(F.bool_or(F.col("manual_matchoff") == "N"), F.lit(False)).alias("system"),
    )


def tran_counts(ledger: Ledger, universe: DataFrame, period: Period) -> DataFrame:
    """All counts by recon. The universe is read once: KOs come to it as flags of their trans."""
    dated, manual = F.col("tran_date") >= period.start_col, F.col("manual")
    return universe.join(ko_flags(ledger), "tran_gid", "left").groupBy("recon_code").agg(
        count_if(dated & manual).alias("manual_ko_count"),
        count_if(dated & ~manual & F.col("system")).alias("system_ko_count"),
        count_if(dated & manual.isNotNull()).alias("ko_count"),
        count_if(F.col("tran_date") >= period.start_col).alias("tran_count"),
        count_if(net_exception()).alias("excp_gross"),
        count_if(net_exception() & (F.col("tran_date") < period.start_col)).alias("opening_excp_count"),
        count_if(F.col("excp_value") == 0).alias("ko_zeroexcp_count"),
        count_if(partial_count(period)).alias("ko_partialexcp_count"),
    )


def dashboard_counts(
    ledger: Ledger, scope: DataFrame, period: Period, universe: DataFrame | None = None
) -> DataFrame:
    """One row per recon of the scope."""
    universe = universe if universe is not None else tran_universe(ledger, scope, period)
    return counts_report(ledger, scope, tran_counts(ledger, universe, period))


def counts_report(ledger: Ledger, scope: DataFrame, counts: DataFrame) -> DataFrame:
    """The report from counts by recon, as :func:`tran_counts` gives them."""
    joined = (
        scope.select("recon_code")
        .join(dataset_count(ledger, scope), "recon_code", "left")
        .join(counts, "recon_code", "left")
        .na.fill(0)
    )
    return joined.select(
        "recon_code",
        "dataset_count",
        "tran_count",
        (F.col("ko_count") - F.col("ko_partialexcp_count")).alias("ko_count"),
        F.col("system_ko_count").alias("ko_system_count"),
        F.col("manual_ko_count").alias("ko_manual_count"),
        (F.col("excp_gross") - F.col("ko_partialexcp_count")).alias("excp_count"),
        "opening_excp_count",
        "ko_zeroexcp_count",
        "ko_partialexcp_count",
    )


def dashboard_counts_scope(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """One row for the whole scope."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    datasets = dataset_count(ledger, scope, by_recon=False)
    return (
        dashboard_counts(ledger, scope, period)
        .agg(F.count(F.lit(1)).alias("recon_count"), *sums)
        .select("recon_count", datasets.scalar().alias("dataset_count"), *COUNTS)
    )


def exception_aging(
    ledger: Ledger, scope: DataFrame, period: Period, universe: DataFrame | None = None
) -> DataFrame:
    """Exceptions per aging bucket with their share; every bucket appears, also deleted ones.

    Exceptions are counted by date first, so the range condition and the total meet days, not trans.
    """
    universe = universe if universe is not None else tran_universe(ledger, scope, period)
    days = (
        universe.filter(net_exception())
        .groupBy("tran_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return aging_report(ledger, days, period)


def aging_report(ledger: Ledger, days: DataFrame, period: Period) -> DataFrame:
    """The report from the number ``n`` of exceptions of each ``tran_date``."""
    days = days.withColumn("age", F.datediff(period.as_of_col, "tran_date")).withColumn(
        "whole", F.sum("n").over(Window.partitionBy())
    )
    buckets = live(ledger.aging).select("aging_gid", "aging_from", "aging_to")
    counted = (
        days.join(buckets, F.col("age").between(F.col("aging_from"), F.col("aging_to")))
        .groupBy("aging_gid")
        .agg(F.sum("n").alias("excp_count"), F.max("whole").alias("whole"))
    )
    return ledger.aging.join(counted, "aging_gid", "left").select(
        "aging_gid",
        "aging_desc",
        F.coalesce("excp_count", F.lit(0)).alias("excp_count"),
        F.coalesce(F.col("excp_count").cast(DecimalType(18, 0)) * 100 / F.col("whole"), F.lit(0))
        .cast(DecimalType(6, 2))
        .alias("excp_percent"),
    )


def dashboard(ledger: Ledger, scope: DataFrame, period: Period) -> dict[str, DataFrame]:
    """The three count reports, from one universe, which is derived once and written to the shared folder."""
    universe = RunFolder(scope.sparkSession).table(tran_universe(ledger, scope, period), "universe")
    return {
        "counts": dashboard_counts(ledger, scope, period, universe),
        "ko_split": ko_split(ledger, universe, period),
        "aging": exception_aging(ledger, scope, period, universe),
    }
