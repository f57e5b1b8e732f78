"""Value dashboard, one row per recon of the scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.money import MONEY, TOTAL, count_if, formatted, percent, total0
from ledgermatch.functions.predicates import fully_open, in_period, net_exception, partial_value
from ledgermatch.operators.universe import by_load_date, by_tran_date, loads_in, scoped
from ledgermatch.params import Period
from ledgermatch.sources.ledger import Ledger


OPENING = ("opening_n", "opening_excp", "opening_roundoff", "opening_mult", "opening_net")


def _sum_if(condition: Column, value: Column) -> Column:
    return total0(F.when(condition, value))


def _opening(rows: DataFrame, period: Period) -> DataFrame:
    """Mark opening exceptions: older than the period and not loaded in it."""
    loaded = by_load_date() & F.coalesce(in_period(period, "load_date"), F.lit(False))
    older = (F.col("tran_date") < period.start_col) & net_exception()
    return rows.withColumn("opening", F.coalesce(older & ~loaded, F.lit(False)))


def _opening_sums() -> list[Column]:
    excp, roundoff, mult = F.col("excp_value"), F.col("roundoff_value"), F.col("tran_mult")
    opening = F.col("opening")
    return [
        count_if(opening).alias("opening_n"),
        _sum_if(opening, excp).alias("opening_excp"),
        _sum_if(opening, roundoff).alias("opening_roundoff"),
        F.coalesce(F.sum(F.when(opening, mult)), F.lit(0)).cast("bigint").alias("opening_mult"),
        _sum_if(opening, roundoff * mult).alias("opening_net"),
    ]


def open_totals(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """Figures of the open trans, in and out of the period, from one scan.

    Count and value of partly matched trans are all-time; the value they have matched is in-period.
    Recons dated by feed load count every tran as 1.
    """
    rows = _opening(scoped(ledger.open, scope).join(loads_in(ledger, None), "scheduler_gid", "left"), period)
    counted = by_tran_date() | (by_load_date() & F.col("load_date").isNotNull())
    one = F.lit(1).cast(MONEY)
    rows = rows.withColumns(
        {
            "counted": counted,
            "date": F.when(by_load_date(), F.col("load_date")).otherwise(F.col("tran_date")),
            "value": F.when(by_load_date(), one).otherwise(F.col("tran_value")),
            "excp": F.when(by_load_date(), one).otherwise(F.col("excp_value")),
        }
    )
    value, excp = F.col("value"), F.col("excp")
    now = F.col("counted") & in_period(period, "date")
    partly = F.col("counted") & partial_value(value, excp)
    fully = F.col("counted") & fully_open(value, excp)
    return rows.groupBy("recon_code").agg(
        count_if(now).alias("bal_n"),
        _sum_if(now, value).alias("bal_value"),
        count_if(F.col("counted")).alias("all_bal_n"),
        _sum_if(F.col("counted"), value).alias("all_bal_value"),
        count_if(partly).alias("ko_partialexcp_count"),
        _sum_if(partly, excp).alias("partialexcp_value"),
        _sum_if(partly & now, value - excp).alias("partialmatch_value"),
        count_if(fully).alias("excp_count"),
        _sum_if(fully, excp).alias("excp_value"),
        *_opening_sums(),
    )


def matched_totals(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """Figures of the matched trans, from one scan."""
    rows = scoped(ledger.matched, scope).join(loads_in(ledger, None), "scheduler_gid", "left")
    return (
        _opening(rows, period)
        .groupBy("recon_code")
        .agg(
            count_if(in_period(period)).alias("ko_count"),
            _sum_if(in_period(period), F.col("tran_value")).alias("ko_value"),
            F.count(F.lit(1)).alias("all_ko_n"),
            total0(F.col("tran_value")).alias("all_ko_value"),
            *[c.alias(f"matched_{n}") for n, c in zip(OPENING, _opening_sums(), strict=True)],
        )
    )


def value_figures(ledger: Ledger, scope: DataFrame, period: Period) -> DataFrame:
    """Raw figures per recon; a recon without trans shows zeros.

    ``openingexcp_value`` nets the product of sums, as the report always did;
    ``openingexcp_value_exact`` nets each tran's own round-off.
    """

    def opening(name: str) -> Column:
        return F.col(name) + F.col(f"matched_{name}")

    # One row per recon from each table; adding them up needs no second join on the recon.
    parts = open_totals(ledger, scope, period).unionByName(
        matched_totals(ledger, scope, period), allowMissingColumns=True
    )
    figures = [f for f in parts.schema.fields if f.name != "recon_code"]
    totals = parts.groupBy("recon_code").agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in figures])
    return (
        scope.select("recon_code", "recontype_code")
        .join(totals, "recon_code", "left")
        .na.fill(0)
        .withColumns(
            {
                "tran_n": F.col("bal_n") + F.col("ko_count"),
                "tran_value": (F.col("bal_value") + F.col("ko_value")).cast(TOTAL),
                "all_tran_n": F.col("all_bal_n") + F.col("all_ko_n"),
                "all_tran_value": (F.col("all_bal_value") + F.col("all_ko_value")).cast(TOTAL),
                "openingexcp_count": opening("opening_n"),
                "openingexcp_value": (
                    opening("opening_excp") - opening("opening_roundoff").cast(TOTAL) * opening("opening_mult")
                ).cast(TOTAL),
                "openingexcp_value_exact": (opening("opening_excp") - opening("opening_net")).cast(TOTAL),
            }
        )
    )


def value_dashboard(
    ledger: Ledger, scope: DataFrame, period: Period, unit: str | None = None
) -> DataFrame:
    """Figures, amounts in a display unit, percentages as text, raw totals."""
    c = F.col
    figures = value_figures(ledger, scope, period)
    with_opening = c("tran_value") + c("openingexcp_value")
    ko_and_partial = c("ko_value") + c("partialmatch_value")

    def share(part: Column, whole: Column, lead: str) -> Column:
        return F.concat(F.lit(lead), percent(part, whole).cast("string"), F.lit(" %)"))

    def of_value(part: Column, whole: Column) -> Column:
        return share(part, whole, " (")

    def of_count(part: str, whole: str) -> Column:
        return share(c(part), c(whole), " - Lines (")

    return figures.select(
        "recon_code",
        F.concat(c("tran_n").cast("string"), F.lit(" - Lines")).alias("tran_count"),
        "tran_value",
        "ko_count",
        "ko_value",
        "ko_partialexcp_count",
        "excp_count",
        "excp_value",
        "partialmatch_value",
        "partialexcp_value",
        (c("partialexcp_value") + c("partialmatch_value")).cast(TOTAL).alias("partialexcpmatch_value"),
        "openingexcp_value",
        "openingexcp_value_exact",
        "openingexcp_count",
        "recontype_code",
        formatted(c("tran_value"), unit).alias("c_tran_value"),
        formatted(ko_and_partial, unit).alias("c_ko_value"),
        formatted(c("partialexcp_value"), unit).alias("c_partialexpense_value"),
        formatted(c("partialmatch_value"), unit).alias("c_partialmatch_value"),
        formatted(c("partialexcp_value"), unit).alias("c_partialexcp_value"),
        formatted(c("excp_value"), unit).alias("c_excp_value"),
        formatted(c("openingexcp_value"), unit).alias("c_openingexcp_value"),
        of_value(ko_and_partial, with_opening).alias("p_ko_value"),
        of_value(c("excp_value"), with_opening).alias("p_exp_value"),
        of_value(c("partialexcp_value"), c("all_tran_value")).alias("p_partialexpense_value"),
        of_value(c("partialmatch_value"), c("tran_value")).alias("p_partialmatch_value"),
        of_value(c("partialexcp_value"), with_opening).alias("p_partialexp_value"),
        of_count("ko_count", "tran_n").alias("p_ko_count"),
        of_count("excp_count", "all_tran_n").alias("p_excp_count"),
        of_count("ko_partialexcp_count", "all_tran_n").alias("p_partial_count"),
        c("tran_value").alias("v_totaltran_value"),
        c("all_tran_value").alias("v_totaltran_expvalue"),
    )
