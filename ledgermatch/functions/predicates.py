"""Column predicates on ledger rows. All are built-in expressions, so filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.params import Period

# Recon types by the date that places a tran in a period.
DATED_BY_TRAN = ("W", "B", "I")
DATED_BY_LOAD = ("V", "N")


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("delete_flag") == "N")


def valid_on(as_of: Column) -> Column:
    """Validity interval whose end may be open."""
    return (F.col("period_from") <= as_of) & (
        (F.col("period_to") >= as_of) | (F.col("until_active_flag") == "Y")
    )


def net_open() -> Column:
    """Open value after the accepted round-off is taken out of it."""
    return F.col("excp_value") - F.col("roundoff_value") * F.col("tran_mult")


def net_exception() -> Column:
    """Something is still open, and it is more than an accepted round-off."""
    return (F.col("excp_value") != 0) & (net_open() != 0)


def partial_count(period: Period) -> Column:
    """Partly matched, as the count dashboard sees it."""
    return (
        net_exception()
        & (F.col("tran_value") != F.col("excp_value"))
        & (F.col("tran_date") >= period.start_col)
    )


def partial_value(value: Column, excp: Column) -> Column:
    """Partly matched, as the value dashboard sees it (round-off is not considered)."""
    return (value != excp) & (excp != 0) & (value != 0)


def fully_open(value: Column, excp: Column) -> Column:
    return (value == excp) & (excp != 0)


def in_period(period: Period, column: str = "tran_date") -> Column:
    return F.col(column).between(period.start_col, period.end_col)


def acc_mode(mult: Column) -> Column:
    """Debit for sign -1, credit for everything else, null included."""
    return F.when(mult == -1, F.lit("D")).otherwise(F.lit("C"))
