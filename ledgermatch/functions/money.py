"""Exact money expressions: totals, display units, percentages."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(15, 2)
TOTAL = DecimalType(18, 2)

# Display unit -> (factor, decimals) for thousand, lakh and crore.
UNITS = {
    "K": (Decimal("0.001"), 2),
    "L": (Decimal("0.00001"), 2),
    "Cr": (Decimal("0.0000001"), 3),
}


def total(value: Column) -> Column:
    """Sum as ``decimal(18,2)``; null for an empty group."""
    return F.sum(value).cast(TOTAL)


def total0(value: Column) -> Column:
    """Sum as ``decimal(18,2)``; zero for an empty group."""
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def formatted(value: Column, unit: str | None) -> Column:
    """Amount as text in a display unit; amounts outside the known units keep two decimals."""
    factor, decimals = UNITS.get(unit or "", (Decimal("1"), 2))
    scaled = value.cast(TOTAL) * F.lit(factor)
    return scaled.cast(DecimalType(18, decimals)).cast("string")


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to two decimals; zero where it cannot be computed."""
    ratio = F.try_divide(part.cast(TOTAL) * F.lit(100), whole.cast(TOTAL))
    return F.round(F.coalesce(ratio, F.lit(0)), 2).cast(TOTAL)
