"""Checks of what the reports and the matcher take for granted. An empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.predicates import live
from ledgermatch.sources.ledger import Ledger


def duplicate_trans(ledger: Ledger) -> DataFrame:
    """Trans that appear more than once, be it in the open or the matched table."""
    ids = ledger.all_trans().groupBy("tran_gid").agg(F.count(F.lit(1)).alias("rows"))
    return ids.filter("rows > 1")


def duplicate_rules(ledger: Ledger) -> DataFrame:
    codes = live(ledger.rule).groupBy("rule_code").agg(F.count(F.lit(1)).alias("rows"))
    return codes.filter("rows > 1")


def unbalanced_trans(ledger: Ledger) -> DataFrame:
    """Trans whose value is not what is open plus what was knocked off."""
    lines = live(ledger.ko_line).groupBy("tran_gid").agg(F.sum("ko_value").alias("ko_value"))
    gone = F.col("tran_value") - F.col("excp_value")
    return (
        live(ledger.all_trans())
        .join(lines, "tran_gid", "left")
        .filter(gone != F.coalesce("ko_value", F.lit(0)))
        .select("recon_code", "tran_gid", "tran_value", "excp_value", "ko_value")
    )
