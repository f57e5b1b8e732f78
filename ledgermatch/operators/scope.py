"""Which recons a report or a run covers, and which rules apply to them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.predicates import live, valid_on
from ledgermatch.sources.ledger import Ledger

SCOPE_COLUMNS = ("recon_code", "recon_name", "recontype_code")


def active_recons(ledger: Ledger, as_of: Column) -> DataFrame:
    return live(ledger.recon).filter((F.col("active_status") == "Y") & valid_on(as_of))


def scope_by_code(ledger: Ledger, as_of: Column, codes: Iterable[str] | None = None) -> DataFrame:
    """Active recons, all of them or those named; one row per recon."""
    recons = active_recons(ledger, as_of)
    if codes is not None:
        recons = recons.filter(F.col("recon_code").isin(*codes))
    return recons.select(*SCOPE_COLUMNS)


def scope_by_user(ledger: Ledger, as_of: Column, user_code: str) -> DataFrame:
    """Active recons a user may see. Several contexts may grant one recon; it counts once."""
    granted = (
        live(ledger.user_context)
        .filter((F.col("user_code") == user_code) & (F.col("active_status") == "Y"))
        .join(live(ledger.recon_context), ["master_syscode", "parent_master_syscode"])
        .select("recon_code")
    )
    return active_recons(ledger, as_of).join(granted, "recon_code", "left_semi").select(*SCOPE_COLUMNS)


def eligible_recons(ledger: Ledger, as_of: Column, codes: Iterable[str] | None = None) -> DataFrame:
    """Recons a matching run may start on: active, with at least one rule to apply."""
    recons = active_recons(ledger, as_of)
    if codes is not None:
        recons = recons.filter(F.col("recon_code").isin(*codes))
    return recons.join(active_rules(ledger, as_of), "recon_code", "left_semi").select(
        *SCOPE_COLUMNS,
        F.coalesce("recon_date_field", F.lit("")).alias("recon_date_field"),
        F.coalesce("recon_date_flag", F.lit("N")).alias("recon_date_flag"),
        F.coalesce("recon_rule_version", F.lit("")).alias("recon_rule_version"),
    )


def active_rules(ledger: Ledger, as_of: Column) -> DataFrame:
    """Rules that apply today, with missing flags filled in."""
    rules = live(ledger.rule).filter(
        (F.col("hold_flag") == "N") & (F.col("active_status") == "Y") & valid_on(as_of)
    )
    return rules.withColumns(
        {
            "rule_code": F.coalesce("rule_code", F.lit("")),
            "rule_apply_on": F.coalesce("rule_apply_on", F.lit("")),
            "system_match_flag": F.coalesce("system_match_flag", F.lit("N")),
            "probable_match_flag": F.coalesce("probable_match_flag", F.lit("N")),
        }
    )


def dataset_count(ledger: Ledger, scope: DataFrame, by_recon: bool = True) -> DataFrame:
    """Distinct live datasets in use, per recon or over the whole scope."""
    used = (
        live(ledger.recon_dataset)
        .filter(F.col("active_status") == "Y")
        .join(live(ledger.dataset).select("dataset_code"), "dataset_code")
    )
    keys = ["recon_code"] if by_recon else []
    return (
        scope.select("recon_code")
        .join(used, "recon_code", "left" if by_recon else "inner")
        .groupBy(*keys)
        .agg(F.countDistinct("dataset_code").alias("dataset_count"))
    )
