"""Matching state: trans with what has been knocked off them so far.

``allocs`` holds a row's committed KO lines, ``proposals`` those only proposed. A row meets few
passes, so the arrays stay short; they save a join of the state with its KO lines after each pass.
A rule that only proposes uses up what it proposes for its own later passes: ``proposed_value``, which
counts for ``proposed_rule`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.money import MONEY, TOTAL, total0
from ledgermatch.functions.predicates import net_open

ALLOC_TYPE = (
    "array<struct<round:int,step:int,rule_code:string,ko_gid:string,"
    "ko_value:decimal(15,2),ko_mult:int,roundoff_value:decimal(15,2)>>"
)


STATE = ("allocs", "proposals", "proposed_rule", "proposed_value")


def with_state(trans: DataFrame) -> DataFrame:
    """Trans with empty KO lines; a state is returned as it is."""
    lines, none = F.array().cast(ALLOC_TYPE), F.lit(None).cast("string")
    blank = dict(zip(STATE, (lines, lines, none, F.lit(0).cast(MONEY)), strict=True))
    missing = {c: v for c, v in blank.items() if c not in trans.columns}
    return trans.withColumns(missing) if missing else trans


def without_proposals(state: DataFrame) -> DataFrame:
    """A state in which no rule has proposed anything."""
    return with_state(state.drop("proposals", "proposed_rule", "proposed_value"))


def working_value() -> Column:
    """What the row's rule may still match: the open value, less what the rule has proposed."""
    own = F.col("proposed_rule").eqNullSafe(F.col("rule_code"))
    return net_open() - F.when(own, F.col("proposed_value")).otherwise(F.lit(0).cast(MONEY))


def apply_hits(df: DataFrame, keys: list[str], round_no: int, step: int, commit: bool, job_gid: int = 0) -> DataFrame:
    """Fold a pass's result into the state. Passes work on amounts; ``_sign`` is the sign of the row's
    open value. Ids of KOs depend on the job and on run data only: a repeated task gives the same ids,
    another job others."""
    hit = F.coalesce(F.col("_take") > 0, F.lit(False))
    signed = (F.col("_residue") * F.col("tran_mult") * F.col("_sign")).cast(MONEY)
    taken = (F.col("_take") * F.col("_sign")).cast(MONEY)
    ko_gid = F.md5(
        F.concat_ws("\x1f", F.lit(job_gid), "rule_code", F.lit(round_no), F.lit(step), *[F.col(k).cast("string") for k in keys], "_seed")
    )
    line = F.struct(
        F.lit(round_no).alias("round"),
        F.lit(step).alias("step"),
        F.col("rule_code"),
        ko_gid.alias("ko_gid"),
        taken.alias("ko_value"),
        F.col("tran_mult").cast("int").alias("ko_mult"),
        signed.alias("roundoff_value"),
    )
    target = "allocs" if commit else "proposals"
    columns = {target: F.when(hit, F.concat(target, F.array(line))).otherwise(F.col(target)).cast(ALLOC_TYPE)}
    if commit:
        columns["excp_value"] = F.when(hit, (F.col("excp_value") - taken).cast(MONEY)).otherwise(F.col("excp_value"))
        columns["roundoff_value"] = F.when(hit, (F.col("roundoff_value") + signed).cast(MONEY)).otherwise(F.col("roundoff_value"))
    else:
        own = F.col("proposed_rule").eqNullSafe(F.col("rule_code"))
        before = F.when(own, F.col("proposed_value")).otherwise(F.lit(0).cast(MONEY))
        columns["proposed_value"] = F.when(hit, (before + taken).cast(MONEY)).otherwise(F.col("proposed_value"))
        columns["proposed_rule"] = F.when(hit, F.col("rule_code")).otherwise(F.col("proposed_rule"))
    return df.withColumns(columns).drop("_take", "_residue", "_seed")


def still_open() -> Column:
    """Something is left to match. Reversals have negative values and match among themselves."""
    return net_open() != 0


def ko_lines(state: DataFrame, source: str = "allocs") -> DataFrame:
    """One row per KO line.

    Empty arrays are dropped after the explode: a plain explode would add a filter on the array,
    which the optimizer moves down and writes out in terms of all passes.
    """
    extra = [c for c in ("parent_gid",) if c in state.columns]
    kept = ["recon_code", "dataset_code", "tran_gid", *extra, "tran_date", "tran_acc_mode"]
    lines = state.select(*kept, F.explode_outer(source).alias("a")).select(*kept, "a.*")
    return lines.filter(F.col("ko_gid").isNotNull())


def ko_headers(lines: DataFrame) -> DataFrame:
    """One row per KO: lines and value per side (debit, credit), first and last tran."""
    debit = F.col("ko_mult") == -1
    return lines.groupBy("ko_gid", "recon_code", "rule_code").agg(
        F.count(F.when(debit, 1)).alias("dr_count"),
        total0(F.when(debit, F.col("ko_value"))).alias("dr_value"),
        F.count(F.when(~debit, 1)).alias("cr_count"),
        total0(F.when(~debit, F.col("ko_value"))).alias("cr_value"),
        total0(F.col("roundoff_value")).alias("roundoff_value"),
        F.min("tran_gid").alias("first_tran_gid"),
        F.max("tran_gid").alias("last_tran_gid"),
    )


def ko_tables(lines: DataFrame, ko_date: Column, job_gid: int) -> tuple[DataFrame, DataFrame]:
    """KO lines in the shape of the KO header and KO line tables."""
    headers = lines.select(
        "ko_gid",
        "recon_code",
        ko_date.alias("ko_date"),
        F.lit("N").alias("manual_matchoff"),
        "rule_code",
        F.lit(job_gid).cast("bigint").alias("job_gid"),
        F.lit("N").alias("delete_flag"),
    ).distinct()
    details = lines.select(
        F.md5(F.concat_ws("\x1f", "ko_gid", F.col("tran_gid").cast("string"))).alias("kodtl_gid"),
        "ko_gid",
        "tran_gid",
        "ko_value",
        "ko_mult",
        F.lit("N").alias("delete_flag"),
    )
    return headers, details


def state_split(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open trans and matched trans. A tolerated difference stays open, netted by its round-off."""
    plain = state.drop(*STATE)
    return plain.filter(F.col("excp_value") != 0), plain.filter(F.col("excp_value") == 0)


def state_fingerprint(trans: DataFrame) -> DataFrame:
    """Count and open value of the open trans per recon; a run that matches anything changes it."""
    return trans.groupBy("recon_code").agg(
        F.count("tran_gid").alias("tran_count"),
        F.sum("excp_value").cast(TOTAL).alias("excp_value"),
    )
