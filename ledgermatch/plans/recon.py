"""A whole matching run: gates, resets, rules, statistics and reports, and its outcome as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.predicates import live
from ledgermatch.operators.keys import key_normalise
from ledgermatch.operators.scope import eligible_recons
from ledgermatch.operators.state import ko_tables, state_split
from ledgermatch.params import Period
from ledgermatch.plans import matching as mt
from ledgermatch.plans.runs import (
    exception_report,
    match_preview,
    matched_amount_report,
    run_stats,
    tally_check,
    theme_tag,
)
from ledgermatch.sources.ledger import Ledger
from ledgermatch.sources.rounds import at_size


@dataclass(frozen=True)
class RunReport:
    """``ledger``: the tables as the run leaves them (a preview leaves them as they were). ``preview`` and
    ``amounts`` have the lines of committing rules and, which are not in the ledger, of those that only
    propose."""

    outcome: mt.Stable
    ledger: Ledger
    stats: DataFrame
    preview: DataFrame
    amounts: DataFrame
    exceptions: DataFrame
    refused: DataFrame


def refusals(ledger: Ledger, period: Period, codes: Sequence[str] | None = None) -> DataFrame:
    """Recons that may not run, one by one, with the reason."""
    recons = eligible_recons(ledger, period.as_of_col, codes)
    untallied = tally_check(ledger, recons, period).filter(~F.col("may_run"))
    undated = mt.dated(recons, ledger.open.columns)[1]
    return untallied.select("recon_code", F.lit("not tallied").alias("reason")).unionByName(undated)


def committed(ledger: Ledger, outcome: mt.Stable, ko_date: Column, job_gid: int) -> Ledger:
    """The tables after a run: closed trans move to the matched ones, KOs are added, breakups have what
    is left of them. Rows that the run did not look at stay as they are."""
    ledger = ledger.without_layout()
    columns = ledger.open.columns
    still, gone = (df.select(*columns) for df in state_split(outcome.trans))
    rest = ledger.open.join(at_size(outcome.trans.select("tran_gid")), "tran_gid", "left_anti").select(*columns)
    lines = mt.all_lines(outcome.trans, outcome.breakups)
    headers, details = ko_tables(lines, ko_date, job_gid)
    return replace(
        ledger,
        open=rest.unionByName(still),
        matched=ledger.matched.unionByName(gone.select(*ledger.matched.columns)),
        ko=_as_text(ledger.ko, "ko_gid").unionByName(headers, allowMissingColumns=True),
        ko_line=_as_text(ledger.ko_line, "ko_gid", "kodtl_gid").unionByName(details, allowMissingColumns=True),
        breakup=_left_of(ledger.breakup, outcome.breakups),
    )


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _left_of(breakups: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return breakups
    left = state.select(F.col("tran_gid").alias("tranbrkp_gid"), F.col("excp_value").alias("_left"))
    value = F.coalesce("_left", "excp_value").alias("excp_value")
    return breakups.join(at_size(left), "tranbrkp_gid", "left").select(
        *(value if c == "excp_value" else F.col(c) for c in breakups.columns)
    )


def _fed(
    ready: Ledger, outcome: mt.Stable, after_run: Ledger, running: DataFrame, period: Period, commit: bool
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trans before and after a run, and breakups before and after it: those of the tables, or of the
    copies that a preview works on."""
    if commit:
        names = running.select("recon_code")
        own = [live(df).join(names, "recon_code", "left_semi") for df in (ready.open, ready.breakup, after_run.breakup)]
        return own[0], outcome.trans, own[1], own[2]
    trans = mt.preview_state(ready, running, period)
    breakups = live(ready.breakup).join(at_size(trans.select("tran_gid")), "tran_gid", "left_semi")
    return trans, outcome.trans, breakups, outcome.breakups.withColumnRenamed("dataset_code", "tranbrkp_dataset_code")


def run_recon(
    ledger: Ledger,
    period: Period,
    job_gid: int,
    codes: Sequence[str] | None = None,
    commit: bool = True,
    until_stable: bool = False,
    normalise: Sequence[str] = (),
    themes: Sequence[tuple[str, Column]] = (),
    breakup_keys: Sequence[str] = (),
) -> RunReport:
    """Run all eligible recons but those that are refused. Themes of the rows in question are cleared
    and keys are normalised first. With ``commit`` the report's ``ledger`` holds the outcome, to be
    written with ``write_parquet``; without, rules only propose."""
    recons = eligible_recons(ledger, period.as_of_col, codes)
    refused = refusals(ledger, period, codes)
    running = recons.join(refused, "recon_code", "left_anti")
    names = [r[0] for r in running.select("recon_code").collect()]  # configuration
    below = mt.dated(running, ledger.breakup.columns)[0]
    ready = replace(
        ledger,
        open=key_normalise(mt.theme_reset(ledger.open, running, period), normalise),
        breakup=mt.theme_reset(ledger.breakup, below, period),
    )
    outcome = mt.match(ready, period, names, commit, until_stable, breakup_keys, job_gid)
    if themes:
        outcome = replace(outcome, trans=theme_tag(outcome.trans, themes))
    # The order of rules is over; everything below reads the same written rows.
    keep = mt.RunFolder(outcome.trans.sparkSession)
    outcome = replace(
        outcome,
        trans=keep.table(outcome.trans, "trans"),
        breakups=None if outcome.breakups is None else keep.table(outcome.breakups, "breakups"),
    )
    after_run = committed(ready, outcome, period.as_of_col, job_gid) if commit else ledger
    stats = run_stats(*_fed(ready, outcome, after_run, running, period, commit), automatch_flag="Y" if commit else "N")
    taken, proposed = (mt.all_lines(outcome.trans, outcome.breakups, s) for s in ("allocs", "proposals"))
    lines = taken.unionByName(proposed)
    preview = match_preview(lines, ledger.rule.filter("delete_flag = 'N'"), job_gid)
    return RunReport(
        outcome,
        after_run,
        stats.withColumn("job_gid", F.lit(job_gid).cast("bigint")),
        preview,
        matched_amount_report(preview),
        exception_report(after_run, running),
        refused,
    )
