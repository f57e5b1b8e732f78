"""A log of commits against tables that are written anew."""

from dataclasses import replace
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgermatch.params import Period
from ledgermatch.plans import matching as mt
from ledgermatch.plans import recon as rc
from ledgermatch.plans.deltas import DeltaLog, changed_rows
from ledgermatch.sources.fixtures import Fixtures
from tests.test_matching import DAY, rule, trans

def as_of():
    return Period(DAY, DAY, DAY).as_of_col


def small_ledger(spark):
    """Trans of one recon and the breakups of one of them."""
    more = {"theme_code": F.lit("T"), "delete_flag": F.lit("N")}
    rows = [(1, "A", "k", 9), (2, "B", "k", 9), (3, "A", "m", 10), (4, "B", "m", 6), (5, "A", "n", 8), (6, "B", "p", 1)]
    parents = trans(spark, rows).withColumns(more)
    subs = spark.createDataFrame([(31, 3, "R", "A", D("4.00")), (32, 3, "R", "A", D("6.00")), (51, 5, "R", "A", D("8.00"))], "tranbrkp_gid long, tran_gid long, recon_code string, tranbrkp_dataset_code string, excp_value decimal(15,2)")
    subs = subs.withColumns({"tran_date": F.lit(DAY), "tran_acc_mode": F.lit("D"), **more})
    fixture = Fixtures(spark, "/root/testdata/sf0.001").ledger
    return replace(fixture, open=parents, matched=parents.limit(0), breakup=subs, ko=fixture.ko.limit(0), ko_line=fixture.ko_line.limit(0))


def tables(ledger):
    trans_rows = {(r.tran_gid, r.excp_value, place) for place in ("open", "matched") for r in getattr(ledger, place).collect()}
    lines = sorted((r.ko_gid, r.tran_gid, r.ko_value) for r in ledger.ko_line.collect())
    return trans_rows, {(r.tranbrkp_gid, r.excp_value) for r in ledger.breakup.collect()}, lines, ledger.ko.count()


def run(ledger, job, *rules):
    state, sub = mt.run_rules(ledger.open, rules, mt.as_breakups(ledger.breakup, (), ledger.open), job_gid=job)
    outcome = mt.Stable(state, sub, 1, False)
    return outcome, rc.committed(ledger, outcome, as_of(), job)


def test_a_log_of_two_runs_is_what_two_commits_leave(spark, tmp_path):
    base = small_ledger(spark)
    log, whole = DeltaLog(base, str(tmp_path / "log")), base
    for job, own in ((1, rule(partial=True)), (2, rule(rule_code="R2", group_flag="", partial=True, keys=("recon_code",)))):
        outcome, whole = run(whole, job, own)
        assert log.append(outcome.trans, outcome.breakups, whole.breakup, as_of(), job) == job
        assert tables(log.ledger()) == tables(whole)
    assert log.numbers() == [1, 2]
    assert tables(log.compact(str(tmp_path / "next"))) == tables(whole)


def test_a_delta_holds_what_changed(spark, tmp_path):
    base = small_ledger(spark)
    log = DeltaLog(base, str(tmp_path / "log"))
    outcome, whole = run(base, 1, rule(partial=True))
    log.append(outcome.trans, outcome.breakups, whole.breakup, as_of(), 1)
    kept = {n: sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/log/{n}/1").collect()) for n in ("moved", "breakups")}
    assert kept == {"moved": [1, 2, 4], "breakups": [32]}
    assert [r.tran_gid for r in spark.read.parquet(f"{tmp_path}/log/changed/1").collect()] == [3]


def test_a_delta_without_its_mark_does_not_count(spark, tmp_path):
    base = small_ledger(spark)
    log = DeltaLog(base, str(tmp_path / "log"))
    outcome, whole = run(base, 1, rule())
    log.append(outcome.trans, outcome.breakups, whole.breakup, as_of(), 1)
    (tmp_path / "log" / "marks" / "1").unlink()
    assert log.numbers() == [] and tables(log.ledger()) == tables(base)
    assert log.append(outcome.trans, outcome.breakups, whole.breakup, as_of(), 1) == 1
    assert tables(log.ledger()) == tables(whole)


def test_changed_rows_see_nulls(spark):
    before = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k long, v string")
    after = spark.createDataFrame([(1, None), (2, None), (3, "c"), (4, "d")], "k long, v string")
    assert sorted(r.k for r in changed_rows(after, before, "k").collect()) == [2, 3]
