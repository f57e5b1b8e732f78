"""Roll-up of counts against the reports it stands for."""

import datetime as dt
from dataclasses import replace
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.scope import scope_by_code
from ledgermatch.params import Period
from ledgermatch.plans import matching as mt
from ledgermatch.plans import rollup as ru
from ledgermatch.plans.dashboard import dashboard_counts
from ledgermatch.plans.deltas import DeltaLog
from ledgermatch.sources.fixtures import Fixtures
from tests.test_deltas import run, small_ledger
from tests.test_matching import DAY, rule

AS_OF = dt.date(1998, 1, 1)


def rows(df, columns=None):
    columns = columns or df.columns
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rollup") / "cells")
    ledger = Fixtures(spark, "/root/testdata/sf0.001").ledger
    ru.rollup(ledger).write.parquet(folder)
    return ledger, spark.read.parquet(folder)


@pytest.mark.parametrize("start,end", [("1997-02-28", "1997-02-28"), ("1995-06-17", "1998-01-31"), ("2050-01-01", "2050-12-31")])
def test_any_period(stored, start, end):
    ledger, cells = stored
    period = Period(dt.date.fromisoformat(start), dt.date.fromisoformat(end), AS_OF)
    scope = scope_by_code(ledger, period.as_of_col)
    want = dashboard_counts(ledger, scope, period)
    assert rows(ru.counts_of(cells, ledger, scope, period), want.columns) == rows(want)


def test_parts_add_up(stored):
    ledger, cells = stored
    halves = [ru.rollup(ledger, ledger.all_trans().filter(f"tran_gid % 8 {op} 3").select("tran_gid")) for op in ("<", ">=")]
    assert rows(ru.merged(*halves), cells.columns) == rows(cells)


def test_reports_read_cells_and_configuration_only(stored):
    ledger, cells = stored
    period = Period(dt.date(1997, 1, 1), dt.date(1997, 12, 31), AS_OF)
    text = ru.counts_of(cells, ledger, scope_by_code(ledger, period.as_of_col), period)._jdf.queryExecution().toString()
    assert "orders.parquet" not in text and "lineitem" not in text


def test_a_commit_refreshes_what_it_touched(spark, tmp_path):
    before = small_ledger(spark)
    load = F.lit(None).cast("bigint")
    before = replace(before, open=before.open.withColumn("scheduler_gid", load), matched=before.matched.withColumn("scheduler_gid", load))
    log = DeltaLog(before, str(tmp_path / "log"))
    assert log.touched() is None
    cells = ru.rollup(before)
    for job, own in ((1, rule(partial=True)), (2, rule(rule_code="R2", group_flag="", partial=True, keys=("recon_code",), tolerance=D(0)))):
        held = log.ledger()
        outcome, whole = run(held, job, own)
        log.append(outcome.trans, outcome.breakups, whole.breakup, Period(DAY, DAY, DAY).as_of_col, job)
        touched = log.touched(since=job - 1)
        assert touched.distinct().count() < 6
        cells = ru.refreshed(cells, held, log.ledger(), touched)
        want = ru.rollup(log.ledger())
        assert rows(cells, want.columns) == rows(want)
    assert mt.live(whole.open).count() < 6


def test_nothing_to_count(stored):
    ledger, cells = stored
    none = cells.limit(0)
    period = Period(DAY, DAY, DAY)
    scope = scope_by_code(ledger, Period(AS_OF, AS_OF, AS_OF).as_of_col)
    assert {r.tran_count for r in ru.counts_of(none, ledger, scope, period).collect()} == {0}
    assert {r.excp_count for r in ru.aging_of(none, ledger, scope, period).collect()} == {0}
