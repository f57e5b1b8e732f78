"""Shape of physical plans on stored tables."""

import datetime as dt
import re
from dataclasses import replace

import pytest

from ledgermatch.operators.scope import scope_by_code
from ledgermatch.operators.universe import in_window
from ledgermatch.params import Period
from ledgermatch.plans.dashboard import dashboard, exception_aging
from ledgermatch.plans.matching import key_classes, load_rules, run_rules
from ledgermatch.plans.values import value_dashboard
from ledgermatch.sources.fixtures import Fixtures
from ledgermatch.sources.ledger import Ledger

PERIOD = Period(dt.date(1997, 1, 1), dt.date(1997, 12, 31), dt.date(1998, 1, 1))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    fixtures = Fixtures(spark, "/root/testdata/sf0.001")
    fixtures.ledger.write_parquet(folder)
    fixtures["fx_feed"].write.parquet(f"{folder}/feed")
    return Ledger.from_parquet(spark, folder), spark.read.parquet(f"{folder}/feed")


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_rule_sequence_shuffles_once_and_never_pairs_rows(stored):
    ledger, feed = stored
    rules = load_rules(ledger, PERIOD.as_of_col)
    text = plan(run_rules(feed, rules)[0])
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    for join in ("SortMergeJoin", "NestedLoop", "Cartesian", "Python"):
        assert join not in text


def test_period_and_columns_reach_the_scan(stored):
    ledger, _ = stored
    text = plan(in_window(ledger.open, scope_by_code(ledger, PERIOD.as_of_col), PERIOD))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "tran_gid" in line)
    assert "GreaterThanOrEqual(tran_date" in scan and "EqualTo(delete_flag,N)" in scan
    assert "theme_code" not in scan and "kind" not in scan


def test_value_dashboard_scans_each_tran_table_once(stored):
    ledger, _ = stored
    text = plan(value_dashboard(ledger, scope_by_code(ledger, PERIOD.as_of_col), PERIOD))
    scans = [line for line in text.splitlines() if "FileScan" in line and "tran_value" in line]
    assert len(scans) == 2, text


def test_counts_and_aging_read_the_universe_once(stored):
    ledger, _ = stored
    reports = dashboard(ledger, scope_by_code(ledger, PERIOD.as_of_col), PERIOD)
    for name in ("counts", "aging"):
        scans = [line for line in plan(reports[name]).splitlines() if "FileScan" in line and "recon_trn_ttran" in line]
        assert not [line for line in scans if "ttranbrkp" not in line], name
    text = plan(exception_aging(ledger, scope_by_code(ledger, PERIOD.as_of_col), PERIOD))
    scans = [line for line in text.splitlines() if "FileScan" in line and "tran_date" in line and "excp_value" in line]
    assert len(scans) == 2, text


def test_a_class_reads_its_own_files(stored):
    ledger, feed = stored
    rules = load_rules(ledger, PERIOD.as_of_col)
    rules = [replace(r, keys=("ref_no", "tran_date")) if r.recon_code in ("RC0", "RC1") else r for r in rules]
    classes = key_classes(rules)
    assert len(classes) == 2
    state, _ = run_rules(feed, rules)
    scans = [line for line in plan(state).splitlines() if "FileScan" in line and "scratch" in line]
    wanted = [sorted(re.findall(r"\(_class#\d+ = (\d)\)", line)) for line in scans]
    assert scans and all(len(own) == 1 for own in wanted) and {own[0] for own in wanted} == {"0", "1", "2"}
    assert not any("recon_code" in filters for line in scans for filters in re.findall(r"PushedFilters: \[(.*?)\]", line))
    # No row is lost or seen twice, those of recons without rules included.
    assert state.select("tran_gid").distinct().count() == state.count() == feed.count()
