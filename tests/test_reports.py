"""Reports, sinks and checks on small tables."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.money import formatted, percent
from ledgermatch.operators.keys import normalised
from ledgermatch.operators.scope import scope_by_code, scope_by_user
from ledgermatch.params import Period
from ledgermatch.plans import quality
from ledgermatch.plans.dashboard import dashboard, dashboard_counts_scope, exception_aging
from ledgermatch.plans.matching import configured_date_filter, match
from ledgermatch.plans.runs import match_preview, run_stats, write_preview, write_run_stats
from ledgermatch.plans.summary import rule_figures, summ_default, summ_pivot, summary
from ledgermatch.plans.values import value_dashboard
from ledgermatch.operators.state import ko_lines
from ledgermatch.sources.fixtures import Fixtures
from ledgermatch.sources.ledger import Ledger
from ledgermatch.sources.rounds import RunFolder

SF_DIR = "/root/testdata/sf0.001"
PERIOD = Period(dt.date(1997, 1, 1), dt.date(1997, 12, 31), dt.date(1998, 1, 1))


@pytest.fixture(scope="module")
def ledger(spark):
    return Fixtures(spark, SF_DIR).ledger


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_display_units(spark):
    value = F.lit(D("123456789.55"))
    assert one(spark, formatted(value, "K")) == "123456.79"
    assert one(spark, formatted(value, "L")) == "1234.57"
    assert one(spark, formatted(value, "Cr")) == "12.346"
    assert one(spark, formatted(value, None)) == "123456789.55"


def test_percent_of_nothing_is_zero(spark):
    assert one(spark, percent(F.lit(5), F.lit(0))) == 0
    assert one(spark, percent(F.lit(1), F.lit(3))) == D("33.33")
    assert one(spark, percent(F.lit(2), F.lit(3))) == D("66.67")


def test_keys(spark):
    for raw, want in [("  00ab ", "AB"), ("000", "0"), ("", None), ("  ", None), ("a0", "A0")]:
        assert one(spark, normalised(F.lit(raw))) == want


def test_empty_scope(ledger):
    nobody = scope_by_user(ledger, PERIOD.as_of_col, "nobody")
    row = dashboard_counts_scope(ledger, nobody, PERIOD).first()
    assert row.recon_count == 0 and row.tran_count == 0 and row.dataset_count == 0
    assert [r.excp_percent for r in exception_aging(ledger, nobody, PERIOD).collect()] == [D("0.00")] * 5
    assert value_dashboard(ledger, nobody, PERIOD).count() == 0


def test_recon_without_trans_shows_zeros(ledger):
    bare = Ledger(**{**ledger.__dict__, "open": ledger.open.filter("false"), "matched": ledger.matched.filter("false")})
    scope = scope_by_code(bare, PERIOD.as_of_col, ["RC1"])
    row = value_dashboard(bare, scope, PERIOD).first()
    assert row.tran_count == "0 - Lines" and row.p_ko_value == " (0.00 %)"


def test_dashboard_has_three_reports(ledger):
    reports = dashboard(ledger, scope_by_code(ledger, PERIOD.as_of_col), PERIOD)
    assert set(reports) == {"counts", "ko_split", "aging"}


def fact(spark, rows):
    schema = (
        "recon_code string, recon_name string, recontype_code string, dataset_code string, tran_gid long, tran_acc_mode string,"
        "tran_mult int, ko_value decimal(15,2), manual_matchoff string, rule_order decimal(9,2), rule_name string,"
        "source_dataset_code string, comparison_dataset_code string"
    )
    return spark.createDataFrame(rows, schema)


def line(dataset, gid, value, order, name, manual="N", target="BNK"):
    mode, mult = ("D", -1) if dataset == "GL" else ("C", 1)
    rule = (D(order), name, "GL", target) if order else (None, None, None, None)
    return ("RC1", "One", "B", dataset, gid, mode, mult, D(value), manual, *rule)


def test_pivot_keeps_rules_of_one_name_apart(spark, ledger):
    rows = [line("GL", 1, 5, 1, "Same"), line("BNK", 2, 5, 1, "Same"), line("GL", 3, 7, 2, "Same"), line("BNK", 4, 7, 2, "Same")]
    pivot = summ_pivot(rule_figures(fact(spark, rows), sides=True), ledger).filter("section = 3").collect()
    assert sorted((r.dr_value, r.target_cr_value) for r in pivot) == [(D(5), D(5)), (D(7), D(7))]


def test_pivot_shows_each_target_and_no_target_only_rule(spark, ledger):
    rows = [line("GL", 1, 5, 1, "Wide"), line("BNK", 2, 3, 1, "Wide"), line("OLD", 3, 2, 1, "Wide"), line("BNK", 4, 1, 2, "Lost")]
    pivot = summ_pivot(rule_figures(fact(spark, rows), sides=True), ledger).filter("section = 3").collect()
    assert sorted((r.target_dataset_code, r.target_cr_value) for r in pivot) == [("BNK", D(3)), ("OLD", D(2))]


def test_sub_totals_add_counts_and_system_lines_without_rule_have_no_label(spark, ledger):
    rows = [line("GL", 1, 5, 1, "A"), line("GL", 1, 6, 2, "B"), line("GL", 9, 1, None, None)]
    got = summ_default(rule_figures(fact(spark, rows)), ledger).collect()
    assert [r.dr_count for r in got if r.section == 5] == [3]
    assert [r.row_label for r in got if r.section == 3 and r.dr_value == 1] == [None]
    assert [r.rec_slno for r in sorted(got, key=lambda r: r.rec_slno)] == list(range(1, len(got) + 1))


def test_dispatch_follows_type_before_format(ledger):
    scope = scope_by_code(ledger, PERIOD.as_of_col)
    parts = summary(ledger, scope, PERIOD, "L", "format2")
    recons = {n: {r.recon_code for r in df.select("recon_code").distinct().collect()} for n, df in parts.items()}
    assert recons == {"proof": {"RC0"}, "non_value": {"RC4"}, "value": {"RC3"}, "pivot": {"RC1", "RC2"}}
    with pytest.raises(ValueError):
        summary(ledger, scope, PERIOD, layout="other")


def test_unknown_date_column_is_refused(ledger):
    with pytest.raises(ValueError):
        configured_date_filter(ledger.open, ledger.recon, PERIOD, ["no_such_column"])


def test_fixture_ledger_passes_the_checks(ledger):
    assert quality.duplicate_trans(ledger).isEmpty()
    assert quality.duplicate_rules(ledger).isEmpty()
    assert quality.unbalanced_trans(ledger).isEmpty()


def test_ledger_round_trip_and_preview(spark, ledger, tmp_path):
    keyed = ledger.open.withColumn("ref_no", F.concat(F.lit("REF"), F.col("k").cast("string")))
    both = Ledger(**{**ledger.__dict__, "open": keyed, "matched": ledger.matched.withColumn("ref_no", F.lit(""))})
    both.write_parquet(str(tmp_path / "ledger"))
    stored = Ledger.from_parquet(spark, str(tmp_path / "ledger"))
    assert stored.open.count() == ledger.open.count()
    outcome = match(stored, PERIOD, commit=False)
    preview = match_preview(ko_lines(outcome.trans), stored.rule, 7)
    path = write_preview(preview, str(tmp_path), 7, recon_code="RC1")
    assert path.endswith("7_RC1_MatchPreview.csv")
    assert spark.read.option("header", True).csv(path).count() == preview.filter("recon_code = 'RC1'").count()
    path = write_preview(preview, str(tmp_path), 7, probable=True)
    assert path.endswith("7_ProbableMatchPreview.csv")


def test_run_statistics_replace_only_their_own(spark, ledger, tmp_path):
    folder = str(tmp_path / "stats")
    live = ledger.open.filter("delete_flag = 'N'")
    stats = run_stats(live, live.filter("false"))
    assert {r.after_count for r in stats.collect()} == {0}
    write_run_stats(stats, folder)
    write_run_stats(stats.filter("recon_code = 'RC1'").withColumn("before_count", F.lit(0).cast("long")), folder)
    got = spark.read.parquet(folder)
    assert {r.recon_code for r in got.filter("before_count = 0").collect()} == {"RC1"}
    assert got.select("recon_code").distinct().count() == 5


def test_run_folder_can_be_removed(spark):
    folder = RunFolder(spark)
    folder.remove()
    folder.scratch(spark.range(3))
    assert os.path.isdir(folder.path)
    folder.remove()
    assert not os.path.exists(folder.path)
