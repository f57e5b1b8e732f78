"""Breakups of parents that a run closes or shortens, and statistics of a run."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.state import ko_lines
from ledgermatch.plans import matching as mt
from ledgermatch.plans import runs as rn
from ledgermatch.sources.fixtures import Fixtures
from tests.test_matching import left_over, on_breakups, on_trans, rule, trans


def owned(spark):
    """Parent 100 is closed by its match, 200 left with 4 of 10, 300 not touched."""
    parents = trans(spark, [(100, "A", "k", 9), (101, "B", "k", 9), (200, "A", "m", 10), (201, "B", "m", 6), (300, "A", "z", 8)])
    subs = trans(spark, [(1, "A", "x", 4), (2, "A", "x", 5), (3, "A", "y", 3), (4, "A", "y", 3, 1), (5, "A", "y", 4, 2), (6, "A", "w", 8)])
    owner = F.when(F.col("tran_gid") < 3, 100).when(F.col("tran_gid") < 6, 200).otherwise(300).cast("long")
    return parents, subs.withColumn("parent_gid", owner)


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_breakups_end_with_what_rules_on_trans_leave(spark, hot_rows):
    parents, subs = owned(spark)
    state, sub = mt.run_rules(parents, [on_trans(partial=True)], subs, hot_rows=hot_rows)
    assert left_over(sub) == {1: 0, 2: 0, 3: 3, 4: 1, 5: 0, 6: 8}
    stable = mt.match_until_stable(parents, [on_trans(partial=True)], subs, hot_rows=hot_rows)
    assert left_over(stable.breakups) == left_over(sub) and left_over(stable.trans) == left_over(state)


def test_breakups_lose_what_a_later_rule_on_trans_takes(spark):
    parents, subs = owned(spark)
    other = trans(spark, [(50, "B", "y", 3)]).withColumn("parent_gid", F.lit(201).cast("long"))
    rules = [on_breakups(order=D(1)), on_trans(order=D(2), group_flag="", partial=True)]
    for state, sub in (mt.run_rules(parents, rules, subs.unionByName(other)),):
        left, below = left_over(state), left_over(sub)
        assert left[200] == 4 and left[201] == 0 and below[50] == 0
        assert below[3] == 0 and below[4] + below[5] == left[200]
        assert {r.tran_gid for r in ko_lines(sub).collect()} == {3, 50}


def test_statistics_of_other_runs_stay(spark, tmp_path):
    ledger = Fixtures(spark, "/root/testdata/sf0.001").ledger
    folder = str(tmp_path / "stats")
    rows = "recon_code string, dataset_code string, automatch_flag string, job_gid bigint"

    def put(job, mode, recons, *datasets):
        stats = spark.createDataFrame([(r, d, mode, job) for r in recons for d in datasets], rows)
        scope = spark.createDataFrame([(r,) for r in recons], "recon_code string")
        rn.replace_run_stats(stats, folder, ledger, scope, mode)

    put(1, "Y", ["RC0", "RC1"], "GL", "BNK", "GLB")
    put(2, "N", ["RC0"], "GL")
    put(3, "Y", ["RC0"], "GL")
    found = {(r.recon_code, r.dataset_code, r.automatch_flag, r.job_gid) for r in spark.read.parquet(folder).collect()}
    # GLB is not a dataset of the recon, so its rows of the first job stay.
    assert found == {("RC0", "GLB", "Y", 1), ("RC0", "GL", "N", 2), ("RC0", "GL", "Y", 3)} | {("RC1", d, "Y", 1) for d in ("GL", "BNK", "GLB")}
    assert [p.name for p in tmp_path.iterdir()] == ["stats"]


def test_a_preview_may_run_until_stable(spark):
    rows = [(k, "AB"[k % 2], "k", D("1.00") + D(k) / 100) for k in range(1, 7)]
    stable = mt.match_until_stable(trans(spark, rows), [rule(tolerance=D("0.01"))])
    assert stable.converged and ko_lines(stable.trans).count() == 6
