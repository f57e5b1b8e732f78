"""What a run leaves on the disk: tables that nothing reads any more go, and so do the shuffles behind written tables."""

import datetime as dt
import os
import time
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import groups as gr
from ledgermatch.operators.state import ALLOC_TYPE, ko_lines
from ledgermatch.plans import matching as mt
from ledgermatch.sources.rounds import FREE_SHUFFLES, LedgerFolder, RunFolder, shared_folder
from tests.test_matching import left_over, on_breakups, on_trans, rule, trans
from tests.test_plans import plan
from verification.queries import QUERIES


def tables_in(path):
    return {p.parent for p in Path(path).rglob("*.parquet")}


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_shuffles_go_with_the_query_that_wrote_the_table(spark):
    before, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "s")
    assert LedgerFolder(spark).scratch(rows).agg(F.sum("s")).first()[0] == 499500
    for _ in range(50):  # files are removed in the background
        if not (left := {f for f in shuffle_files(spark) - before if f.endswith(".data")}):
            break
        time.sleep(0.1)
    # What is left is the last sum's, which is no table.
    assert len({f.split("_")[1] for f in left}) <= 1
    assert spark.conf.get(FREE_SHUFFLES, None) == setting


def test_packed_tables_hold_every_type_and_null(spark):
    line = (1, 2, "R1", "k", D("1.50"), -1, D("-0.01"))
    row = (7, -3, "text", dt.date(1997, 1, 2), dt.datetime(1997, 1, 2, 3), D("-12.34"), D("9" * 30 + ".99"), True, [line, line], [])
    kinds = "a bigint, b int, c string, d date, e timestamp, f decimal(15,2), g decimal(38,2), h boolean"
    df = spark.createDataFrame([row, (None,) * 10, row], f"{kinds}, allocs {ALLOC_TYPE}, proposals {ALLOC_TYPE}")
    folder = LedgerFolder(spark)
    for by in (None, "c"):
        again = folder.scratch(df, by).select(*df.columns)
        assert again.dtypes == df.dtypes and sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))


def test_a_folder_below_another_is_removed_by_itself(spark):
    above = RunFolder(spark)
    below, kept = above.below(), above.scratch(spark.range(3))
    assert below.scratch(spark.range(4)).count() == 4 and below.path.startswith(f"{above.path}/")
    assert len(tables_in(above.path)) == 2
    below.remove()
    assert tables_in(above.path) == {Path(above.path) / "scratch-1"} and kept.count() == 3


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_trans_and_breakups_stand_on_the_disk_once(spark, hot_rows):
    """Rules on breakups, then on trans, then on breakups again: of each stretch only what the outcome reads is left."""
    parents = trans(spark, [(100, "A", "k", 9), (101, "B", "k", 9), (200, "A", "m", 10), (201, "B", "m", 6)])
    subs = trans(spark, [(1, "A", "x", 4), (2, "A", "y", 5), (3, "A", "y", 10, 1), (4, "B", "x", 4), (5, "B", "z", 5), (6, "B", "z", 6)])
    owner = F.when(F.col("tran_gid") < 3, 100).when(F.col("tran_gid") < 4, 200).when(F.col("tran_gid") < 6, 101).otherwise(201)
    own = RunFolder(spark).scratch(subs.withColumn("parent_gid", owner.cast("long")))
    rules = [on_breakups(order=D(1)), on_trans(order=D(2), group_flag="", partial=True), rule(rule_code="S2", apply_on="S", order=D(3))]
    folder = LedgerFolder(spark)
    state, sub = mt.run_rules(parents, rules, own, hot_rows=hot_rows, folder=folder)
    tables = tables_in(folder.path)
    assert len(tables) == 2
    read = {Path(f.removeprefix("file:").lstrip("/")).parent for df in (state, sub) for f in df.inputFiles()}
    assert {t.relative_to("/") for t in tables} <= read
    assert left_over(state) == {100: 0, 101: 0, 200: 4, 201: 0}
    assert {r.tran_gid for r in ko_lines(sub).collect()} == {1, 4} and left_over(sub) == {1: 0, 2: 0, 3: 4, 4: 0, 5: 0, 6: 0}
    assert own.count() == 6


def test_committed_runs_leave_their_rows_only(spark):
    home = shared_folder(spark).removeprefix("file:")
    before = tables_in(home)
    rows = QUERIES["committed_breakups"](spark, "/root/testdata/sf0.001")
    # The two feeds, and the rows of three runs.
    assert len(tables_in(home) - before) == 5
    assert {r.variant for r in rows.groupBy("variant").count().collect()} == {"T", "ST", "TS"}


def test_rows_of_large_groups_stand_on_the_disk_once(spark, monkeypatch):
    """A rule with tolerance writes the rows in chunks, and again with their ranks; the first go then."""
    rows = [(k, "AB"[k % 2], "k", 5 + D(k) / 100, k % 7) for k in range(300)]
    folder = LedgerFolder(spark)
    state, _ = mt.run_rules(trans(spark, rows), [rule(tolerance=D("0.01"))], hot_rows=40, folder=folder)
    # The keys of the large groups, and the rows.
    assert len(tables_in(folder.path)) == 2
    assert left_over(state) == left_over(mt.run_rules(trans(spark, rows), [rule(tolerance=D("0.01"))])[0])


@pytest.mark.parametrize("shape", [{"group_flag": "OTO"}, {"group_flag": "MTM", "partial": True}])
def test_rules_one_after_the_other_on_large_groups(spark, shape):
    """Rows of amounts that are large groups of their own are written apart, and read until all are written again."""
    rows = [(k, "AB"[k % 2], "k", 5 + (k // 60), k % 7) for k in range(300)] + [(400 + k, "A", f"s{k}", 5) for k in range(5)]
    rules = [rule(tolerance=D("0.50"), **shape), rule(rule_code="R2", order=D(2), tolerance=D("1.00"), group_flag="OTO")]
    found = [mt.run_rules(trans(spark, rows), rules, hot_rows=n)[0] for n in (40, 1_000_000)]
    assert left_over(found[0]) == left_over(found[1]) and ko_lines(found[0]).count() == ko_lines(found[1]).count() > 0


def test_only_rows_with_an_amount_left_look_for_neighbours(spark):
    """Of 200 rows two are left after equal amounts have met: the join with neighbours is about these."""
    rows = [(k, "AB"[k % 2], "k", 5 + k // 2, k % 7) for k in range(200)] + [(300, "A", "k", D("900.00")), (301, "B", "k", D("900.01"))]
    columns = {"_left": F.when(F.col("tran_gid") >= 300, (F.col("tran_value") * 100).cast("long")), "_n": F.lit(1).cast("long")}
    placed = trans(spark, rows).withColumn("side", F.when(F.col("dataset_code") == "A", "S").otherwise("T"))
    placed = placed.withColumns(columns | {"tolerance": F.lit("0.01").cast("decimal(15,2)"), gr.CHUNK: (F.col("tran_gid") % 3).cast("int")})
    folder = RunFolder(spark)
    hot = gr.HotGroups(spark.createDataFrame([("k",)], "ref_no string"), 202)
    after = gr.ChunkedGroups(["ref_no"], hot, folder).neighbours(placed)
    sent = [j for j in plan(after).split("\n") if "Filter isnull(_left" in j]
    assert len(sent) == 1
    found = {r.tran_gid: (r._lo and r._lo.c, r._hi and r._hi.c) for r in after.collect()}
    assert len(found) == 202 and found[300] == (None, 90001) and found[301] == (90000, None)
    assert {v for k, v in found.items() if k < 300} == {(None, None)}
