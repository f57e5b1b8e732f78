"""Ledger laid out for reports on KOs: what plans read and shuffle, and that no row is lost."""

import datetime as dt
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.scope import scope_by_code
from ledgermatch.operators.universe import ko_line_fact
from ledgermatch.params import Period
from ledgermatch.sources.fixtures import Fixtures
from ledgermatch.sources.ledger import Ledger
from tests.test_plans import plan

PERIOD = Period(dt.date(1997, 3, 15), dt.date(1997, 5, 2), dt.date(1998, 1, 1))


@pytest.fixture(scope="module")
def ledgers(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("laid_out") / "tables")
    plain = Fixtures(spark, "/root/testdata/sf0.001").ledger
    spark.sql(f"create database laid_out location '{folder}/db'")
    plain.write_catalog("laid_out", 4, folder)
    return plain, Ledger.from_catalog(spark, "laid_out")


def rows(df, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_part_of_a_month_is_not_rounded(ledgers):
    found = [ko_line_fact(own, scope_by_code(own, PERIOD.as_of_col), PERIOD) for own in ledgers]
    assert rows(found[0], found[0].columns) == rows(found[1], found[0].columns) != []


def test_lines_meet_trans_without_a_shuffle_and_months_are_folders(spark, ledgers):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Configuration is small enough to be sent to all tasks; the tables here must not be.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12000")
    try:
        text = plan(ko_line_fact(ledgers[1], scope_by_code(ledgers[1], PERIOD.as_of_col), PERIOD))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = text.splitlines()
    depth = {i: len(re.match(r"[ :+-]*", line).group()) for i, line in enumerate(lines)}
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin [tran_gid" in line)
    below = []
    for i in range(join + 1, len(lines)):
        if depth[i] <= depth[join]:
            break
        below.append(lines[i])
    assert sum("Bucketed: true" in line for line in below) == 3
    assert not [line for line in below if "Exchange hashpartitioning" in line]
    for table, month in (("recon_trn_tkodtl", "line_ko_month"), ("recon_trn_tko[", "ko_month")):
        scan = next(line for line in lines if "FileScan" in line and table in line)
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
        assert re.search(rf"{month}#\d+ >= 199703", filters) and re.search(rf"{month}#\d+ <= 199705", filters), filters


def test_the_layout_comes_and_goes_without_losing_rows(spark, ledgers, tmp_path):
    plain, laid_out = ledgers
    back = laid_out.without_layout()
    assert laid_out.laid_out and not back.laid_out and not plain.laid_out
    for attr in ("ko", "ko_line", "open", "matched"):
        want = getattr(plain, attr)
        assert sorted(getattr(back, attr).columns) == sorted(want.columns)
        assert rows(getattr(back, attr), want.columns) == rows(want, want.columns)
    laid_out.write_parquet(str(tmp_path / "parquet"))
    assert not Ledger.from_parquet(spark, str(tmp_path / "parquet")).laid_out


def test_lines_without_a_ko_and_kos_without_a_date_stay(spark, ledgers, tmp_path):
    plain = ledgers[0]
    stray = plain.ko_line.limit(1).withColumn("ko_gid", F.lit(-1).cast("bigint"))
    undated = plain.ko.limit(1).withColumns({"ko_gid": F.lit(-2).cast("bigint"), "ko_date": F.lit(None).cast("date")})
    odd = replace(plain, ko_line=stray, ko=undated)
    spark.sql(f"create database odd location '{tmp_path}/db'")
    odd.write_catalog("odd", 2, str(tmp_path / "tables"))
    again = Ledger.from_catalog(spark, "odd")
    assert [r.ko_gid for r in again.ko_line.collect()] == [-1] and [r.ko_gid for r in again.ko.collect()] == [-2]
    assert ko_line_fact(again, scope_by_code(again, PERIOD.as_of_col), PERIOD).count() == 0
