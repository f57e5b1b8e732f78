"""What keeps a run's tasks and the driver bounded as its tables grow."""

from datetime import date

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.operators import groups as gr
from ledgermatch.plans import matching as mt
from ledgermatch.sources.fixtures import Fixtures
from ledgermatch.sources.rounds import RunFolder
from tests.test_matching import kos, left_over, rule, trans
from tests.test_plans import plan


def pairs(spark, keys):
    rows = [(2 * k, "A", f"k{k}", 5) for k in range(keys)] + [(2 * k + 1, "B", f"k{k}", 5) for k in range(keys)]
    return trans(spark, rows)


def test_tasks_of_a_stretch_are_numbered_by_rows(spark, monkeypatch):
    monkeypatch.setattr(gr, "TASK_ROWS", 20)
    (groups, part), = gr.split_by_size(pairs(spark, 200), ["ref_no"], RunFolder(spark))
    placed = groups.prepare(part)
    assert placed.rdd.getNumPartitions() == 20
    assert max(r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 60
    state = mt.run_rules(pairs(spark, 200), [rule()])[0]
    assert len(kos(state)) == 200


def test_chunks_have_no_more_rows_than_a_task(spark, monkeypatch):
    monkeypatch.setattr(gr, "TASK_ROWS", 10)
    rows = trans(spark, [(k, "AB"[k % 2], "k", 5, k % 9) for k in range(100)])
    folder = RunFolder(spark)
    (_, none), (groups, part) = gr.split_by_size(rows, ["ref_no"], folder, 50)
    chunks = groups.prepare(part).groupBy(gr.CHUNK).count().collect()
    assert none.count() == 0 and len(chunks) >= 9


@pytest.mark.parametrize("amounts", [1, 3, 200])
def test_amounts_of_a_large_group_fit_a_task_or_go_by_chunks(spark, amounts):
    """Rows of one amount are a large group of their own, or small ones; closed rows come along."""
    rows = [(k, "AB"[k % 2], "k", 5 + (k // 2) % amounts, k % 7) for k in range(300)] + [(900, "C", "k", 5)]
    first, second = rule(), rule(rule_code="R2", group_flag="OTO", order=2)
    found = [mt.run_rules(trans(spark, rows), [first, second], hot_rows=n)[0] for n in (40, 1_000_000)]
    assert kos(found[0]) == kos(found[1]) and len(kos(found[0])) == 150
    assert left_over(found[0]) == left_over(found[1])


def test_tables_of_trans_are_not_sent_to_all_tasks(spark):
    """Parents and breakups look small enough here, as large ones with small files do."""
    parents = trans(spark, [(100, "A", "k", 9), (101, "B", "k", 9)])
    subs = trans(spark, [(1, "A", "x", 4), (2, "A", "x", 5)]).withColumn("parent_gid", F.col("tran_gid") + 99)
    seen = []

    class Kept(RunFolder):
        def table(self, df, name, by=None):
            seen.append(plan(df))
            return super().table(df, name, by)

    mt.within_parents(mt.with_state(subs), mt.with_state(parents), 1_000_000, Kept(spark))
    text = "\n".join(seen)
    assert text.count("SortMergeJoin") == 2 and "BroadcastExchange" not in text


def test_feeds_are_derived_once(spark):
    views = Fixtures(spark, "/root/testdata/sf0.001")
    text = plan(views["fx_mtm_feed"])
    assert "Window" not in text and "Join" not in text
    assert views["fx_mtm_feed"] is views["fx_mtm_feed"] and views["fx_mtm_feed"].filter(F.col("tran_date") < date(1990, 1, 1)).count() == 0


def test_groups_are_counted_by_key_only_if_a_bucket_of_them_is_large(spark, monkeypatch):
    """More rows than a large group has, but no group near it: one count, no table of groups."""
    monkeypatch.setattr(DataFrame, "count", lambda df: pytest.fail("rows are counted with their buckets"))
    assert gr.bucket_sizes(pairs(spark, 200), ["ref_no"])[0] == 400
    assert gr.hot_groups(pairs(spark, 200), ["ref_no"], RunFolder(spark), 50) is None
    (groups, _), = gr.split_by_size(pairs(spark, 200), ["ref_no"], RunFolder(spark), 50)
    assert groups.rows == 400


def written_by(spark, monkeypatch, run):
    """What ``run`` returns, and the plans of the tables it writes."""
    seen, table = [], RunFolder.table

    def kept(self, df, name, by=None):
        seen.append(plan(df))
        return table(self, df, name, by)

    monkeypatch.setattr(RunFolder, "table", kept)
    return run(), seen


def owned(spark, *parents):
    """Parents with the given open values, and breakups of 4 and 5 for each."""
    rows = [(100 + n, "A", "k", value) for n, value in enumerate(parents)]
    subs = [(10 * n + m, "A", "x", 4 + m) for n in range(len(parents)) for m in (0, 1)]
    breakups = trans(spark, subs).withColumn("parent_gid", F.floor(F.col("tran_gid") / 10) + 100)
    return mt.with_state(trans(spark, rows)), mt.with_state(breakups)


def test_breakups_stay_where_they_are_if_no_parent_is_short(spark, monkeypatch):
    parents, breakups = owned(spark, 9, 9)
    after, seen = written_by(spark, monkeypatch, lambda: mt.settled(breakups, parents, 1_000_000, RunFolder(spark)))
    assert len(seen) == 1
    assert sorted(after.select("tran_gid", "excp_value").collect()) == sorted(breakups.select("tran_gid", "excp_value").collect())


def test_breakups_of_closed_parents_are_not_put_in_order(spark):
    parents, breakups = owned(spark, 9, 0, 0)
    closed = mt.settled(breakups, parents, 1_000_000, RunFolder(spark))
    assert "Window" not in plan(closed)
    assert {r.tran_gid: int(r.excp_value) for r in closed.collect()} == {0: 4, 1: 5, 10: 0, 11: 0, 20: 0, 21: 0}
    parents, breakups = owned(spark, 9, 6, 0)
    after = mt.settled(breakups, parents, 1_000_000, RunFolder(spark))
    assert {r.tran_gid: int(r.excp_value) for r in after.collect()} == {0: 4, 1: 5, 10: 4, 11: 2, 20: 0, 21: 0}


def test_the_next_round_and_the_rest_come_from_one_join(spark, monkeypatch):
    state = mt.with_state(pairs(spark, 20))
    (own, others), seen = written_by(
        spark, monkeypatch, lambda: mt.frontier(state, state.filter("tran_gid < 4"), [rule()], RunFolder(spark))
    )
    assert sum(text.count("SortMergeJoin") for text in seen) == 1
    assert "Join" not in plan(own) and "Join" not in plan(others)
    assert (own.count(), others.count()) == (4, 36)


def test_passes_of_one_rule_sort_their_rows_once(spark):
    rows = [(k, "AAB"[k % 3], f"k{k // 6}", 5 + k % 3) for k in range(60)]
    both = rule(group_flag="MTM", partial=True)
    state = mt.run_rules(trans(spark, rows), [both])[0]
    assert plan(state).count(" Sort ") == 1
