"""Matching on hand-made tables, and small against chunked groups."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.state import ko_headers, ko_lines, ko_tables, state_split
from ledgermatch.plans.matching import Rule, key_classes, match_until_stable, plan_steps, run_rules

SCHEMA = (
    "tran_gid long, recon_code string, dataset_code string, ref_no string, tran_date date, tran_acc_mode string,"
    "tran_mult int, tran_value decimal(15,2), excp_value decimal(15,2), roundoff_value decimal(15,2)"
)
DAY = dt.date(2024, 1, 1)


def trans(spark, rows):
    """Rows: (id, dataset, key, value[, day offset[, recon]])."""
    data = []
    for gid, dataset, key, value, *rest in rows:
        day = DAY + dt.timedelta(days=rest[0] if rest else 0)
        recon = rest[1] if len(rest) > 1 else "R"
        mode, mult = ("D", -1) if dataset == "A" else ("C", 1)
        amount = D(str(value)).quantize(D("0.01"))
        data.append((gid, recon, dataset, key, day, mode, mult, amount, amount, D("0.00")))
    return spark.createDataFrame(data, SCHEMA)


def rule(**kw):
    return Rule(**{"rule_code": "R1", "recon_code": "R", "source": "A", "comparison": "B", **kw})


def left_over(state):
    return {r.tran_gid: r.excp_value for r in state.collect()}


def kos(state):
    groups = defaultdict(set)
    for r in ko_lines(state).collect():
        groups[r.ko_gid].add(r.tran_gid)
    return sorted(sorted(g) for g in groups.values())


def run(spark, rows, *rules, **kw):
    return run_rules(trans(spark, rows), rules, **kw)[0]


def test_equal_amounts_pair_by_rank_oldest_first(spark):
    rows = [(1, "A", "k", 5, 2), (2, "A", "k", 5, 0), (3, "A", "k", 5, 1), (4, "B", "k", 5, 9), (5, "B", "k", 5, 3)]
    state = run(spark, rows, rule())
    assert kos(state) == [[2, 5], [3, 4]]
    assert left_over(state)[1] == D("5.00")


def test_null_keys_and_other_recons_do_not_match(spark):
    rows = [(1, "A", None, 5), (2, "B", None, 5), (3, "A", "k", 5, 0, "X"), (4, "B", "k", 5, 0, "R")]
    assert kos(run(spark, rows, rule())) == []


def test_tolerance_takes_nearest_and_keeps_round_off(spark):
    rows = [(1, "A", "k", "10.00"), (2, "B", "k", "10.03"), (3, "B", "k", "9.98"), (4, "A", "k", "10.04")]
    state = run(spark, rows, rule(tolerance=D("0.05")))
    assert kos(state) == [[1, 3], [2, 4]]
    by_id = {r.tran_gid: r for r in state.collect()}
    assert by_id[1].excp_value == D("0.02") and by_id[1].roundoff_value == D("-0.02")
    assert by_id[4].excp_value == D("0.01") and by_id[3].excp_value == 0 and by_id[2].excp_value == 0


def test_tolerance_pairs_many_equal_amounts_at_once(spark):
    rows = [(i, "A", "k", "1.00") for i in range(1, 6)] + [(i, "B", "k", "1.01") for i in range(11, 14)]
    state = run(spark, rows, rule(tolerance=D("0.01")))
    assert len(kos(state)) == 3


def test_one_to_many_with_residue_on_largest_row(spark):
    rows = [(1, "A", "k", "10.00"), (2, "B", "k", "6.00"), (3, "B", "k", "4.02")]
    state = run(spark, rows, rule(group_flag="OTM", tolerance=D("0.05")))
    assert kos(state) == [[1, 2, 3]]
    assert left_over(state) == {1: D("0.00"), 2: D("0.02"), 3: D("0.00")}


def test_many_to_many_needs_several_on_both_sides_then_tries_one_to_many(spark):
    rows = [(1, "A", "k", 3), (2, "A", "k", 4), (3, "B", "k", 5), (4, "B", "k", 2), (5, "A", "m", 9), (6, "B", "m", 4), (7, "B", "m", 5)]
    state = run(spark, rows, rule(group_flag="MTM"))
    assert kos(state) == [[1, 2, 3, 4], [5, 6, 7]]


def test_partial_is_first_in_first_out(spark):
    rows = [(1, "A", "k", 5, 1), (2, "A", "k", 5, 0), (3, "A", "k", 5, 2), (4, "B", "k", 7)]
    state = run(spark, rows, rule(group_flag="", partial=True))
    assert left_over(state) == {1: D("3.00"), 2: D("0.00"), 3: D("5.00"), 4: D("0.00")}


def test_rules_run_in_order_and_share_what_is_left(spark):
    rows = [(1, "A", "k", 5), (2, "B", "k", 5), (3, "A", "k", 8), (4, "B", "k", 6)]
    rules = [rule(rule_code="R2", order=D(2), group_flag="", partial=True), rule(rule_code="R1", order=D(1))]
    state = run(spark, rows, *rules)
    codes = {r.tran_gid: r.rule_code for r in ko_lines(state).collect()}
    assert codes == {1: "R1", 2: "R1", 3: "R2", 4: "R2"}
    assert left_over(state)[3] == D("2.00")


def test_rule_within_one_dataset_sets_debits_against_credits(spark):
    df = trans(spark, [(1, "A", "k", 5), (2, "A", "k", 5)])
    df = df.withColumn("tran_acc_mode", F.when(F.col("tran_gid") == 2, "C").otherwise("D"))
    assert kos(run_rules(df, [rule(comparison="A")])[0]) == [[1, 2]]


def test_rules_that_only_propose_leave_the_state_alone(spark):
    state = run(spark, [(1, "A", "k", 5), (2, "B", "k", 5)], rule(commit=False))
    assert left_over(state) == {1: D("5.00"), 2: D("5.00")}
    assert ko_lines(state).count() == 0
    assert ko_lines(state, "proposals").count() == 2


def test_probable_rules_ignore_the_period(spark):
    df = trans(spark, [(1, "A", "k", 5), (2, "B", "k", 5)]).withColumn("in_period", F.lit(False))
    assert ko_lines(run_rules(df, [rule()])[0]).count() == 0
    state = run_rules(df, [rule(commit=False, probable=True)])[0]
    assert ko_lines(state, "proposals").count() == 2


def test_several_keys_and_a_change_of_keys(spark):
    rows = [(1, "A", "k", 5), (2, "B", "k", 5), (3, "A", "p", 5), (4, "B", "q", 5)]
    df = trans(spark, rows).withColumn("branch", F.lit("b"))
    rules = [rule(keys=("ref_no", "branch")), rule(rule_code="R2", order=D(2), keys=("branch",))]
    assert kos(run_rules(df, rules)[0]) == [[1, 2], [3, 4]]


def test_breakups_roll_up_to_their_trans(spark):
    parents = trans(spark, [(100, "A", "k", 9), (200, "B", "k", 4)])
    subs = trans(spark, [(1, "A", "k", 4), (2, "A", "k", 5), (3, "B", "k", 4)])
    subs = subs.withColumn("parent_gid", F.when(F.col("dataset_code") == "A", 100).otherwise(200).cast("long"))
    state, sub = run_rules(parents, [rule(apply_on="S")], subs)
    assert left_over(state) == {100: D("5.00"), 200: D("0.00")}
    assert {r.parent_gid for r in ko_lines(sub).collect()} == {100, 200}


def test_fixpoint_matches_more_and_then_stops(spark):
    rows = [(1, "A", "k", "1.00"), (2, "B", "k", "1.01"), (3, "A", "k", "1.02"), (4, "B", "k", "1.03")]
    rules = [rule(tolerance=D("0.01"))]
    once = run(spark, rows, *rules)
    assert kos(once) == [[1, 2]]
    stable = match_until_stable(trans(spark, rows), rules)
    assert stable.converged and stable.rounds == 3
    assert kos(stable.trans) == [[1, 2], [3, 4]]
    again = match_until_stable(stable.trans.drop("allocs", "proposals"), rules)
    assert again.rounds == 1 and ko_lines(again.trans).count() == 0


def test_round_limit_is_reported(spark):
    rows = [(1, "A", "k", 5), (2, "B", "k", 5)]
    assert not match_until_stable(trans(spark, rows), [rule()], max_rounds=1).converged


def test_steps_are_shared_between_recons(spark):
    rules = [rule(recon_code=r, rule_code=f"{r}1", group_flag="MTM") for r in ("R", "S", "T")]
    steps = plan_steps(rules)
    assert [(s.kind, len(s.rules)) for s in steps] == [("MTM", 3), ("OTM", 3)]


def random_rows(seed, count=120):
    rng = random.Random(seed)
    return [
        (i, rng.choice("AB"), rng.choice(["hot", "hot", "hot", "x", "y", "z"]), D(rng.randint(100, 140)) / 100, rng.randint(0, 5))
        for i in range(1, count + 1)
    ]


RULE_SETS = {
    "exact": [rule()],
    "tolerance": [rule(tolerance=D("0.02"))],
    "groups": [rule(group_flag="MTM", tolerance=D("5.00"))],
    "partial": [rule(group_flag="", partial=True)],
    "in_order": [rule(), rule(rule_code="R2", order=D(2), tolerance=D("0.03")), rule(rule_code="R3", order=D(3), group_flag="", partial=True)],
}


@pytest.mark.parametrize("name", sorted(RULE_SETS))
def test_chunked_groups_give_the_same_answer(spark, name):
    rows = random_rows(7)
    plain = run(spark, rows, *RULE_SETS[name])
    cut = run_rules(trans(spark, rows).repartition(5), RULE_SETS[name], hot_rows=8)[0]
    key = ["tran_gid", "excp_value", "roundoff_value", F.col("allocs").cast("string").alias("allocs")]
    assert sorted(plain.select(*key).collect()) == sorted(cut.select(*key).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_values_are_conserved(spark, seed):
    rows = random_rows(seed)
    state = run(spark, rows, *RULE_SETS["in_order"]).cache()
    lines = ko_lines(state)
    taken = {r.tran_gid: r.s for r in lines.groupBy("tran_gid").agg(F.sum("ko_value").alias("s")).collect()}
    for r in state.collect():
        assert r.tran_value - r.excp_value == taken.get(r.tran_gid, D(0))
        assert r.excp_value >= 0
    for h in ko_headers(lines).collect():
        assert h.dr_value == h.cr_value
    still, gone = state_split(state)
    assert still.count() + gone.count() == len(rows)
    headers, details = ko_tables(lines, F.lit(DAY), 1)
    assert headers.count() == headers.select("ko_gid").distinct().count()
    assert details.count() == details.select("kodtl_gid").distinct().count() == lines.count()


def test_exact_pairs_against_brute_force(spark):
    rows = random_rows(11)
    sides = defaultdict(lambda: {"A": [], "B": []})
    for gid, dataset, key, value, day in rows:
        sides[key, value][dataset].append((day, gid))
    want = sorted(
        sorted((a[1], b[1]))
        for s in sides.values()
        for a, b in zip(sorted(s["A"]), sorted(s["B"]), strict=False)
    )
    assert kos(run(spark, rows, rule())) == want


def with_breakups(spark):
    """Two parents of 9.00 with breakups of 4.00 and 5.00 each."""
    parents = trans(spark, [(100, "A", "k", 9), (200, "B", "k", 9)])
    subs = trans(spark, [(1, "A", "k", 4), (2, "A", "m", 5), (3, "B", "k", 4), (4, "B", "n", 5)])
    return parents, subs.withColumn("parent_gid", F.when(F.col("dataset_code") == "A", 100).otherwise(200).cast("long"))


def on_trans(**kw):
    return rule(rule_code="T1", **kw)


def on_breakups(**kw):
    return rule(rule_code="S1", apply_on="S", **kw)


def test_breakups_of_closed_parents_do_not_match(spark):
    state, sub = run_rules(with_breakups(spark)[0], [on_trans(order=D(1)), on_breakups(order=D(2))], with_breakups(spark)[1])
    assert set(left_over(state).values()) == {D("0.00")} == set(left_over(sub).values())
    assert ko_lines(sub).count() == 0


def test_trans_are_matched_for_what_their_breakups_left(spark):
    rules = [on_breakups(order=D(1)), on_trans(order=D(2))]
    state, sub = run_rules(with_breakups(spark)[0], rules, with_breakups(spark)[1])
    assert set(left_over(state).values()) == {D("0.00")}
    assert sum(r.ko_value for r in ko_lines(state).collect()) == 10
    assert sum(r.ko_value for r in ko_lines(sub).collect()) == 8


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_partly_matched_parents_leave_their_first_breakups(spark, hot_rows):
    parents = trans(spark, [(100, "A", "k", 20), (200, "B", "k", 6), (300, "B", "z", 20)])
    subs = trans(spark, [(i, "A", "k", 4, i) for i in range(1, 6)] + [(20 + i, "B", "k", 4, i) for i in range(1, 6)])
    subs = subs.withColumn("parent_gid", F.when(F.col("dataset_code") == "A", 100).otherwise(300).cast("long"))
    rules = [rule(rule_code="T1", order=D(1), group_flag="", partial=True), on_breakups(order=D(2), group_flag="", partial=True)]
    state, sub = run_rules(parents, rules, subs, hot_rows=hot_rows)
    assert left_over(state) == {100: D("0.00"), 200: D("0.00"), 300: D("6.00")}
    assert sum(r.ko_value for r in ko_lines(sub).collect()) == 28
    stable = match_until_stable(parents, rules, subs, hot_rows=hot_rows)
    assert stable.converged and left_over(stable.trans) == left_over(state)


def test_breakups_keep_their_value_over_rounds(spark):
    parents, subs = with_breakups(spark)
    stable = match_until_stable(parents, [on_breakups(order=D(1)), on_trans(order=D(2))], subs)
    taken = defaultdict(D)
    for r in ko_lines(stable.breakups).collect():
        taken[r.parent_gid] += r.ko_value
    for r in ko_lines(stable.trans).collect():
        taken[r.tran_gid] += r.ko_value
    assert dict(taken) == {100: D("9.00"), 200: D("9.00")} and stable.breakups.count() == 4


def test_long_chains_are_matched_to_their_end(spark):
    rows = [(k, "AB"[k % 2], "k", D("1.00") + D(k) / 100) for k in range(1, 43)]
    stable = match_until_stable(trans(spark, rows), [rule(tolerance=D("0.01"))])
    assert stable.converged and stable.rounds > 20
    assert kos(stable.trans) == [[k, k + 1] for k in range(1, 43, 2)]


def test_jobs_give_different_ids(spark):
    rows = [(1, "A", "k", 5), (2, "B", "k", 5)]
    first, again, other = (run(spark, rows, rule(), job_gid=j) for j in (1, 1, 2))
    ids = [{r.ko_gid for r in ko_lines(s).collect()} for s in (first, again, other)]
    assert ids[0] == ids[1] != ids[2]


def test_proposals_use_up_what_they_take(spark):
    rows = [(1, "A", "k", 5), (2, "B", "k", 5), (3, "A", "k", 8), (4, "B", "k", 6)]
    rules = [rule(commit=False, partial=True), rule(rule_code="R2", order=D(2), commit=False)]
    state = run(spark, rows, *rules)
    lines = ko_lines(state, "proposals").collect()
    taken = defaultdict(D)
    for r in lines:
        taken[r.rule_code, r.tran_gid] += r.ko_value
    assert dict(taken) == {("R1", 1): 5, ("R1", 2): 5, ("R1", 3): 6, ("R1", 4): 6, ("R2", 1): 5, ("R2", 2): 5}
    assert left_over(state) == {1: D("5.00"), 2: D("5.00"), 3: D("8.00"), 4: D("6.00")}


def test_reversals_match_reversals_only(spark):
    rows = [(1, "A", "k", -5), (2, "B", "k", -5), (3, "A", "k", 5), (4, "B", "m", -3), (5, "A", "m", 3), (6, "B", "p", "-2.01"), (7, "A", "p", -2)]
    state = run(spark, rows, rule(tolerance=D("0.01")))
    assert kos(state) == [[1, 2], [6, 7]]
    by_id = {r.tran_gid: r for r in state.collect()}
    assert by_id[6].excp_value == D("-0.01") and by_id[6].excp_value == by_id[6].roundoff_value * by_id[6].tran_mult
    assert by_id[3].excp_value == 5 and by_id[4].excp_value == -3


def test_partial_passes_follow_each_full_pass():
    assert rule(group_flag="MTM", partial=True).passes() == ["MTM", "PARTIAL", "OTM", "PARTIAL"]


def test_recons_with_other_keys_are_other_classes(spark):
    rules = [
        rule(recon_code=r, rule_code=f"{r}{k}", order=D(k), keys=keys)
        for r, keys in (("R", ("ref_no",)), ("S", ("branch",)), ("T", ("ref_no",)))
        for k in range(4)
    ]
    classes = key_classes(rules)
    assert [sorted({x.recon_code for x in own}) for own in classes] == [["S"], ["R", "T"]]
    # Each class has a single stretch: its keys never change.
    assert [len({s.keys for s in plan_steps(own)}) for own in classes] == [1, 1]
    rows = [(1, "A", "k", 5, 0, "R"), (2, "B", "k", 5, 0, "R"), (3, "A", "x", 5, 0, "S"), (4, "B", "y", 5, 0, "S"), (5, "A", "k", 5, 0, "U")]
    df = trans(spark, rows).withColumn("branch", F.lit("b"))
    state, _ = run_rules(df, rules)
    assert kos(state) == [[1, 2], [3, 4]] and state.count() == 5
