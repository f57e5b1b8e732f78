"""Rounds until nothing more matches: whole chains at once, groups that changed only, recons that leave."""

import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgermatch.operators.state import ko_lines
from ledgermatch.plans import matching as mt
from ledgermatch.sources.rounds import RunFolder
from tests.test_matching import kos, left_over, rule, trans


def chain_rows(seed, groups, levels, gaps):
    """Amounts of random gaps on random sides, now and then several rows of one amount."""
    pick, rows, gid = random.Random(seed), [], 0
    for g in range(groups):
        at, side = D("10.00"), 0
        for _ in range(pick.randint(2, levels)):
            at += D(pick.choice(gaps)) / 100
            side = 1 - side if pick.random() < 0.85 else side
            for _ in range(pick.choice((1, 1, 1, 1, 2))):
                gid += 1
                rows.append((gid, "AB"[side], f"k{g}", at))
    return rows


def test_whole_chains_are_what_rounds_find(spark):
    rows = chain_rows(1, 100, 12, (1, 1, 1, 2, 3, 4, 5)) + [
        (100_000 + i, d, f"z{k}", v) for i, d, k, v in chain_rows(2, 60, 14, (2, 3, 4, 5, 7, 9))
    ]
    rows = [(i, d, k.replace("zk", "z"), v) for i, d, k, v in rows]
    rules = [rule(tolerance=D("0.05"))]
    table = trans(spark, rows)
    plain, whole = (mt.match_until_stable(table, rules, chains=c) for c in (False, True))
    assert kos(plain.trans) == kos(whole.trans)
    assert left_over(plain.trans) == left_over(whole.trans)
    first = [ko_lines(s.trans).where("round = 1").count() for s in (plain, whole)]
    assert plain.converged and whole.converged and whole.rounds <= plain.rounds and first[0] < first[1]


def test_a_long_chain_is_paired_in_one_round(spark):
    rows = [(k, "AB"[k % 2], "k", D("1.00") + D(k) / 100) for k in range(1, 203)]
    stable = mt.match_until_stable(trans(spark, rows), [rule(tolerance=D("0.01"))], chains=True)
    assert stable.converged and stable.rounds == 2
    assert kos(stable.trans) == [[k, k + 1] for k in range(1, 203, 2)]


def test_a_round_reads_groups_that_changed(spark, monkeypatch):
    """One chain takes five rounds; the quiet groups beside it are read in the first one only."""
    rows = [(k, "AB"[k % 2], "chain", D("1.00") + D(k) / 100) for k in range(1, 9)]
    rows += [(1000 + k, "A", f"quiet{k}", 5) for k in range(50)]
    seen = []
    steps = mt._run_steps
    monkeypatch.setattr(mt, "_run_steps", lambda state, *a: (seen.append(state.count()), steps(state, *a))[1])
    stable = mt.match_until_stable(trans(spark, rows), [rule(tolerance=D("0.01"))])
    assert stable.converged and seen == [58, 6, 4, 2] + ([0] if stable.rounds == 5 else [])
    assert stable.trans.count() == 58 and len(left_over(stable.trans)) == 58


def test_rows_at_rest_come_back_when_another_key_wakes_them(spark):
    """Rules on two keys: a match on the first key lets one on the second happen a round later."""
    rows = [(1, "A", "p", "1.00"), (2, "B", "p", "1.01"), (3, "A", "p", "1.02"), (4, "B", "p", "1.03"), (5, "A", "q", 9), (6, "B", "r", 9), (7, "A", "s", 4)]
    branch = {1: "m", 2: "n", 3: "o", 4: "x", 5: "x", 6: "y", 7: "w"}
    df = trans(spark, rows)
    df = df.withColumn("branch", F.element_at(F.create_map(*[F.lit(v) for kv in branch.items() for v in kv]), F.col("tran_gid").cast("int")))
    rules = [rule(tolerance=D("0.01")), rule(rule_code="R2", order=D(2), group_flag="MTM", keys=("branch",))]
    stable = mt.match_until_stable(df, rules)
    assert stable.converged and kos(stable.trans) == [[1, 2], [3, 4]]
    assert stable.trans.count() == 7 and stable.trans.select("tran_gid").distinct().count() == 7


def test_recons_leave_the_loop_one_by_one(spark):
    rows = [(k, "AB"[k % 2], "k", D("1.00") + D(k) / 100, 0, "R") for k in range(1, 7)]
    rows += [(100 + k, "AB"[k % 2], "k", D("1.00") + D(k) / 100, 0, "Q") for k in range(1, 3)]
    rows += [(200, "A", "k", 7, 0, "P"), (300, "A", "k", 7, 0, "none")]
    rules = [rule(recon_code=r, tolerance=D("0.01")) for r in "RQP"]
    stable = mt.match_until_stable(trans(spark, rows), rules)
    assert {r.recon_code: (r.rounds, r.converged) for r in stable.recons.collect()} == {"R": (4, True), "Q": (2, True), "P": (1, True)}
    assert stable.trans.count() == 10
    cut = mt.match_until_stable(trans(spark, rows), rules, max_rounds=2)
    assert {r.recon_code: (r.rounds, r.converged) for r in cut.recons.collect()} == {"R": (2, False), "Q": (2, True), "P": (1, True)}
    assert cut.trans.count() == 10


def test_proposals_outlast_the_rounds_of_others(spark):
    """Rows at rest keep what was proposed on them."""
    rows = [(k, "AB"[k % 2], "k", D("1.00") + D(k) / 100) for k in range(1, 7)]
    rows += [(11, "A", "quiet", 5), (12, "B", "quiet", "5.50")]
    rules = [rule(tolerance=D("0.01")), rule(rule_code="P", order=D(2), tolerance=D("0.50"), commit=False)]
    stable = mt.match_until_stable(trans(spark, rows), rules)
    assert {r.tran_gid for r in ko_lines(stable.trans, "proposals").collect()} == {11, 12}


def test_frontier_of_two_keys(spark):
    rows = [(1, "A", "p", 1), (2, "B", "p", 2), (3, "A", "q", 3), (4, "B", None, 4)]
    df = trans(spark, rows).withColumn("branch", F.expr("element_at(array('x', 'y', 'x', 'y'), cast(tran_gid as int))"))
    rules = [rule(), rule(rule_code="R2", keys=("branch",))]
    own, others = mt.frontier(df, df.where("tran_gid = 1"), rules, RunFolder(spark))
    assert {r.tran_gid for r in own.collect()} == {1, 2, 3} and [r.tran_gid for r in others.collect()] == [4]
