"""Registered queries: one per operator or report, each over whole tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions import predicates as p
from ledgermatch.functions.money import TOTAL
from ledgermatch.operators import scope as sc
from ledgermatch.operators import universe as un
from ledgermatch.operators.keys import key_normalise
from ledgermatch.operators.state import ko_headers, ko_lines, state_fingerprint, state_split
from ledgermatch.params import Period
from ledgermatch.plans import dashboard as db
from ledgermatch.plans import matching as mt
from ledgermatch.plans import recon as rc
from ledgermatch.plans import rollup as ru
from ledgermatch.plans import runs as rn
from ledgermatch.plans import summary as sm
from ledgermatch.plans import values as vl
from ledgermatch.plans.deltas import DeltaLog
from ledgermatch.sources.fixtures import Fixtures
from ledgermatch.sources.ledger import Ledger
from ledgermatch.sources.rounds import LedgerFolder, RunFolder, at_size

PERIOD = Period(dt.date(1997, 1, 1), dt.date(1997, 12, 31), dt.date(1998, 1, 1))
UNIT = "L"
#: Periods that one roll-up answers: a year, one that begins and ends within a month, and all there is.
PERIODS = {
    "year": PERIOD,
    "within": Period(dt.date(1996, 3, 15), dt.date(1996, 7, 10), dt.date(1998, 1, 1)),
    "all": Period(dt.date(1990, 1, 1), dt.date(2005, 12, 31), dt.date(1998, 1, 1)),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Case:
    """Fixture ledger, scope and derived facts of one run of a query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.fx = Fixtures(spark, sf_dir)
        self.ledger = self.fx.ledger
        self.as_of = PERIOD.as_of_col
        self.scope = sc.scope_by_code(self.ledger, self.as_of)

    def universe(self) -> DataFrame:
        return un.tran_universe(self.ledger, self.scope, PERIOD)

    def fact(self) -> DataFrame:
        return un.ko_line_fact(self.ledger, self.scope, PERIOD)

    def figures(self, sides: bool = False) -> DataFrame:
        return sm.rule_figures(self.fact(), sides)

    def tran_totals(self) -> DataFrame:
        """Trans and value per recon, so that a query on configuration has data behind it."""
        return (
            p.live(self.ledger.all_trans())
            .groupBy("recon_code")
            .agg(F.count(F.lit(1)).alias("tran_count"), F.sum("tran_value").cast(TOTAL).alias("tran_value"))
        )

    def rules(self) -> list[mt.Rule]:
        return mt.load_rules(self.ledger, self.as_of, self.scope)

    def matched(self) -> DataFrame:
        """The outcome as a table, as a run leaves it: reports read it more than once."""
        return RunFolder(self.fx.spark).table(mt.run_rules(self.fx["fx_feed"], self.rules())[0], "trans")


def query(fn: Callable[[Case], DataFrame]) -> Callable[[Case], DataFrame]:
    """Register a query under its function's name (a trailing ``_query`` is not part of it)."""
    QUERIES[fn.__name__.removesuffix("_query")] = lambda spark, sf_dir: fn(Case(spark, sf_dir))
    return fn


# --- scope and scans ---------------------------------------------------------------------------


@query
def scope_by_code(c: Case) -> DataFrame:
    return c.scope.join(c.tran_totals(), "recon_code", "left")


@query
def scope_by_user(c: Case) -> DataFrame:
    users = [sc.scope_by_user(c.ledger, c.as_of, u).withColumn("user_code", F.lit(u)) for u in ("U1", "U2")]
    return users[0].unionByName(users[1]).join(c.tran_totals(), "recon_code", "left")


@query
def eligible_recons(c: Case) -> DataFrame:
    return sc.eligible_recons(c.ledger, c.as_of).join(c.tran_totals(), "recon_code", "left")


@query
def active_rules(c: Case) -> DataFrame:
    used = p.live(c.ledger.ko).groupBy("rule_code").agg(F.count(F.lit(1)).alias("ko_count"))
    rules = sc.active_rules(c.ledger, c.as_of).select(
        "rule_code", "recon_code", "rule_order", "rule_apply_on", "group_flag", "system_match_flag", "probable_match_flag"
    )
    return rules.join(used, "rule_code", "left")


@query
def dataset_count(c: Case) -> DataFrame:
    return sc.dataset_count(c.ledger, c.scope).join(c.tran_totals(), "recon_code", "left")


@query
def open_in_window(c: Case) -> DataFrame:
    return un.in_window(c.ledger.open, c.scope, PERIOD)


@query
def matched_in_window(c: Case) -> DataFrame:
    return un.in_window(c.ledger.matched, c.scope, PERIOD)


@query
def open_by_load_date(c: Case) -> DataFrame:
    return un.by_load(c.ledger.open, un.loads_in(c.ledger, PERIOD), c.scope, matched=False)


@query
def matched_by_load_date(c: Case) -> DataFrame:
    return un.by_load(c.ledger.matched, un.loads_in(c.ledger, PERIOD), c.scope, matched=True)


@query
def opening_exceptions(c: Case) -> DataFrame:
    return un.opening_exceptions(c.ledger, c.scope, PERIOD)


@query
def tran_universe(c: Case) -> DataFrame:
    return c.universe()


@query
def universe_collisions(c: Case) -> DataFrame:
    return un.universe_collisions(c.ledger, c.scope, PERIOD)


@query
def ko_detail(c: Case) -> DataFrame:
    return un.ko_detail(c.ledger, c.universe(), PERIOD)


@query
def value_universe(c: Case) -> DataFrame:
    return un.value_universe(c.ledger, c.scope)


@query
def ko_line_fact(c: Case) -> DataFrame:
    return c.fact().drop("source_dataset_code", "comparison_dataset_code")


@query
def ko_line_fact_sides(c: Case) -> DataFrame:
    return c.fact().select("kodtl_gid", "tran_gid", "dataset_code", "source_dataset_code", "comparison_dataset_code")


# --- predicates --------------------------------------------------------------------------------


@query
def net_exceptions(c: Case) -> DataFrame:
    trans = p.live(c.ledger.all_trans()).filter(p.net_exception())
    return trans.select("recon_code", "tran_gid", "excp_value", p.net_open().cast(TOTAL).alias("net_value"))


@query
def partial_exceptions(c: Case) -> DataFrame:
    return c.universe().filter(p.partial_count(PERIOD)).select("recon_code", "tran_gid", "tran_value", "excp_value")


@query
def fully_open(c: Case) -> DataFrame:
    return un.value_universe(c.ledger, c.scope).filter(p.fully_open(F.col("tran_value"), F.col("excp_value"))).select("recon_code", "tran_gid", "excp_value")


@query
def configured_date_filter(c: Case) -> DataFrame:
    recons = sc.eligible_recons(c.ledger, c.as_of)
    marked = mt.configured_date_filter(p.live(c.ledger.open), recons, PERIOD, mt.date_fields(recons))
    return marked.select("recon_code", "tran_gid", "tran_date", "in_period")


# --- dashboards --------------------------------------------------------------------------------


@query
def dashboard_counts(c: Case) -> DataFrame:
    return db.dashboard_counts(c.ledger, c.scope, PERIOD)


@query
def dashboard_counts_scope(c: Case) -> DataFrame:
    return db.dashboard_counts_scope(c.ledger, c.scope, PERIOD)


@query
def ko_system_vs_manual(c: Case) -> DataFrame:
    return db.ko_split(c.ledger, c.universe(), PERIOD)


@query
def exception_aging(c: Case) -> DataFrame:
    return db.exception_aging(c.ledger, c.scope, PERIOD)


def _from_rollup(c: Case, report: Callable[..., DataFrame]) -> DataFrame:
    """A report of three periods from one roll-up, which is written once."""
    cells = RunFolder(c.fx.spark).table(ru.rollup(c.ledger), "rollup")
    parts = [
        report(cells, c.ledger, c.scope, period).withColumn("period", F.lit(name)) for name, period in PERIODS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dashboard_rollup(c: Case) -> DataFrame:
    return _from_rollup(c, ru.counts_of)


@query
def aging_rollup(c: Case) -> DataFrame:
    return _from_rollup(c, ru.aging_of)


def _percents(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n.startswith("p_")]


@query
def value_dashboard(c: Case) -> DataFrame:
    df = vl.value_dashboard(c.ledger, c.scope, PERIOD, UNIT)
    return df.drop(*_percents(df))


@query
def value_dashboard_percents(c: Case) -> DataFrame:
    df = vl.value_dashboard(c.ledger, c.scope, PERIOD, UNIT)
    return df.select("recon_code", *_percents(df))


# --- KO summaries ------------------------------------------------------------------------------


@query
def summ_header_rows(c: Case) -> DataFrame:
    return sm.header_rows(c.figures(), c.ledger)


@query
def summ_rule_rows(c: Case) -> DataFrame:
    return sm.line_rows(c.figures(), sm.RULE)


@query
def summ_manual_rows(c: Case) -> DataFrame:
    return sm.line_rows(c.figures(), sm.MANUAL).drop("rule_order")


@query
def summ_subtotal(c: Case) -> DataFrame:
    return sm.total_rows(c.figures(), by_dataset=True)


@query
def summ_grand_total(c: Case) -> DataFrame:
    return sm.total_rows(c.figures(), by_dataset=False).drop("dataset_code")


@query
def summ_rule_rows_by_recon(c: Case) -> DataFrame:
    return sm.line_rows(c.figures(), sm.RULE, by_dataset=False)


@query
def summ_subtotal_by_recon(c: Case) -> DataFrame:
    return sm.total_rows(c.figures(), by_dataset=False)


@query
def summ_default(c: Case) -> DataFrame:
    return sm.summary(c.ledger, c.scope, PERIOD, UNIT, "default")["default"]


def _laid_out(c: Case) -> Ledger:
    """The ledger in catalog tables, laid out by recon and month with lines and trans in buckets."""
    spark, folder = c.fx.spark, RunFolder(c.fx.spark).path
    database = f"laid_out_{uuid.uuid4().hex}"
    spark.sql(f"create database {database} location '{folder}/db'")
    c.ledger.write_catalog(database, int(spark.conf.get("spark.sql.shuffle.partitions")), folder)
    return Ledger.from_catalog(spark, database)


@query
def ko_line_fact_laid_out(c: Case) -> DataFrame:
    ledger = _laid_out(c)
    fact = un.ko_line_fact(ledger, sc.scope_by_code(ledger, c.as_of), PERIOD)
    return fact.drop("source_dataset_code", "comparison_dataset_code")


@query
def summ_default_laid_out(c: Case) -> DataFrame:
    ledger = _laid_out(c)
    return sm.summary(ledger, sc.scope_by_code(ledger, c.as_of), PERIOD, UNIT, "default")["default"]


@query
def summ_proof(c: Case) -> DataFrame:
    return sm.summary(c.ledger, c.scope, PERIOD, UNIT, "proof")["proof"]


@query
def summ_value_based(c: Case) -> DataFrame:
    return sm.summary(c.ledger, c.scope, PERIOD, "Cr", "value")["value"]


@query
def summ_non_value_based(c: Case) -> DataFrame:
    return sm.summary(c.ledger, c.scope, PERIOD, UNIT, "non_value")["non_value"]


@query
def summ_pivot(c: Case) -> DataFrame:
    return sm.summary(c.ledger, c.scope, PERIOD, UNIT, "pivot")["pivot"]


@query
def summ_dispatch(c: Case) -> DataFrame:
    rows = sm.summ_dispatch(c.ledger, c.scope, PERIOD, UNIT, "format2")
    return rows.select("layout", "recon_code", "section", "rec_slno", "row_label", "dr_count", "line_count", "target_cr_count")


@query
def summ_dispatch_money(c: Case) -> DataFrame:
    rows = sm.summ_dispatch(c.ledger, c.scope, PERIOD, UNIT, "format2")
    money = ("dr_value", "cr_value", "line_value", "target_dr_value", "target_cr_value")
    return rows.select("layout", "recon_code", "section", "rec_slno", *[F.col(m).cast(TOTAL).alias(m) for m in money])


# --- matching ----------------------------------------------------------------------------------


def _rules(c: Case, suffix: str = "M", **shape) -> list[mt.Rule]:
    """A rule of one shape for each recon there is."""
    codes = [r[0] for r in c.ledger.recon.select("recon_code").distinct().collect()]
    return [mt.Rule(f"{r}-{suffix}", r, source="GL", comparison="BNK", **shape) for r in sorted(codes)]


def _headers(trans: DataFrame, rules: list[mt.Rule]) -> DataFrame:
    """KOs of a single run; their ids are left out, members and sums say which they are."""
    state, _ = mt.run_rules(trans, rules)
    return ko_headers(ko_lines(state)).drop("ko_gid")


@query
def match_one_to_one(c: Case) -> DataFrame:
    return _headers(c.fx["fx_mtm_feed"], _rules(c, group_flag="OTO"))


@query
def match_one_to_one_tolerance(c: Case) -> DataFrame:
    return _headers(c.fx["fx_mtm_feed"], _rules(c, group_flag="OTO", tolerance=Decimal("2500.00")))


@query
def match_one_to_many(c: Case) -> DataFrame:
    return _headers(c.fx["fx_mtm_feed"], _rules(c, group_flag="OTM"))


@query
def match_many_to_many(c: Case) -> DataFrame:
    state, _ = mt.run_rules(c.fx["fx_mtm_feed"], _rules(c, group_flag="MTM"))
    return ko_headers(ko_lines(state).filter("step = 1")).drop("ko_gid")


@query
def match_mtm_then_otm(c: Case) -> DataFrame:
    return _headers(c.fx["fx_mtm_feed"], _rules(c, group_flag="MTM"))


@query
def match_partial(c: Case) -> DataFrame:
    state, _ = mt.run_rules(c.fx["fx_mtm_feed"], _rules(c, group_flag="", partial=True))
    return ko_lines(state).select("recon_code", "tran_gid", "ko_value", "ko_mult")


def _hot(c: Case, feed: str = "fx_hot", **shape) -> DataFrame:
    """A rule on keys with thousands of rows, in chunks of a thirtieth of the feed, so that every key is cut."""
    trans = c.fx[feed]
    state, _ = mt.run_rules(trans, _rules(c, **shape), hot_rows=max(20, trans.count() // 30))
    return state.select("recon_code", "tran_gid", "excp_value", "roundoff_value")


@query
def match_hot_one_to_one(c: Case) -> DataFrame:
    return _hot(c, group_flag="OTO")


@query
def match_hot_tolerance(c: Case) -> DataFrame:
    return _hot(c, group_flag="OTO", tolerance=Decimal("3.00"))


@query
def match_hot_one_to_many(c: Case) -> DataFrame:
    return _hot(c, "fx_hot_one", group_flag="OTM")


@query
def match_hot_many_to_many(c: Case) -> DataFrame:
    return _hot(c, group_flag="MTM")


@query
def match_hot_partial(c: Case) -> DataFrame:
    """One side lacks its smallest amounts, so that the other is left with some."""
    feed = c.fx["fx_hot"].filter("dataset_code = 'GL' or tran_value > 20000")
    state, _ = mt.run_rules(feed, _rules(c, group_flag="", partial=True), hot_rows=max(20, feed.count() // 30))
    return state.select("recon_code", "tran_gid", "excp_value", "roundoff_value")


@query
def match_breakup(c: Case) -> DataFrame:
    trans, _ = mt.run_rules(c.fx["fx_parent"], _rules(c, group_flag="OTO", apply_on="S"), c.fx["fx_mtm_feed"])
    return trans.select("recon_code", "tran_gid", "tran_value", "excp_value")


@query
def match_breakup_after_tran(c: Case) -> DataFrame:
    rules = _rules(c, "T", order=Decimal(1)) + _rules(c, "S", order=Decimal(2), apply_on="S")
    trans, _ = mt.run_rules(c.fx["fx_parent"], rules, c.fx["fx_mtm_feed"])
    return trans.select("recon_code", "tran_gid", "tran_value", "excp_value")


@query
def match_tran_after_breakup(c: Case) -> DataFrame:
    rules = _rules(c, "S", order=Decimal(1), apply_on="S") + _rules(c, "T", order=Decimal(2), group_flag="", partial=True)
    folder = RunFolder(c.fx.spark)
    trans, breakups = map(folder.scratch, mt.run_rules(c.fx["fx_parent"], rules, c.fx["fx_mtm_feed"], folder=folder))
    taken = ko_lines(breakups).groupBy("parent_gid").agg(F.sum("ko_value").alias("below"))
    own = ko_lines(trans).groupBy("tran_gid").agg(F.sum("ko_value").alias("own"))
    joined = trans.join(at_size(own), "tran_gid", "left").join(at_size(taken), F.col("tran_gid") == F.col("parent_gid"), "left")
    whole = F.col("excp_value") + F.coalesce("own", F.lit(0)) + F.coalesce("below", F.lit(0))
    return joined.select("recon_code", "tran_gid", whole.cast(TOTAL).alias("whole"), (F.col("excp_value") < 0).alias("below_zero"))


@query
def match_mtm_partial_otm(c: Case) -> DataFrame:
    state, _ = mt.run_rules(c.fx["fx_mtm_feed"], _rules(c, group_flag="MTM", partial=True))
    return state.select("recon_code", "tran_gid", "excp_value")


@query
def match_fixpoint_chain(c: Case) -> DataFrame:
    stable = mt.match_until_stable(c.fx["fx_chain"], _rules(c, tolerance=Decimal("0.01")))
    return stable.trans.select("recon_code", "tran_gid", "excp_value", "roundoff_value")


@query
def match_fixpoint_long_chain(c: Case) -> DataFrame:
    """Chains of 120 amounts, paired whole: a round that matches, and one that finds nothing more."""
    stable = mt.match_until_stable(c.fx["fx_long_chain"], _rules(c, tolerance=Decimal("0.01")), chains=True)
    return stable.trans.select("recon_code", "tran_gid", "excp_value", "roundoff_value", F.lit(stable.rounds).alias("rounds"))


@query
def converged_recons(c: Case) -> DataFrame:
    """Chains whose length depends on the recon, a pair a round: recons leave the loop one after the other."""
    stable = mt.match_until_stable(c.fx["fx_recon_chain"], _rules(c, tolerance=Decimal("0.01")))
    left = stable.trans.groupBy("recon_code").agg(F.sum(F.col("excp_value")).cast(TOTAL).alias("excp_value"))
    return stable.recons.join(left, "recon_code", "left")


@query
def match_reversals(c: Case) -> DataFrame:
    feed = c.fx["fx_feed"].withColumns({v: (-F.col(v)).cast("decimal(15,2)") for v in ("tran_value", "excp_value")})
    state, _ = mt.run_rules(feed, _rules(c, group_flag="OTO"))
    return state.select("recon_code", "tran_gid", "tran_value", "excp_value")


@query
def proposals_within_a_rule(c: Case) -> DataFrame:
    state, _ = mt.run_rules(c.fx["fx_feed"], _rules(c, group_flag="OTO", partial=True, commit=False, probable=True))
    lines = ko_lines(state, "proposals")
    return lines.groupBy("recon_code", "tran_gid").agg(F.sum("ko_value").cast(TOTAL).alias("proposed"))


@query
def ko_headers_two_runs(c: Case) -> DataFrame:
    runs = [mt.run_rules(c.fx["fx_feed"], c.rules(), job_gid=j)[0] for j in (1, 2)]
    lines = ko_lines(runs[0]).unionByName(ko_lines(runs[1]))
    return lines.groupBy("recon_code", "rule_code").agg(
        F.countDistinct("ko_gid").alias("ko_count"), F.count(F.lit(1)).alias("line_count")
    )


@query
def match_rules_in_order(c: Case) -> DataFrame:
    return c.matched().select("recon_code", "tran_gid", "tran_value", "excp_value", "roundoff_value")


@query
def match_fixpoint(c: Case) -> DataFrame:
    stable = mt.match_until_stable(c.fx["fx_feed"], c.rules())
    return ko_lines(stable.trans).select("recon_code", "tran_gid", "rule_code", "ko_value", "ko_mult", "roundoff_value")


@query
def state_split_query(c: Case) -> DataFrame:
    still, gone = state_split(c.matched())
    tagged = still.withColumn("place", F.lit("open")).unionByName(gone.withColumn("place", F.lit("matched")))
    return tagged.select("recon_code", "tran_gid", "place", "excp_value")


@query
def state_fingerprint_query(c: Case) -> DataFrame:
    return state_fingerprint(p.live(c.ledger.open))


# --- runs --------------------------------------------------------------------------------------


@query
def preview_state(c: Case) -> DataFrame:
    recons = sc.eligible_recons(c.ledger, c.as_of)
    return mt.preview_state(c.ledger, recons, PERIOD).select("recon_code", "tran_gid", "tran_date", "excp_value")


@query
def probable_state(c: Case) -> DataFrame:
    recons = sc.eligible_recons(c.ledger, c.as_of)
    return mt.probable_state(c.ledger, recons).select("recon_code", "tran_gid", "tran_date", "excp_value")


@query
def probable_preview(c: Case) -> DataFrame:
    """A probable rule on trans and one on their breakups."""
    own, split = F.col("rule_name") == "Exact", F.col("rule_name") == "Split"
    rule = c.ledger.rule.withColumns(
        {
            "rule_apply_on": F.when(split, "S").otherwise(F.col("rule_apply_on")),
            "group_flag": F.when(split, "OTO").otherwise(F.col("group_flag")),
            "probable_match_flag": F.when(own | split, "Y").otherwise(F.col("probable_match_flag")),
        }
    )
    below = c.fx["fx_mtm_feed"].select(
        F.col("tran_gid").alias("tranbrkp_gid"),
        F.col("parent_gid").alias("tran_gid"),
        "recon_code",
        F.col("dataset_code").alias("tranbrkp_dataset_code"),
        "ref_no",
        "tran_date",
        "tran_acc_mode",
        "excp_value",
        F.lit("N").alias("delete_flag"),
    )
    parents = c.fx["fx_parent"].withColumn("delete_flag", F.lit("N"))
    ledger = replace(c.ledger, rule=rule, open=parents, breakup=below)
    lines = mt.probable_preview(ledger, PERIOD, breakup_keys=["ref_no"])
    return lines.groupBy("recon_code", "rule_code", "tran_gid").agg(F.sum("ko_value").cast(TOTAL).alias("proposed"))


def _preview(c: Case) -> DataFrame:
    return rn.match_preview(ko_lines(c.matched()), p.live(c.ledger.rule), job_gid=1)


@query
def match_preview(c: Case) -> DataFrame:
    return _preview(c).drop("ko_gid")


@query
def matched_amount_report(c: Case) -> DataFrame:
    return rn.matched_amount_report(_preview(c))


@query
def run_stats(c: Case) -> DataFrame:
    breakups = p.live(c.ledger.breakup)
    return rn.run_stats(c.fx["fx_feed"], c.matched(), breakups, breakups)


@query
def exception_report(c: Case) -> DataFrame:
    return rn.exception_report(c.ledger, c.scope)


@query
def tally_check(c: Case) -> DataFrame:
    return rn.tally_check(c.ledger, c.scope, PERIOD)


@query
def key_normalise_query(c: Case) -> DataFrame:
    return key_normalise(c.fx["fx_messy"], ["ref_no"])


@query
def theme_reset(c: Case) -> DataFrame:
    recons = sc.eligible_recons(c.ledger, c.as_of)
    return mt.theme_reset(c.ledger.open, recons, PERIOD).select("recon_code", "tran_gid", "theme_code")


@query
def theme_tag(c: Case) -> DataFrame:
    themes = [
        ("PARTLY", F.col("excp_value") < F.col("tran_value")),
        ("LARGE", F.col("excp_value") >= 300000),
        ("AGED", F.datediff(PERIOD.as_of_col, "tran_date") > 365),
    ]
    return rn.theme_tag(p.live(c.ledger.open), themes).select("recon_code", "tran_gid", "theme_code")


def _before_run(c: Case) -> rc.Ledger:
    none = {"matched": c.fx["fx_open"].limit(0), "ko": c.ledger.ko.limit(0), "ko_line": c.ledger.ko_line.limit(0)}
    return replace(c.ledger, open=c.fx["fx_open"], **none)


@query
def run_refused(c: Case) -> DataFrame:
    return rc.refusals(_before_run(c), PERIOD)


@query
def run_outcome(c: Case) -> DataFrame:
    report = rc.run_recon(_before_run(c), PERIOD, job_gid=7, until_stable=True)
    return report.outcome.trans.select("recon_code", "tran_gid", "tran_value", "excp_value", "theme_code")


@query
def run_preview(c: Case) -> DataFrame:
    """Committing runs, one pass and until stable, whose second rule only proposes."""
    before = _before_run(c)
    probable = F.when(F.col("rule_name") == "Split", "Y").otherwise(F.col("probable_match_flag"))
    ledger = replace(before, rule=before.rule.withColumn("probable_match_flag", probable))
    runs = [
        rc.run_recon(ledger, PERIOD, job_gid=7, until_stable=stable).preview.withColumn("mode", F.lit(mode))
        for mode, stable in (("once", False), ("stable", True))
    ]
    return runs[0].unionByName(runs[1]).groupBy("mode", "recon_code", "rule_code").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("ko_value").cast(TOTAL).alias("ko_value")
    )


@query
def committed_tables(c: Case) -> DataFrame:
    after = rc.run_recon(_before_run(c), PERIOD, job_gid=7).ledger
    still = after.open.select("recon_code", "tran_gid", "excp_value", F.lit("open").alias("place"))
    gone = after.matched.select("recon_code", "tran_gid", "excp_value", F.lit("matched").alias("place"))
    kos = after.ko_line.groupBy("tran_gid").agg(F.sum("ko_value").cast(TOTAL).alias("ko_value"))
    return still.unionByName(gone).join(kos, "tran_gid", "left")


def _owned(c: Case, variant: str) -> rc.Ledger:
    """Parents with the feed's rows as breakups, and rules on trans only (T), on breakups and then on
    trans (ST), or on trans and then on breakups (TS)."""
    # rule name: what it applies to
    plan = {"T": {"Partial": "T"}, "ST": {"Exact": "S", "Partial": "T"}, "TS": {"Exact": "T", "Split": "S"}, "P": {"Split": "S", "Partial": "T"}}[variant]
    name = F.col("rule_name")
    applies = F.coalesce(*[F.when(name == n, F.lit(on)) for n, on in plan.items()])
    flag = F.when(name == "Split", "MTM" if variant == "P" else "OTO").otherwise(F.col("group_flag"))
    rule = c.ledger.rule.filter(name.isin(*plan)).withColumns({"rule_apply_on": applies, "group_flag": flag})
    more = {"theme_code": F.lit("OLD"), "delete_flag": F.lit("N")}
    # The feeds are tables, as a ledger has them, and have every column but these.
    below = c.fx["fx_mtm_feed"].select(
        F.col("tran_gid").alias("tranbrkp_gid"),
        F.col("parent_gid").alias("tran_gid"),
        "recon_code",
        F.col("dataset_code").alias("tranbrkp_dataset_code"),
        "ref_no",
        "tran_date",
        "tran_acc_mode",
        "excp_value",
    )
    parents = c.fx["fx_parent"].withColumns(more)
    none = {"matched": parents.limit(0), "ko": c.ledger.ko.limit(0), "ko_line": c.ledger.ko_line.limit(0)}
    return replace(c.ledger, rule=rule, open=parents, breakup=below.withColumns(more), **none)


@query
def committed_breakups(c: Case) -> DataFrame:
    """Breakups and what their parents have left, after runs with rules on trans only, last or first. A run's tables go as
    soon as they are written in the next form, so that there is no more than one run on the disk."""
    runs, names, result = [], None, LedgerFolder(c.fx.spark)
    for variant in ("T", "ST", "TS"):
        ledger, run, folder, left = _owned(c, variant), result.below(), result.below(), result.below()
        if names is None:
            refused = [r.recon_code for r in rc.refusals(ledger, PERIOD).collect()]
            names = [r.recon_code for r in c.scope.collect() if r.recon_code not in refused]
        outcome = mt.match(ledger, PERIOD, names, breakup_keys=["ref_no"], job_gid=7, folder=run)
        written = replace(outcome, trans=folder.scratch(outcome.trans), breakups=folder.scratch(outcome.breakups))
        run.remove()
        after = rc.committed(ledger, written, c.as_of, 7)
        parents = left.scratch(after.open.select("tran_gid", F.col("excp_value").alias("parent_value")))
        breakups = left.scratch(after.breakup.select("tran_gid", "tranbrkp_gid", "excp_value"))
        folder.remove()
        rows = breakups.join(at_size(parents), "tran_gid", "left").select(
            F.lit(variant).alias("variant"),
            "tranbrkp_gid",
            "excp_value",
            F.coalesce("parent_value", F.lit(0)).cast(TOTAL).alias("parent_value"),
        )
        runs.append(result.scratch(rows))
        left.remove()
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query
def run_stats_both_modes(c: Case) -> DataFrame:
    """Statistics of a committing run and of a preview, breakups that change included, as they stand in the
    table of statistics."""
    ledger, folder = _owned(c, "ST"), f"{RunFolder(c.fx.spark).path}/statistics"
    for job, commit in ((7, True), (8, False)):
        stats = rc.run_recon(ledger, PERIOD, job, commit=commit, breakup_keys=["ref_no"]).stats
        rn.replace_run_stats(stats, folder, ledger, stats.select("recon_code").distinct(), "Y" if commit else "N")
    return c.fx.spark.read.parquet(folder)


@query
def run_stats_replaced(c: Case) -> DataFrame:
    """Statistics after a run, and after another one before which a dataset was retired: its old rows stay."""
    spark, ledger, folder = c.fx.spark, c.ledger, f"{RunFolder(c.fx.spark).path}/statistics"
    used = ledger.recon_dataset
    retired = used.withColumn("delete_flag", F.when((F.col("dataset_code") == "BNK") & (F.col("recon_code") < "RC2"), "Y").otherwise(F.col("delete_flag")))
    matched = c.matched()
    for job, datasets, feed in ((1, used, c.fx["fx_feed"]), (2, retired, matched)):
        stats = rn.run_stats(feed, matched).withColumn("job_gid", F.lit(job).cast("bigint"))
        rn.replace_run_stats(stats, folder, replace(ledger, recon_dataset=datasets), c.scope, "Y")
    return spark.read.parquet(folder).select("recon_code", "dataset_code", "job_gid", "before_count", "before_value", "after_count")


@query
def uncommitted_preview(c: Case) -> DataFrame:
    """What ``commit=False`` proposes, with a many-to-many rule on breakups and a one-to-one rule with partial
    values on trans, as read back from the CSV files."""
    ledger = _owned(c, "P")
    outcome = mt.match(ledger, PERIOD, commit=False, breakup_keys=["ref_no"])
    lines = mt.all_lines(outcome.trans, outcome.breakups)
    preview = rn.match_preview(lines, p.live(ledger.rule), job_gid=9)
    path = rn.write_preview(preview, RunFolder(c.fx.spark).path, 9)
    return c.fx.spark.read.schema(preview.schema).option("header", True).csv(path).drop("ko_gid")


@query
def committed_delta(c: Case) -> DataFrame:
    """The tables after a run whose changes were added to a log beside the tables they started from."""
    before = _before_run(c)
    report = rc.run_recon(before, PERIOD, job_gid=7)
    log = DeltaLog(before, f"{RunFolder(c.fx.spark).path}/log")
    log.append(report.outcome.trans, report.outcome.breakups, report.ledger.breakup, PERIOD.as_of_col, 7)
    after = log.ledger()
    still = after.open.select("recon_code", "tran_gid", "excp_value", "theme_code", F.lit("open").alias("place"))
    gone = after.matched.select("recon_code", "tran_gid", "excp_value", "theme_code", F.lit("matched").alias("place"))
    kos = after.ko_line.groupBy("tran_gid").agg(F.sum("ko_value").cast(TOTAL).alias("ko_value"))
    return still.unionByName(gone).join(kos, "tran_gid", "left")


@query
def theme_reset_breakups(c: Case) -> DataFrame:
    recons = sc.eligible_recons(c.ledger, c.as_of)
    return mt.theme_reset(c.ledger.breakup, recons, PERIOD).select("recon_code", "tranbrkp_gid", "theme_code")
