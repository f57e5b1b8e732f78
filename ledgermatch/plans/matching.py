"""Matching runs: rules in order, breakup rules, preview and the repeat-until-stable loop.

Rules are configuration and are read to the driver; trans never are. All recons run at once: a
step takes the rules that stand at the same place in their recon and have the same shape.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from itertools import count, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermatch.functions.money import MONEY
from ledgermatch.functions.predicates import in_period, live, net_open
from ledgermatch.operators.groups import HOT_ROWS, WindowGroups, split_by_size
from ledgermatch.operators.passes import one_to_one, partial, whole_group
from ledgermatch.operators.scope import active_rules, eligible_recons
from ledgermatch.operators.state import apply_hits, ko_lines, still_open, with_state, without_proposals, working_value
from ledgermatch.params import Period
from ledgermatch.sources.ledger import Ledger
from ledgermatch.sources.local import local_table
from ledgermatch.sources.rounds import LedgerFolder, RunFolder, at_size

RULE_TABLE = (
    StructType()
    .add("recon_code", "string")
    .add("dataset_code", "string")
    .add("rule_code", "string")
    .add("tolerance", MONEY)
    .add("side", "string")
)
#: Number of the class of recons (see :func:`key_classes`) that a row is matched with.
CLASS = "_class"
CLASS_TABLE = StructType().add("recon_code", "string").add(CLASS, "integer")
FEED_TABLE = StructType().add("recon_code", "string").add("dataset_code", "string").add("_feed", "boolean")


@dataclass(frozen=True)
class Rule:
    """One matching rule. ``keys`` are the columns that must agree besides the recon."""

    rule_code: str
    recon_code: str
    order: Decimal = Decimal(1)
    apply_on: str = "T"
    group_flag: str = "OTO"
    commit: bool = True
    probable: bool = False
    partial: bool = False
    tolerance: Decimal = Decimal("0.00")
    source: str = ""
    comparison: str = ""
    keys: tuple[str, ...] = ("ref_no",)

    def passes(self) -> list[str]:
        """Kinds of pass the rule runs, in order. A partial pass follows each full one; a many-to-many
        rule then tries one-to-many; a rule without a group flag matches partial values only."""
        full = [self.group_flag] if self.group_flag else []
        rest = ["PARTIAL"] if self.partial else []
        return [*full, *rest, *(["OTM", *rest] if self.group_flag == "MTM" else [])]


@dataclass(frozen=True)
class Step:
    """One pass over all recons whose rules have it at this place."""

    kind: str
    apply_on: str
    keys: tuple[str, ...]
    commit: bool
    probable: bool
    rules: tuple[Rule, ...]

    @property
    def tolerance(self) -> bool:
        return any(r.tolerance > 0 for r in self.rules)


def load_rules(ledger: Ledger, as_of: Column, recons: DataFrame | None = None) -> list[Rule]:
    """Active rules of the recons, in order. Reads the rule master, which is configuration."""
    rules = active_rules(ledger, as_of)
    if recons is not None:
        rules = rules.join(recons.select("recon_code"), "recon_code", "left_semi")
    on_trans = F.when(F.col("rule_apply_on") == "T", F.lit("Y")).otherwise(F.lit("N"))
    defaults = {"tolerance": F.lit(0).cast(MONEY), "partial_flag": on_trans, "match_keys": F.lit("ref_no")}
    rules = rules.withColumns({c: v for c, v in defaults.items() if c not in rules.columns})
    rows = rules.orderBy("recon_code", "rule_order", "rule_code").collect()
    return [
        Rule(
            rule_code=r.rule_code,
            recon_code=r.recon_code,
            order=r.rule_order,
            apply_on=r.rule_apply_on,
            group_flag=r.group_flag,
            commit=r.system_match_flag == "Y" and r.probable_match_flag != "Y",
            probable=r.probable_match_flag == "Y",
            partial=r.partial_flag == "Y",
            tolerance=r.tolerance or Decimal("0.00"),
            source=r.source_dataset_code,
            comparison=r.comparison_dataset_code,
            keys=tuple(k.strip() for k in r.match_keys.split(",")),
        )
        for r in rows
    ]


def key_classes(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Rules by recons that go through the same sequence of match keys. Recons do not depend on each
    other, so each class runs on its own rows and changes keys only where its own rules do."""
    ordered = sorted(rules, key=lambda r: (r.recon_code, r.order, r.rule_code))
    classes: dict[tuple, list[Rule]] = {}
    for _, own in groupby(ordered, key=lambda r: r.recon_code):
        members = list(own)
        sequence = tuple(k for k, _ in groupby((r.apply_on, r.keys) for r in members))
        classes.setdefault(sequence, []).extend(members)
    return [classes[k] for k in sorted(classes)]


def plan_steps(rules: Sequence[Rule]) -> list[Step]:
    """Rules in order as steps. Recons do not depend on each other, so rules of several recons
    share a step if they stand at the same place and agree in everything but their parameters."""
    placed: dict[tuple, list[Rule]] = {}
    ordered = sorted(rules, key=lambda r: (r.recon_code, r.order, r.rule_code))
    for _, own in groupby(ordered, key=lambda r: r.recon_code):
        place = 0
        for rule in own:
            for kind in rule.passes():
                shape = (place, rule.apply_on, rule.keys, kind, rule.commit, rule.probable)
                placed.setdefault(shape, []).append(rule)
                place += 1
    return [
        Step(kind, apply_on, keys, commit, probable, tuple(members))
        for (_, apply_on, keys, kind, commit, probable), members in sorted(placed.items(), key=lambda e: e[0])
    ]


def _rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rule parameters of a step, one row per (recon, dataset); as small as the rule master."""
    rows = []
    for r in rules:
        tolerance = r.tolerance.quantize(Decimal("0.01"))
        if r.source == r.comparison:
            rows.append((r.recon_code, r.source, r.rule_code, tolerance, None))
        else:
            rows.append((r.recon_code, r.source, r.rule_code, tolerance, "S"))
            rows.append((r.recon_code, r.comparison, r.rule_code, tolerance, "T"))
    return local_table(spark, rows, RULE_TABLE)


def _with_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the row's rule and its side in it. A rule that compares a dataset with itself sets debits against credits."""
    by_mode = F.when(F.col("tran_acc_mode") == "D", F.lit("S")).when(F.col("tran_acc_mode") == "C", F.lit("T"))
    df = df.join(_rule_table(df.sparkSession, rules), ["recon_code", "dataset_code"], "left")
    return df.withColumn("side", F.when(F.col("rule_code").isNotNull(), F.coalesce("side", by_mode)))


def _with_open_value(df: DataFrame, step: Step) -> DataFrame:
    """Add the value that the row may still match in the step."""
    value = working_value() * F.col("_sign")
    usable = (value > 0) & F.col("rule_code").isNotNull()
    if "in_period" in df.columns and not step.probable:
        usable = usable & F.col("in_period")
    return df.withColumn("open_value", F.when(usable, value).cast(MONEY))


def _run_step(df: DataFrame, step: Step, groups, round_no: int, number: int, job_gid: int, chains: bool) -> DataFrame:
    df = _with_open_value(df, step)
    if step.kind == "OTO":
        df = one_to_one(df, groups, step.tolerance, chains)
    elif step.kind == "PARTIAL":
        df = partial(df, groups)
    elif step.kind in ("OTM", "MTM"):
        df = whole_group(df, groups, step.kind)
    else:
        raise ValueError(f"unknown group flag {step.kind!r}")
    return apply_hits(df, groups.keys, round_no, number, step.commit, job_gid).drop("open_value")


def _run_steps(
    state: DataFrame,
    steps: Sequence[tuple[int, Step]],
    round_no: int,
    hot_rows: int,
    folder: RunFolder,
    job_gid: int,
    chains: bool,
) -> DataFrame:
    """Steps with the same keys. Rows that cannot take part stay out of the shuffle. Rows match only
    rows whose open value has the same sign, which is a key like the others."""
    spark = state.sparkSession
    columns = state.columns
    keys = ["recon_code", *steps[0][1].keys]
    feeds = {(r.recon_code, d) for _, s in steps for r in s.rules for d in (r.source, r.comparison)}
    table = local_table(spark, sorted((*feed, True) for feed in feeds), FEED_TABLE)
    takes_part = still_open() & F.col("_feed").isNotNull()
    for key in keys:
        takes_part = takes_part & F.col(key).isNotNull()
    if "in_period" in columns and not any(s.probable for _, s in steps):
        takes_part = takes_part & F.col("in_period")
    takes_part = F.coalesce(takes_part, F.lit(False))
    marked = state.join(table, ["recon_code", "dataset_code"], "left")
    players = marked.filter(takes_part).select(*columns, F.signum(net_open()).cast("int").alias("_sign"))
    others = marked.filter(~takes_part).select(*columns)

    result = others
    for groups, part in split_by_size(players, [*keys, "_sign"], folder, hot_rows):
        part = groups.prepare(part)
        # Passes of the same rules share the rows' sides, and so the order that partial passes need.
        for rules, passes in groupby(steps, key=lambda s: s[1].rules):
            passes = list(passes)
            part = _with_rules(part, rules)
            if any(s.kind == "PARTIAL" for _, s in passes) and all(s.kind != "OTO" for _, s in passes):
                part = groups.in_order(part, "side")
            for number, step in passes:
                part = _run_step(part, step, groups, round_no, number, job_gid, chains)
            part = part.drop("rule_code", "tolerance", "side")
        result = result.unionByName(part.select(*columns))
    return result


def short_parents(breakups: DataFrame, trans: DataFrame) -> DataFrame:
    """Parents with less open value than their breakups want, and what they have (``_room``); parents that left
    the state have nothing."""
    zero = F.lit(0).cast(MONEY)
    room = trans.select(F.col("tran_gid").alias("parent_gid"), F.abs(net_open()).alias("_room"))
    wanted = breakups.groupBy("parent_gid").agg(F.sum(F.abs(net_open())).alias("_wanted"))
    return (
        wanted.join(at_size(room), "parent_gid", "left")
        .select("parent_gid", "_wanted", F.coalesce("_room", zero).cast(MONEY).alias("_room"))
        .filter("_wanted > _room")
        .drop("_wanted")
    )


def within_parents(
    breakups: DataFrame, trans: DataFrame, hot_rows: int, folder: RunFolder, short: DataFrame | None = None
) -> DataFrame:
    """Breakups with no more open value than their parent has. What tran rules took off a parent its
    breakups have lost, the latest first; parents that left the state are closed.

    Only breakups of parents that are short of value (``short``, if known) and have some left are put in order:
    a closed parent leaves its breakups nothing in any order.
    """
    columns, zero = breakups.columns, F.lit(0).cast(MONEY)
    short = short_parents(breakups, trans) if short is None else short
    marked = folder.scratch(breakups.join(at_size(short), "parent_gid", "left"))
    amount = F.abs(net_open())

    def cut(kept: Column) -> Column:
        return (F.signum(net_open()) * kept + F.col("roundoff_value") * F.col("tran_mult")).cast(MONEY)

    value = F.when(F.col("_room").isNull(), F.col("excp_value")).otherwise(cut(zero))
    result = marked.filter("_room is null or _room = 0").withColumn("excp_value", value).select(*columns)
    for groups, part in split_by_size(marked.filter("_room > 0"), ["parent_gid"], folder, hot_rows):
        if isinstance(groups, WindowGroups) and not groups.rows:
            continue
        part = groups.running(groups.prepare(part), ["parent_gid"], amount, "_before")
        kept = F.greatest(F.least(amount, F.col("_room") - F.col("_before")), zero)
        result = result.unionByName(part.withColumn("excp_value", cut(kept)).select(*columns))
    return result


def settled(breakups: DataFrame, trans: DataFrame, hot_rows: int, folder: RunFolder) -> DataFrame:
    """:func:`within_parents`, which moves all breakups, only if some parent is short of value."""
    short = folder.scratch(short_parents(breakups, trans))
    return breakups if short.isEmpty() else within_parents(breakups, trans, hot_rows, folder, short)


def _roll_up(trans: DataFrame, breakups: DataFrame, round_no: int, numbers: Sequence[int]) -> DataFrame:
    """Take what breakup rules matched off the trans that own the breakups."""
    line = F.col("a")
    sums = (
        breakups.select("parent_gid", F.explode_outer("allocs").alias("a"))
        .filter((line.getField("round") == round_no) & line.getField("step").isin(*numbers))
        .groupBy(F.col("parent_gid").alias("tran_gid"))
        .agg(
            F.sum(line.getField("ko_value")).cast(MONEY).alias("_taken"),
            F.sum(line.getField("roundoff_value")).cast(MONEY).alias("_roundoff"),
        )
    )
    zero = F.lit(0).cast(MONEY)
    return (
        trans.join(at_size(sums), "tran_gid", "left")
        .withColumns(
            {
                "excp_value": (F.col("excp_value") - F.coalesce("_taken", zero)).cast(MONEY),
                "roundoff_value": (F.col("roundoff_value") + F.coalesce("_roundoff", zero)).cast(MONEY),
            }
        )
        .select(*trans.columns)
    )


def by_class(df: DataFrame, classes: Sequence[Sequence[Rule]], folder: RunFolder) -> DataFrame:
    """``df`` with its rows' class, written in a folder for each class. A plan that asks for one class then lists
    and reads that class's files only, and the recons of a class need not be named in it."""
    numbers = sorted((r, n) for n, own in enumerate(classes, start=1) for r in {rule.recon_code for rule in own})
    placed = df.join(local_table(df.sparkSession, numbers, CLASS_TABLE), "recon_code", "left")
    return folder.scratch(placed.select(*df.columns, F.coalesce(CLASS, F.lit(0)).alias(CLASS)), by=CLASS)


def run_rules(
    trans: DataFrame,
    rules: Sequence[Rule],
    breakups: DataFrame | None = None,
    round_no: int = 1,
    hot_rows: int = HOT_ROWS,
    folder: RunFolder | None = None,
    job_gid: int = 0,
    settle: bool = True,
    chains: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Apply the rules once, in order; return the new state of trans and breakups.

    A tran used up by one rule is out of reach for the next, and so are its breakups. Steps on the same keys share one
    shuffle. Between stretches on different keys the state is written to the run's folder. With ``settle``
    breakups end with what their parents have left; without, the caller does that once after its last round.
    """
    state = with_state(trans)
    sub = with_state(breakups) if breakups is not None else None
    folder = folder or LedgerFolder(state.sparkSession)
    classes = key_classes(rules)
    if len(classes) < 2:
        return _run_class(state, sub, rules, round_no, hot_rows, folder, job_gid, settle, chains)
    # Each class reads files of its own; recons without rules are in the files of class 0.
    state = by_class(state, classes, folder)
    sub = by_class(sub, classes, folder) if sub is not None else None

    def own_rows(df: DataFrame | None, number: int) -> DataFrame | None:
        return df.filter(F.col(CLASS) == number).drop(CLASS) if df is not None else None

    trans_parts = [own_rows(state, 0)]
    sub_parts = [own_rows(sub, 0)] if sub is not None else []
    for number, own in enumerate(classes, start=1):
        mine, below = own_rows(state, number), own_rows(sub, number)
        part, below = _run_class(mine, below, own, round_no, hot_rows, folder, job_gid, settle, chains)
        trans_parts.append(part)
        sub_parts += [below] if below is not None else []
    together = reduce(DataFrame.unionByName, trans_parts)
    return together, reduce(DataFrame.unionByName, sub_parts) if sub_parts else None


def _run_class(
    state: DataFrame,
    sub: DataFrame | None,
    rules: Sequence[Rule],
    round_no: int,
    hot_rows: int,
    folder: RunFolder,
    job_gid: int,
    settle: bool,
    chains: bool,
) -> tuple[DataFrame, DataFrame | None]:
    """The rules of recons with the same sequence of keys, stretch by stretch. Once trans or breakups are written again, the
    tables that they came from go; those that the caller gave stay."""
    state_from: list[RunFolder] = []
    sub_from: list[RunFolder] = []

    def written(df: DataFrame, before: list[RunFolder]) -> DataFrame:
        at = folder.below()
        table = at.scratch(df)
        for place in before:
            place.remove()
        before[:] = [at]
        return table

    steps = list(enumerate(plan_steps(rules), start=1))
    stretches = [(k, list(g)) for k, g in groupby(steps, key=lambda s: (s[1].apply_on, s[1].keys))]
    for place, ((apply_on, _), stretch) in enumerate(stretches):
        work = folder.below()
        if apply_on == "T":
            state_from.append(work)
            state = _run_steps(state, stretch, round_no, hot_rows, work, job_gid, chains)
        elif apply_on == "S" and sub is not None:
            sub_from.append(work)
            sub = settled(sub, state, hot_rows, work)
            sub = _run_steps(sub, stretch, round_no, hot_rows, work, job_gid, chains)
            sub = written(sub, sub_from)
            state = _roll_up(state, sub, round_no, [n for n, _ in stretch])
        if place + 1 < len(stretches):
            state = written(state, state_from)
    if settle and sub is not None and stretches and stretches[-1][0][0] == "T":
        state = written(state, state_from)
        sub = settled(sub, state, hot_rows, folder)
    return state, sub


RECON_ROUNDS = StructType().add("recon_code", "string").add("rounds", "integer").add("converged", "boolean")


@dataclass(frozen=True)
class Stable:
    """Outcome of a run; ``converged`` if its last round matched nothing. ``recons`` has, for each recon
    with rules, the rounds it took part in and whether the last of them matched nothing."""

    trans: DataFrame
    breakups: DataFrame | None
    rounds: int
    converged: bool
    refused: DataFrame | None = None
    recons: DataFrame | None = None


def frontier(state: DataFrame, changed: DataFrame, rules: Sequence[Rule], folder: RunFolder) -> tuple[DataFrame, DataFrame]:
    """Rows of ``state`` whose match group under some rule has a row in ``changed``, and the others. What
    a rule finds in a group it has seen before depends on the group's rows only, so the others need no
    further round until a row of theirs changes."""
    own, others = None, state
    for keys in sorted({r.keys for r in rules}):
        group = ["recon_code", *keys]
        touched = folder.scratch(changed.select(*group).dropna().distinct()).withColumn("_touched", F.lit(True))
        # Written, as the next round reads its rows several times and the outcome the others.
        marked = folder.scratch(others.join(at_size(touched), group, "left").select(*state.columns, "_touched"))
        part = marked.filter("_touched is not null").drop("_touched")
        others = marked.filter("_touched is null").drop("_touched")
        own = part if own is None else own.unionByName(part)
    return own, others


def _recons(*parts: DataFrame | None) -> set[str]:
    """Recon codes of some rows: as many as there are recons, which are configuration."""
    return {r[0] for df in parts if df is not None for r in df.select("recon_code").distinct().collect()}


def match_until_stable(
    trans: DataFrame,
    rules: Sequence[Rule],
    breakups: DataFrame | None = None,
    max_rounds: int | None = None,
    hot_rows: int = HOT_ROWS,
    job_gid: int = 0,
    chains: bool = False,
) -> Stable:
    """Repeat :func:`run_rules` until a round matches nothing, that is, until count and value of
    the open trans no longer change. Each round but the last matches something, so it comes to an end
    by itself; ``max_rounds`` may end it sooner. With ``chains`` a round pairs whole chains of amounts
    within tolerance instead of their first pair.

    Each round is written to the shared folder. A round takes up only what may match now: closed rows stay
    out, recons leave once a round has matched nothing of theirs, and after the first round only match
    groups in which something changed go on (all open rows of a recon if rules apply to breakups, whose
    values depend on their parents'). Proposals are those of the last round that a row took part in.
    """
    folder = LedgerFolder(trans.sparkSession)
    state = trans
    sub = breakups if breakups is not None and any(r.apply_on == "S" for r in rules) else None
    running, done = sorted({r.recon_code for r in rules}), []
    parts: list[DataFrame] = []
    sub_parts: list[DataFrame] = []
    resting: DataFrame | None = None
    for round_no in count(1):
        now = [r for r in rules if r.recon_code in running]
        state, sub = run_rules(state, now, sub, round_no, hot_rows, folder, job_gid, settle=False, chains=chains)
        state = folder.table(state, f"round={round_no}/trans")
        sub = folder.table(sub, f"round={round_no}/breakups") if sub is not None else None
        new = F.exists("allocs", lambda a: a.getField("round") == round_no)
        changed = state.filter(new)
        still = _recons(changed, sub.filter(new) if sub is not None else None)
        done += [(r, round_no, True) for r in running if r not in still]
        running = sorted(still)
        if not running or round_no == max_rounds:
            break
        on = F.coalesce(F.col("recon_code").isin(running), F.lit(False))
        parts.append(state.filter(~on))
        parts.append(without_proposals(state.filter(on & ~still_open())))
        state = state.filter(on & still_open())
        if sub is not None:
            sub_parts.append(sub.filter(~on))
            sub_parts.append(without_proposals(sub.filter(on & ~still_open())))
            sub, state = without_proposals(sub.filter(on & still_open())), without_proposals(state)
            continue
        now = [r for r in now if r.recon_code in still]
        pool = state if resting is None else state.unionByName(resting)
        state, resting = frontier(pool, changed, now, folder)
        state = without_proposals(state)
        if len({r.keys for r in now}) == 1:
            # Groups do not overlap, so those without a change never get one.
            parts.append(resting)
            resting = None
        else:
            resting = folder.table(resting, f"round={round_no}/resting")
    done += [(r, round_no, False) for r in running]
    for part in [*parts, *([] if resting is None else [resting])]:
        state = state.unionByName(part)
    for part in sub_parts:
        sub = sub.unionByName(part)
    if breakups is not None:
        sub = settled(with_state(breakups) if sub is None else sub, state, hot_rows, folder)
    recons = local_table(trans.sparkSession, sorted(done), RECON_ROUNDS)
    return Stable(state, sub, round_no, not running, recons=recons)


def configured_date_filter(trans: DataFrame, recons: DataFrame, period: Period, fields: Sequence[str]) -> DataFrame:
    """Trans with ``in_period``: the period applied to the date column each recon names, or true
    where the recon does not limit by date. ``fields`` are the names in use; a name that is not a
    column of the trans is refused."""
    config = recons.select("recon_code", "recon_date_field", "recon_date_flag")
    return (
        trans.join(config, "recon_code")
        .withColumn("in_period", _configured(trans, period, fields))
        .drop("recon_date_field", "recon_date_flag")
    )


def _configured(trans: DataFrame, period: Period, fields: Sequence[str]) -> Column:
    unknown = sorted(set(fields) - set(trans.columns))
    if unknown:
        raise ValueError(f"not columns of the trans: {unknown}")
    limit = F.lit(False)
    for field in fields:
        limit = F.when(F.col("recon_date_field") == field, in_period(period, field)).otherwise(limit)
    return F.when(F.col("recon_date_flag") == "Y", limit).otherwise(F.lit(True))


def dated(recons: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Recons that can run, and those limited by a date column that is not one of ``columns``."""
    known = F.coalesce(F.col("recon_date_field").isin(*columns), F.lit(False))
    good = known | ~F.col("recon_date_flag").eqNullSafe("Y")
    return recons.filter(good), recons.filter(~good).select("recon_code", F.lit("date column").alias("reason"))


def date_fields(recons: DataFrame) -> list[str]:
    """Date columns the recons name (configuration)."""
    rows = recons.filter("recon_date_flag = 'Y'").select("recon_date_field").distinct().collect()
    return sorted(r[0] for r in rows)


def preview_state(ledger: Ledger, recons: DataFrame, period: Period) -> DataFrame:
    """Open trans a preview works on: those of the period, or all where a recon has no limit."""
    marked = configured_date_filter(live(ledger.open), recons, period, date_fields(recons))
    return marked.filter("in_period").drop("in_period")


def probable_state(ledger: Ledger, recons: DataFrame) -> DataFrame:
    """Open trans a probable-match rule works on: all of them, whatever their date."""
    return live(ledger.open).join(recons.select("recon_code"), "recon_code", "left_semi")


def theme_reset(trans: DataFrame, recons: DataFrame, period: Period) -> DataFrame:
    """Clear the theme of the rows a run will look at."""
    config = recons.select("recon_code", "recon_date_field", "recon_date_flag")
    touched = (
        F.col("recon_date_flag").isNotNull()
        & (F.col("delete_flag") == "N")
        & _configured(trans, period, date_fields(recons))
    )
    return (
        trans.join(config, "recon_code", "left")
        .withColumn("theme_code", F.when(touched, F.lit("")).otherwise(F.col("theme_code")))
        .select(*trans.columns)
    )


def as_breakups(
    breakups: DataFrame, key_columns: Sequence[str] = (), trans: DataFrame | None = None
) -> DataFrame:
    """Breakup table as matching state: the breakup is the row, its tran the parent. With ``trans``
    only their breakups, which are of the period (``in_period``) if their parent is."""
    extra = [c for c in key_columns if c in breakups.columns]
    rows = live(breakups)
    if trans is not None:
        flag = F.col("in_period") if "in_period" in trans.columns else F.lit(True)
        rows = rows.drop("in_period").join(at_size(trans.select("tran_gid", flag.alias("in_period"))), "tran_gid")
        extra.append("in_period")
    return rows.select(
        F.col("tranbrkp_gid").alias("tran_gid"),
        F.col("tran_gid").alias("parent_gid"),
        "recon_code",
        F.col("tranbrkp_dataset_code").alias("dataset_code"),
        "tran_date",
        "tran_acc_mode",
        F.when(F.col("tran_acc_mode") == "D", F.lit(-1)).otherwise(F.lit(1)).alias("tran_mult"),
        "excp_value",
        F.lit(0).cast(MONEY).alias("roundoff_value"),
        *extra,
    )


def match(
    ledger: Ledger,
    period: Period,
    codes: Sequence[str] | None = None,
    commit: bool = True,
    until_stable: bool = False,
    breakup_keys: Sequence[str] = (),
    job_gid: int = 0,
    chains: bool = True,
    folder: RunFolder | None = None,
) -> Stable:
    """One run over the eligible recons, or, with ``until_stable``, rounds of it; these pair whole chains
    of amounts within tolerance unless ``chains`` is off. ``commit=False`` previews: every rule only proposes, on a
    working copy that the next rule finds changed; read the proposals with ``ko_lines``. A recon whose
    date column does not exist is refused, the others run. Breakups are in the outcome whether or not a rule
    applies to them, with no more value than their parents have left. One run's tables are in ``folder``, if given: remove it
    once the outcome is written elsewhere."""
    recons, refused = dated(eligible_recons(ledger, period.as_of_col, codes), ledger.open.columns)
    rules = load_rules(ledger, period.as_of_col, recons)
    if commit:
        trans = configured_date_filter(live(ledger.open), recons, period, date_fields(recons))
    else:
        trans = preview_state(ledger, recons, period)
        rules = [replace(r, commit=True, probable=False) for r in rules]
    # A table, as rounds read it several times: else each would join the breakups with their parents again.
    folder = folder or LedgerFolder(trans.sparkSession)
    breakups = folder.scratch(as_breakups(ledger.breakup, breakup_keys, trans))
    if until_stable:
        stable = match_until_stable(trans, rules, breakups, job_gid=job_gid, chains=chains)
        return replace(stable, refused=refused)
    state, sub = run_rules(trans, rules, breakups, folder=folder, job_gid=job_gid)
    return Stable(state, sub, 1, False, refused)


def all_lines(trans: DataFrame, breakups: DataFrame | None, source: str = "allocs") -> DataFrame:
    """KO lines of trans, and those of breakups under the trans that own them."""
    lines = ko_lines(trans, source)
    if breakups is None:
        return lines
    below = ko_lines(breakups, source).withColumn("tran_gid", F.col("parent_gid"))
    return lines.unionByName(below.select(*lines.columns))


def probable_preview(
    ledger: Ledger,
    period: Period,
    codes: Sequence[str] | None = None,
    job_gid: int = 0,
    breakup_keys: Sequence[str] = (),
) -> DataFrame:
    """KO lines that probable-match rules propose on the open trans and breakups as they are now, of any
    date; lines of breakups under the trans that own them. Each rule works on its own copy of the open
    values, which its later passes find changed."""
    recons = eligible_recons(ledger, period.as_of_col, codes)
    rules = [r for r in load_rules(ledger, period.as_of_col, recons) if r.probable]
    trans = probable_state(ledger, recons)
    needed = any(r.apply_on == "S" for r in rules)
    folder = LedgerFolder(trans.sparkSession)
    # A table, as steps read it several times: else each would join the breakups with their parents again.
    breakups = folder.scratch(as_breakups(ledger.breakup, breakup_keys, trans)) if needed else None
    return all_lines(*run_rules(trans, rules, breakups, folder=folder, job_gid=job_gid), "proposals")
