"""KO summaries: one long table of sections, shown in five layouts.

The KO lines are brought down to one row per (recon, dataset, kind, rule order) first. Every row
of a report is then a fold of that small table, so a report reads the lines once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.functions.money import TOTAL, formatted, total
from ledgermatch.operators.scope import scope_by_code
from ledgermatch.operators.universe import ko_line_fact
from ledgermatch.params import Period
from ledgermatch.sources.ledger import Ledger
from ledgermatch.sources.rounds import RunFolder

# Section numbers give the row order within a recon (and dataset).
HEADER, DATASET, RULE, MANUAL, SUBTOTAL, BLANK, GRAND = 1, 2, 3, 4, 5, 6, 7

# Dataset code of the blank row, recon code of the grand total, labels.
BLANK_DATASET = "XXX9999999999999999"
GRAND_RECON = "ZZZ9999999"
MANUAL_LABEL = "  Manual KO"
SUBTOTAL_LABEL = "Sub Total"
GRAND_LABEL = "Grant Total"

# Fore and back colour of a section where they differ from black on white.
COLOURS = {
    HEADER: ("Red", "Yellow"),
    DATASET: ("Blue", "White"),
    SUBTOTAL: ("Red", "Yellow"),
    BLANK: ("White", "White"),
    GRAND: ("White", "Black"),
}
PLAIN_HEADER = ("Blue", "White")

LAYOUT_OF_TYPE = {"W": "proof", "N": "non_value", "V": "value"}
FIXED_HEADER = {"value": "Value Based", "non_value": "Non Value Based"}

FIGURES = ("dr_count", "dr_value", "cr_count", "cr_value", "tot_count", "tot_value")


def rule_figures(fact: DataFrame, sides: bool = False) -> DataFrame:
    """Figures per (recon, dataset, kind, rule order); ``tot_signed`` keeps the sign.

    ``sides`` also separates by the rule's source and comparison dataset (pivot layout).
    Trans are made distinct by grouping on them first: that spreads a big rule over all tasks and
    leaves plain sums for the second step.
    """
    kind = (
        F.when(F.col("manual_matchoff") == "N", F.lit(RULE))
        .when(F.col("manual_matchoff") == "Y", F.lit(MANUAL))
        .otherwise(F.lit(HEADER))
    )
    debit, value = F.col("tran_acc_mode") == "D", F.col("ko_value")
    manual = kind == MANUAL
    side_columns = ("source_dataset_code", "comparison_dataset_code") if sides else ()
    lines = fact.select(
        "recon_code",
        "recon_name",
        "recontype_code",
        "dataset_code",
        kind.alias("kind"),
        *[F.when(~manual, F.col(c)).alias(c) for c in ("rule_order", "rule_name", *side_columns)],
        "tran_gid",
        debit.alias("debit"),
        value.alias("value"),
        (value * F.col("tran_mult")).alias("signed"),
    )
    keys = ["recon_code", "recon_name", "recontype_code", "dataset_code", "kind", "rule_order", *side_columns]
    per_tran = lines.groupBy(*keys, "tran_gid").agg(
        F.min("rule_name").alias("rule_name"),
        F.max(F.col("debit").cast("int")).alias("d"),
        F.max((~F.col("debit")).cast("int")).alias("c"),
        F.sum(F.when(F.col("debit"), F.col("value")).otherwise(0)).alias("dr"),
        F.sum(F.when(~F.col("debit"), F.col("value")).otherwise(0)).alias("cr"),
        F.sum("signed").alias("signed"),
    )
    return per_tran.groupBy(*keys).agg(
        F.min("rule_name").alias("rule_name"),
        F.sum("d").alias("dr_count"),
        total(F.col("dr")).alias("dr_value"),
        F.sum("c").alias("cr_count"),
        total(F.col("cr")).alias("cr_value"),
        F.count(F.lit(1)).alias("tot_count"),
        total(F.col("signed")).alias("tot_signed"),
    )


def _label(kind: str = "kind") -> Column:
    rule = F.concat(F.lit("  "), F.col("rule_name"))
    return F.when(F.col(kind) == MANUAL, F.lit(MANUAL_LABEL)).otherwise(rule)


def _fold(figures: DataFrame, keys: list[str]) -> DataFrame:
    """Rule and manual rows for coarser keys; other attributes are the smallest of the group."""
    return figures.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in ("dataset_code", "rule_name") if c not in keys],
        *[F.sum(c).alias(c) for c in ("dr_count", "cr_count", "tot_count")],
        *[total(F.col(c)).alias(c) for c in ("dr_value", "cr_value", "tot_signed")],
    )


def line_rows(figures: DataFrame, kind: int, by_dataset: bool = True) -> DataFrame:
    """Rule rows or manual rows, per dataset or per recon."""
    keys = ["recon_code", *(["dataset_code"] if by_dataset else []), "rule_order", "kind"]
    return _fold(figures.filter(F.col("kind") == kind), keys).select(
        "recon_code",
        "dataset_code",
        "rule_order",
        _label().alias("row_label"),
        "dr_count",
        "dr_value",
        "cr_count",
        "cr_value",
        "tot_count",
        F.abs("tot_signed").alias("tot_value"),
    )


def total_rows(figures: DataFrame, by_dataset: bool) -> DataFrame:
    """Sub totals (per dataset) or totals per recon. Counts add up, they are not made distinct
    again: a tran matched by two rules counts twice."""
    keys = ["recon_code", *(["dataset_code"] if by_dataset else [])]
    return (
        figures.filter(F.col("kind").isin(RULE, MANUAL))
        .groupBy(*keys)
        .agg(
            *([] if by_dataset else [F.min("dataset_code").alias("dataset_code")]),
            F.sum("dr_count").alias("dr_count"),
            total(F.col("dr_value")).alias("dr_value"),
            F.sum("cr_count").alias("cr_count"),
            total(F.col("cr_value")).alias("cr_value"),
        )
        .select(
            "recon_code",
            "dataset_code",
            "dr_count",
            "dr_value",
            "cr_count",
            "cr_value",
            (F.col("dr_count") + F.col("cr_count")).alias("tot_count"),
            F.abs(F.col("dr_value") - F.col("cr_value")).cast(TOTAL).alias("tot_value"),
        )
    )


def header_rows(figures: DataFrame, ledger: Ledger) -> DataFrame:
    """Recon headers and dataset headers (default layout)."""
    sections = figures.select(
        "recon_code",
        "dataset_code",
        F.explode(
            F.array(
                F.struct(F.lit(HEADER).alias("section"), F.col("recon_name").alias("label")),
                F.struct(F.lit(DATASET).alias("section"), F.lit(None).cast("string").alias("label")),
            )
        ).alias("s"),
    ).select(
        "recon_code",
        F.when(F.col("s.section") == DATASET, F.col("dataset_code")).alias("dataset_code"),
        "s.section",
        "s.label",
    )
    named = _with_dataset_name(sections.distinct(), ledger, "dataset_code", "dataset_name")
    return named.select(
        "recon_code", "dataset_code", "section", F.coalesce("label", "dataset_name").alias("row_label")
    )


def _with_dataset_name(df: DataFrame, ledger: Ledger, code: str, name: str) -> DataFrame:
    names = ledger.dataset.select(F.col("dataset_code").alias(code), F.col("dataset_name").alias(name))
    return df.join(names, code, "left")


def _sections(figures: DataFrame, header_label: Column, by_dataset: bool) -> DataFrame:
    """Long table of all sections, from one pass over the figures.

    Each figure row feeds every section it belongs to; a second, small aggregation folds them.
    """
    is_line = F.col("kind").isin(RULE, MANUAL)
    dataset = F.col("dataset_code")
    nothing = F.lit(None)

    def section(number, dataset_code, label, rule_order=nothing, filled=True, when=F.lit(True)):
        row = F.struct(
            F.lit(number).cast("int").alias("section") if isinstance(number, int) else number.alias("section"),
            dataset_code.cast("string").alias("dataset_code"),
            label.cast("string").alias("row_label"),
            rule_order.cast("decimal(9,2)").alias("rule_order"),
            F.lit(filled).alias("filled"),
        )
        return F.when(when, row)

    rows = [
        section(HEADER, nothing, header_label, filled=False),
        section(
            F.col("kind").cast("int"),
            dataset if by_dataset else nothing,
            nothing,
            F.col("rule_order"),
            when=is_line,
        ),
        section(SUBTOTAL, dataset if by_dataset else nothing, F.lit(SUBTOTAL_LABEL), when=is_line),
        section(BLANK, F.lit(BLANK_DATASET), F.lit(""), filled=False, when=is_line),
    ]
    if by_dataset:
        rows.insert(1, section(DATASET, dataset, nothing, filled=False))
        rows.append(section(GRAND, nothing, F.lit(GRAND_LABEL), when=is_line))

    figure = {c: F.when(F.col("s.filled"), F.col(c)) for c in ("dr_count", "dr_value", "cr_count", "cr_value")}
    exploded = figures.withColumn("s", F.explode(F.array_compact(F.array(*rows))))
    keys = ["recon_code", "recontype_code", "section", "dataset_code", "rule_order"]
    folded = (
        exploded.select(
            "recon_code",
            "recontype_code",
            "s.section",
            F.col("dataset_code").alias("_dataset"),
            "s.dataset_code",
            "s.row_label",
            "s.rule_order",
            F.when(F.col("s.section").isin(RULE, MANUAL), _label()).alias("line_label"),
            *[v.alias(c) for c, v in figure.items()],
        )
        .groupBy(*keys)
        .agg(
            F.min(F.coalesce("row_label", "line_label")).alias("row_label"),
            F.min("_dataset").alias("_dataset"),
            F.sum("dr_count").alias("dr_count"),
            total(F.col("dr_value")).alias("dr_value"),
            F.sum("cr_count").alias("cr_count"),
            total(F.col("cr_value")).alias("cr_value"),
        )
    )
    if by_dataset:
        return folded.drop("_dataset")
    picked = F.when(F.col("section").isin(RULE, MANUAL, SUBTOTAL), F.col("_dataset"))
    return folded.withColumn("dataset_code", F.coalesce("dataset_code", picked)).drop("_dataset")


def _colour(index: int, overrides: dict[int, tuple[str, str]] | None = None) -> Column:
    plain = ("Black", "White")[index]
    expr = F.lit(plain)
    for number, pair in {**COLOURS, **(overrides or {})}.items():
        expr = F.when(F.col("section") == number, F.lit(pair[index])).otherwise(expr)
    return expr


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Running row number within a recon's report (a report has few rows)."""
    window = Window.partitionBy("recon_code").orderBy(*order)
    return rows.withColumn("rec_slno", F.row_number().over(window).cast("int"))


def summ_default(figures: DataFrame, ledger: Ledger, unit: str | None = None) -> DataFrame:
    """Header, then per dataset its header, rules, manual KOs and sub total; blank row; total."""
    rows = _sections(figures, F.col("recon_name"), by_dataset=True)
    rows = _with_dataset_name(rows, ledger, "dataset_code", "dataset_name")
    rows = rows.withColumn("row_label", F.coalesce("row_label", F.when(F.col("section") == DATASET, F.col("dataset_name"))))
    rows = _numbered(
        rows.withColumn("_last", (F.col("section") == GRAND).cast("int")),
        "_last", "dataset_code", "section", "rule_order",
    )
    dr, cr = F.col("dr_value"), F.col("cr_value")
    net = F.when(dr > cr, dr - cr).when(cr > dr, cr - dr).cast(TOTAL)
    zero = F.lit(0).cast(TOTAL)
    return rows.select(
        "recon_code",
        F.when(F.col("section") == GRAND, F.lit(GRAND_RECON)).otherwise(F.col("recon_code")).alias("sort_code"),
        "dataset_code",
        "section",
        "rec_slno",
        "row_label",
        "dr_count",
        F.coalesce(dr, zero).alias("dr_value"),
        formatted(F.coalesce(dr, zero), unit).alias("formal_dr_value"),
        "cr_count",
        F.coalesce(cr, zero).alias("cr_value"),
        formatted(F.coalesce(cr, zero), unit).alias("formal_cr_value"),
        net.alias("net_value"),
        formatted(net, unit).alias("formal_net_value"),
        _colour(1).alias("backcolor"),
        _colour(0).alias("forecolor"),
        F.col("recontype_code").alias("recontype"),
    )


def _by_recon(figures: DataFrame, header_label: Column) -> DataFrame:
    rows = _sections(figures, header_label, by_dataset=False)
    return rows.withColumns(
        {
            "backcolor": _colour(1, {HEADER: PLAIN_HEADER}),
            "forecolor": _colour(0, {HEADER: PLAIN_HEADER}),
        }
    )


def summ_proof(figures: DataFrame, unit: str | None = None) -> DataFrame:
    """Header, rules, manual KOs, sub total, blank row; no datasets and no grand total."""
    rows = _numbered(_by_recon(figures, F.col("recon_name")), "section", "rule_order")
    zero = F.lit(0)
    return rows.select(
        "recon_code",
        "dataset_code",
        "section",
        "rec_slno",
        "row_label",
        F.coalesce("dr_count", zero).alias("dr_count"),
        F.coalesce("dr_value", zero.cast(TOTAL)).alias("dr_value"),
        formatted(F.col("dr_value"), unit).alias("formal_dr_value"),
        F.coalesce("cr_count", zero).alias("cr_count"),
        F.coalesce("cr_value", zero.cast(TOTAL)).alias("cr_value"),
        formatted(F.col("cr_value"), unit).alias("formal_cr_value"),
        "backcolor",
        "forecolor",
        F.col("recontype_code").alias("recontype"),
    )


def _folded_by_label(figures: DataFrame, header: str) -> DataFrame:
    """Debit and credit added up, rows of one label made one; the first row gives the attributes."""
    rows = _by_recon(figures, F.lit(header))
    zero = F.lit(0)
    first = F.min(F.struct("section", "rule_order", "dataset_code", "backcolor", "forecolor"))
    folded = rows.groupBy("recon_code", "row_label").agg(
        F.sum(F.coalesce("dr_count", zero) + F.coalesce("cr_count", zero)).alias("line_count"),
        total(F.coalesce("dr_value", zero) + F.coalesce("cr_value", zero)).alias("line_value"),
        first.alias("first"),
    )
    folded = folded.select("recon_code", "row_label", "line_count", "line_value", "first.*")
    return _numbered(folded, "section", "rule_order", "row_label")


def summ_value_based(figures: DataFrame, unit: str | None = None) -> DataFrame:
    return _folded_by_label(figures, FIXED_HEADER["value"]).select(
        "recon_code",
        "dataset_code",
        "section",
        "rec_slno",
        "row_label",
        "line_count",
        "line_value",
        formatted(F.col("line_value"), unit).alias("formal_line_value"),
        "backcolor",
        "forecolor",
    )


def summ_non_value_based(figures: DataFrame) -> DataFrame:
    return _folded_by_label(figures, FIXED_HEADER["non_value"]).select(
        "recon_code", "dataset_code", "section", "rec_slno", "row_label", "line_count", "backcolor", "forecolor"
    )


def _pivot_rows(figures: DataFrame) -> DataFrame:
    """Rows of the pivot layout: figures of source sides left joined with those of target sides, and
    header, dataset and manual rows. The figures, as many rows as there are rules and datasets, are written
    once, as every section reads them."""
    values = ("dr_count", "dr_value", "cr_count", "cr_value")
    figures = RunFolder(figures.sparkSession).scratch(figures.withColumn("label", _label()))
    meta = ("recon_code", "recontype_code")
    columns = ("dataset_code", "rule_order", "comparison_dataset_code", *values)
    kinds = {c: figures.schema[c].dataType for c in columns}
    target = ("dataset_code", *values)

    def rows(df: DataFrame, section: int, label: Column, keep: Sequence[str] = (), joined: bool = False) -> DataFrame:
        none = {f"target_{c}": F.lit(None).cast(kinds[c]).alias(f"target_{c}") for c in target}
        return df.select(
            *meta,
            F.lit(section).alias("section"),
            label.cast("string").alias("row_label"),
            *[F.col(c) if c in keep else F.lit(None).cast(kinds[c]).alias(c) for c in columns],
            *[F.col(c) if joined else none[c] for c in none],
        )

    of_rules = figures.filter(F.col("kind") == RULE)
    sources = of_rules.filter(F.col("dataset_code") == F.col("source_dataset_code"))
    targets = of_rules.filter(F.col("dataset_code") != F.col("source_dataset_code")).select(
        "recon_code", "rule_order", "label", *[F.col(c).alias(f"target_{c}") for c in target]
    )
    headers = figures.select(*meta, "recon_name").distinct()
    datasets = figures.filter(F.col("dataset_code") != F.col("comparison_dataset_code")).select(*meta, "dataset_code").distinct()
    pairs = sources.join(targets, ["recon_code", "rule_order", "label"], "left")
    return (
        rows(headers, HEADER, F.col("recon_name"))
        .unionByName(rows(datasets, DATASET, F.lit(None), ("dataset_code",)))
        .unionByName(rows(pairs, RULE, F.col("label"), columns, joined=True))
        .unionByName(rows(figures.filter(F.col("kind") == MANUAL), MANUAL, F.lit(MANUAL_LABEL), ("dataset_code", *values)))
    )


def summ_pivot(figures: DataFrame, ledger: Ledger, unit: str | None = None) -> DataFrame:
    """Source figures of a rule beside its target figures; headers and manual rows around them.
    ``figures`` are those separated by sides.

    Sides meet on (recon, rule order, rule name); a rule with several target datasets has a row
    for each; a rule with target lines only does not appear.
    """
    rows = _pivot_rows(figures)
    names = ledger.dataset.select("dataset_code", "dataset_name")
    rows = rows.join(names, "dataset_code", "left").withColumn(
        "row_label", F.coalesce("row_label", F.when(F.col("section") == DATASET, F.col("dataset_name")))
    )
    rows = _with_dataset_name(rows, ledger, "comparison_dataset_code", "target_label")
    rows = _numbered(rows, "dataset_code", "section", "rule_order", "target_dataset_code")
    zero = F.lit(0).cast(TOTAL)

    def side(prefix: str) -> list[Column]:
        dr = F.coalesce(F.col(f"{prefix}dr_value"), zero)
        cr = F.coalesce(F.col(f"{prefix}cr_value"), zero)
        net = (dr - cr).cast(TOTAL)
        return [
            F.col(f"{prefix}dr_count"),
            dr.alias(f"{prefix}dr_value"),
            formatted(dr, unit).alias(f"{prefix}formal_dr_value"),
            F.col(f"{prefix}cr_count"),
            cr.alias(f"{prefix}cr_value"),
            formatted(cr, unit).alias(f"{prefix}formal_cr_value"),
            net.alias(f"{prefix}net_value"),
            formatted(net, unit).alias(f"{prefix}formal_net_value"),
        ]

    return rows.select(
        "recon_code",
        "dataset_code",
        "section",
        "rec_slno",
        "row_label",
        *side(""),
        "target_dataset_code",
        *side("target_"),
        _colour(1).alias("backcolor"),
        _colour(0).alias("forecolor"),
        "target_label",
        F.lit("Target").alias("group_target_row_label"),
        F.col("recontype_code").alias("recontype"),
    )


def layout_of(layout: str | None = None) -> Column:
    """Layout of a recon: proof, non-value and value by type, otherwise as asked for."""
    expr = F.lit("pivot" if layout == "format2" else "default")
    for code, name in LAYOUT_OF_TYPE.items():
        expr = F.when(F.col("recontype_code") == code, F.lit(name)).otherwise(expr)
    return expr


def summary(
    ledger: Ledger,
    scope: DataFrame,
    period: Period,
    unit: str | None = None,
    layout: str | None = None,
) -> dict[str, DataFrame]:
    """KO summaries of a scope, one DataFrame per layout.

    ``layout`` None or ``"format2"`` chooses by recon type; a layout name shows every recon in it.
    """
    fact = ko_line_fact(ledger, scope, period)
    makers = {
        "default": lambda f: summ_default(f, ledger, unit),
        "proof": lambda f: summ_proof(f, unit),
        "non_value": lambda f: summ_non_value_based(f),
        "value": lambda f: summ_value_based(f, unit),
        "pivot": lambda f: summ_pivot(f, ledger, unit),
    }

    def make(name: str, lines: DataFrame) -> DataFrame:
        return makers[name](rule_figures(lines, sides=name == "pivot"))

    if layout in makers:
        return {layout: make(layout, fact)}
    if layout not in (None, "format2"):
        raise ValueError(f"unknown layout {layout!r}")
    wanted = ["proof", "non_value", "value", "pivot" if layout == "format2" else "default"]
    return {n: make(n, fact.filter(layout_of(layout) == n)) for n in wanted}


def summ_dispatch(
    ledger: Ledger, scope: DataFrame, period: Period, unit: str | None = None, layout: str | None = None
) -> DataFrame:
    """The dispatched layouts below each other, with the columns a layout lacks left null."""
    parts = [
        df.withColumn("layout", F.lit(name))
        for name, df in summary(ledger, scope, period, unit, layout).items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def summary_by_code(
    ledger: Ledger, period: Period, codes: list[str] | None = None, unit: str | None = None, layout: str | None = None
) -> dict[str, DataFrame]:
    """As :func:`summary`, for recons given by code."""
    return summary(ledger, scope_by_code(ledger, period.as_of_col, codes), period, unit, layout)
