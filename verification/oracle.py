"""Plain-SQL answers for the registered queries, for DuckDB on the driver's tables.

Written apart from the DataFrame code; the two share the fixture views only.
"""

from __future__ import annotations

from ledgermatch.sources.fixtures import with_prefix

START, END, AS_OF = "date '1997-01-01'", "date '1997-12-31'", "date '1998-01-01'"
NET = "(t.excp_value <> 0 and t.excp_value - t.roundoff_value * t.tran_mult <> 0)"
COLS = "t.tran_gid, t.recon_code, t.tran_date, t.tran_mult, t.tran_value, t.excp_value, t.roundoff_value"


def money(expr: str) -> str:
    return f"cast({expr} as decimal(18,2))"


def sum_if(cond: str, value: str) -> str:
    return money(f"coalesce(sum(case when {cond} then {value} end), 0)")


def lakh(expr: str) -> str:
    return f"cast(cast({money(expr)} * 0.00001 as decimal(18,2)) as varchar)"


def crore(expr: str) -> str:
    return f"cast(cast({money(expr)} * 0.0000001 as decimal(18,3)) as varchar)"


def percent(part: str, whole: str) -> str:
    """Half-up percentage with two decimals, in whole numbers throughout."""
    a, b = f"cast(({part}) * 100 as hugeint)", f"cast(({whole}) * 100 as hugeint)"
    hundredths = f"((abs({a}) * 20000 + abs({b})) // (2 * abs({b})))"
    sign = f"(case when ({a} < 0) <> ({b} < 0) then -1 else 1 end)"
    exact = f"cast(cast({hundredths} * {sign} as decimal(18,0)) * 0.01 as decimal(18,2))"
    return f"(case when {b} = 0 then cast(0 as decimal(18,2)) else {exact} end)"


def share(part: str, whole: str, lead: str) -> str:
    return f"'{lead}' || cast({percent(part, whole)} as varchar) || ' %)'"


def unit_rows(tran_date: str, value: int, roundoff: str) -> str:
    one = f"cast({value} as decimal(15,2))"
    return f"t.tran_gid, t.recon_code, {tran_date}, 1, {one}, {one}, {roundoff}"


DR = "count(distinct case when tran_acc_mode = 'D' then tran_gid end)"
CR = "count(distinct case when tran_acc_mode = 'C' then tran_gid end)"
LINE = f"""{DR} as dr_count, {sum_if("tran_acc_mode = 'D'", "ko_value")} as dr_value,
  {CR} as cr_count, {sum_if("tran_acc_mode = 'C'", "ko_value")} as cr_value,
  count(distinct tran_gid) as tot_count, {money("abs(sum(ko_value * tran_mult))")} as tot_value"""
SUMS = f"""cast(sum(dr_count) as bigint) as dr_count, {money("sum(dr_value)")} as dr_value,
  cast(sum(cr_count) as bigint) as cr_count, {money("sum(cr_value)")} as cr_value"""
NO_SUMS = """cast(null as bigint) as dr_count, cast(null as decimal(18,2)) as dr_value,
  cast(null as bigint) as cr_count, cast(null as decimal(18,2)) as cr_value"""

VIEWS = {
    "scope": f"""
select recon_code, recon_name, recontype_code from {{recon_mst_trecon}}
where active_status = 'Y' and delete_flag = 'N' and period_from <= {AS_OF}
  and (period_to >= {AS_OF} or until_active_flag = 'Y')""",
    "totals": f"""
select recon_code, count(*) as tran_count, {money("sum(tran_value)")} as tran_value
from {{fx_tran}} where delete_flag = 'N' group by recon_code""",
    "loads": f"""
select scheduler_gid, cast(insert_date as date) as load_date from {{recon_trn_tscheduler}}
where insert_date >= {START} and insert_date < {END} + interval 1 day""",
    "s4": f"""
select {COLS} from {{recon_trn_ttran}} t join {{scope}} s on t.recon_code = s.recon_code
where s.recontype_code in ('W', 'B', 'I') and t.delete_flag = 'N' and t.tran_date between {START} and {END}""",
    "s5": f"""
select {COLS} from {{recon_trn_ttranko}} t join {{scope}} s on t.recon_code = s.recon_code
where s.recontype_code in ('W', 'B', 'I') and t.delete_flag = 'N' and t.tran_date between {START} and {END}""",
    "s6": f"""
select t.tran_gid, t.recon_code, l.load_date as tran_date, 1 as tran_mult, cast(1 as decimal(15,2)) as tran_value,
  cast(1 as decimal(15,2)) as excp_value, t.roundoff_value
from {{recon_trn_ttran}} t join {{scope}} s on t.recon_code = s.recon_code join {{loads}} l on t.scheduler_gid = l.scheduler_gid
where s.recontype_code in ('V', 'N') and t.delete_flag = 'N'""",
    "s7": f"""
select t.tran_gid, t.recon_code, l.load_date as tran_date, 1 as tran_mult, cast(0 as decimal(15,2)) as tran_value,
  cast(0 as decimal(15,2)) as excp_value, cast(0 as decimal(15,2)) as roundoff_value
from {{recon_trn_ttranko}} t join {{scope}} s on t.recon_code = s.recon_code join {{loads}} l on t.scheduler_gid = l.scheduler_gid
where s.recontype_code in ('V', 'N') and t.delete_flag = 'N'""",
    "s8": f"""
select {COLS} from {{fx_tran}} t join {{scope}} s on t.recon_code = s.recon_code
where t.delete_flag = 'N' and t.tran_date < {START} and {NET}""",
    "universe": """
select tran_gid, recon_code, tran_date, tran_mult, tran_value, excp_value, roundoff_value from (
  select *, row_number() over (partition by tran_gid order by source) as place from (
    select *, 4 as source from {s4} union all select *, 6 from {s6} union all select *, 5 from {s5}
    union all select *, 7 from {s7} union all select *, 8 from {s8}))
where place = 1""",
    "detail": f"""
select distinct d.kodtl_gid, k.ko_gid, k.ko_date, k.manual_matchoff, d.tran_gid, t.recon_code, t.tran_date
from {{universe}} t join {{recon_trn_tkodtl}} d on t.tran_gid = d.tran_gid and d.delete_flag = 'N'
join {{recon_trn_tko}} k on d.ko_gid = k.ko_gid and k.delete_flag = 'N' where t.tran_date >= {START}""",
    "ko_per_recon": f"""
select recon_code, count(distinct tran_gid) as ko_count,
  count(distinct case when manual_matchoff = 'Y' then tran_gid end) as manual_ko_count,
  count(distinct case when manual_matchoff = 'N' and tran_gid not in
    (select tran_gid from {{detail}} where manual_matchoff = 'Y') then tran_gid end) as system_ko_count
from {{detail}} where tran_date <= {END} group by recon_code""",
    "counts": f"""
select recon_code, count(case when t.tran_date >= {START} then 1 end) as tran_count,
  count(case when {NET} then 1 end) as excp_gross,
  count(case when {NET} and t.tran_date < {START} then 1 end) as opening_excp_count,
  count(case when t.excp_value = 0 then 1 end) as ko_zeroexcp_count,
  count(case when {NET} and t.tran_value <> t.excp_value and t.tran_date >= {START} then 1 end) as ko_partialexcp_count
from {{universe}} t group by recon_code""",
    "datasets": """
select s.recon_code, d.dataset_code from {scope} s
join {recon_mst_trecondataset} b on s.recon_code = b.recon_code and b.active_status = 'Y' and b.delete_flag = 'N'
join {recon_mst_tdataset} d on b.dataset_code = d.dataset_code and d.delete_flag = 'N'""",
    "dashboard": """
select s.recon_code,
  (select count(distinct dataset_code) from {datasets} d where d.recon_code = s.recon_code) as dataset_count,
  coalesce(c.tran_count, 0) as tran_count,
  coalesce(k.ko_count, 0) - coalesce(c.ko_partialexcp_count, 0) as ko_count,
  coalesce(k.system_ko_count, 0) as ko_system_count, coalesce(k.manual_ko_count, 0) as ko_manual_count,
  coalesce(c.excp_gross, 0) - coalesce(c.ko_partialexcp_count, 0) as excp_count,
  coalesce(c.opening_excp_count, 0) as opening_excp_count, coalesce(c.ko_zeroexcp_count, 0) as ko_zeroexcp_count,
  coalesce(c.ko_partialexcp_count, 0) as ko_partialexcp_count
from {scope} s left join {counts} c on s.recon_code = c.recon_code left join {ko_per_recon} k on s.recon_code = k.recon_code""",
    "all_open": """
select t.tran_gid, t.recon_code, t.tran_date, t.tran_mult, t.tran_value, t.excp_value, t.roundoff_value
from {recon_trn_ttran} t join {scope} s on t.recon_code = s.recon_code
where s.recontype_code in ('W', 'B', 'I') and t.delete_flag = 'N'
union all
select t.tran_gid, t.recon_code, cast(l.insert_date as date), 1, cast(1 as decimal(15,2)), cast(1 as decimal(15,2)), t.roundoff_value
from {recon_trn_ttran} t join {scope} s on t.recon_code = s.recon_code
join {recon_trn_tscheduler} l on t.scheduler_gid = l.scheduler_gid
where s.recontype_code in ('V', 'N') and t.delete_flag = 'N'""",
    "value_opening": f"""
select recon_code, count(*) as openingexcp_count,
  {money("sum(excp_value) - sum(roundoff_value) * sum(tran_mult)")} as openingexcp_value,
  {money("sum(excp_value - roundoff_value * tran_mult)")} as openingexcp_value_exact
from {{universe}} t where {NET} and tran_date < {START} group by recon_code""",
    "value_open": f"""
select recon_code, count(case when tran_date between {START} and {END} then 1 end) as bal_n,
  {sum_if(f"tran_date between {START} and {END}", "tran_value")} as bal_value,
  count(*) as all_bal_n, {money("sum(tran_value)")} as all_bal_value,
  count(case when tran_value <> excp_value and excp_value <> 0 and tran_value <> 0 then 1 end) as partial_n,
  {sum_if("tran_value <> excp_value and excp_value <> 0 and tran_value <> 0", "excp_value")} as partialexcp_value,
  {sum_if(f"tran_value <> excp_value and excp_value <> 0 and tran_value <> 0 and tran_date between {START} and {END}",
          "tran_value - excp_value")} as partialmatch_value,
  count(case when tran_value = excp_value and excp_value <> 0 then 1 end) as excp_count,
  {sum_if("tran_value = excp_value and excp_value <> 0", "excp_value")} as excp_value
from {{all_open}} group by recon_code""",
    "value_matched": f"""
select t.recon_code, count(case when tran_date between {START} and {END} then 1 end) as ko_count,
  {sum_if(f"tran_date between {START} and {END}", "tran_value")} as ko_value,
  count(*) as all_ko_n, {money("sum(tran_value)")} as all_ko_value
from {{recon_trn_ttranko}} t where delete_flag = 'N' group by t.recon_code""",
    "value_base": f"""
select s.recon_code, s.recontype_code, coalesce(bal_n, 0) + coalesce(ko_count, 0) as tran_n,
  {money("coalesce(bal_value, 0) + coalesce(ko_value, 0)")} as tran_value,
  coalesce(all_bal_n, 0) + coalesce(all_ko_n, 0) as all_tran_n,
  {money("coalesce(all_bal_value, 0) + coalesce(all_ko_value, 0)")} as all_tran_value,
  coalesce(ko_count, 0) as ko_count, {money("coalesce(ko_value, 0)")} as ko_value, coalesce(partial_n, 0) as partial_n,
  {money("coalesce(partialexcp_value, 0)")} as partialexcp_value, {money("coalesce(partialmatch_value, 0)")} as partialmatch_value,
  coalesce(excp_count, 0) as excp_count, {money("coalesce(excp_value, 0)")} as excp_value,
  coalesce(openingexcp_count, 0) as openingexcp_count, {money("coalesce(openingexcp_value, 0)")} as openingexcp_value,
  {money("coalesce(openingexcp_value_exact, 0)")} as openingexcp_value_exact
from {{scope}} s left join {{value_open}} o on s.recon_code = o.recon_code
left join {{value_matched}} m on s.recon_code = m.recon_code left join {{value_opening}} p on s.recon_code = p.recon_code""",
    "fact": f"""
select d.kodtl_gid, s.recon_code, s.recon_name, s.recontype_code, d.tran_gid, d.ko_value, k.manual_matchoff, t.dataset_code,
  case when d.ko_mult = -1 then 'D' else 'C' end as tran_acc_mode, d.ko_mult as tran_mult, e.rule_name, e.rule_order,
  e.source_dataset_code, e.comparison_dataset_code
from {{scope}} s join {{recon_trn_tko}} k on s.recon_code = k.recon_code and k.delete_flag = 'N'
join {{recon_trn_tkodtl}} d on k.ko_gid = d.ko_gid and d.delete_flag = 'N'
join {{fx_tran}} t on d.tran_gid = t.tran_gid and t.delete_flag = 'N'
left join {{recon_mst_trule}} e on k.rule_code = e.rule_code and e.delete_flag = 'N'
where k.ko_date between {START} and {END}""",
    "rule_lines": f"""
select recon_code, dataset_code, rule_order, '  ' || min(rule_name) as row_label, {LINE}
from {{fact}} where manual_matchoff = 'N' group by recon_code, dataset_code, rule_order""",
    "manual_lines": f"""
select recon_code, dataset_code, '  Manual KO' as row_label, {LINE}
from {{fact}} where manual_matchoff = 'Y' group by recon_code, dataset_code""",
    "lines": """
select recon_code, dataset_code, rule_order, 3 as section, row_label, dr_count, dr_value, cr_count, cr_value from {rule_lines}
union all
select recon_code, dataset_code, null, 4, row_label, dr_count, dr_value, cr_count, cr_value from {manual_lines}""",
    "recon_rule_lines": f"""
select recon_code, min(dataset_code) as dataset_code, rule_order, '  ' || min(rule_name) as row_label, {LINE}
from {{fact}} where manual_matchoff = 'N' group by recon_code, rule_order""",
    "recon_lines": f"""
select recon_code, dataset_code, rule_order, 3 as section, row_label, dr_count, dr_value, cr_count, cr_value
from {{recon_rule_lines}}
union all
select recon_code, min(dataset_code), null, 4, '  Manual KO', {DR}, {sum_if("tran_acc_mode = 'D'", "ko_value")},
  {CR}, {sum_if("tran_acc_mode = 'C'", "ko_value")}
from {{fact}} where manual_matchoff = 'Y' group by recon_code""",
    "default_rows": f"""
select recon_code, null as dataset_code, cast(null as decimal(9,2)) as rule_order, 1 as section, recon_name as row_label, {NO_SUMS}
from (select distinct recon_code, recon_name from {{fact}})
union all
select f.recon_code, f.dataset_code, null, 2, d.dataset_name, null, null, null, null
from (select distinct recon_code, dataset_code from {{fact}}) f left join {{recon_mst_tdataset}} d on f.dataset_code = d.dataset_code
union all select recon_code, dataset_code, rule_order, section, row_label, dr_count, dr_value, cr_count, cr_value from {{lines}}
union all select recon_code, dataset_code, null, 5, 'Sub Total', {SUMS} from {{lines}} group by recon_code, dataset_code
union all select distinct recon_code, 'XXX9999999999999999', null, 6, '', null, null, null, null from {{lines}}
union all select recon_code, null, null, 7, 'Grant Total', {SUMS} from {{lines}} group by recon_code""",
    "recon_rows": f"""
select recon_code, null as dataset_code, cast(null as decimal(9,2)) as rule_order, 1 as section, recon_name as row_label,
  'White' as backcolor, 'Blue' as forecolor, {NO_SUMS}
from (select distinct recon_code, recon_name from {{fact}})
union all
select recon_code, dataset_code, rule_order, section, row_label, 'White', 'Black', dr_count, dr_value, cr_count, cr_value
from {{recon_lines}}
union all
select recon_code, min(dataset_code), null, 5, 'Sub Total', 'Yellow', 'Red', {SUMS} from {{recon_lines}} group by recon_code
union all
select distinct recon_code, 'XXX9999999999999999', null, 6, '', 'White', 'White', null, null, null, null from {{recon_lines}}""",
    "types": "select recon_code, recontype_code from {recon_mst_trecon}",
    "default_layout": f"""
select r.recon_code, case when section = 7 then 'ZZZ9999999' else r.recon_code end as sort_code, dataset_code, section,
  cast(row_number() over (partition by r.recon_code order by case when section = 7 then 1 else 0 end,
    dataset_code nulls first, section, rule_order nulls first) as int) as rec_slno,
  row_label, dr_count, {money("coalesce(dr_value, 0)")} as dr_value, {lakh("coalesce(dr_value, 0)")} as formal_dr_value,
  cr_count, {money("coalesce(cr_value, 0)")} as cr_value, {lakh("coalesce(cr_value, 0)")} as formal_cr_value,
  {money("case when dr_value > cr_value then dr_value - cr_value when cr_value > dr_value then cr_value - dr_value end")} as net_value,
  {lakh("case when dr_value > cr_value then dr_value - cr_value when cr_value > dr_value then cr_value - dr_value end")}
    as formal_net_value,
  case section when 1 then 'Yellow' when 5 then 'Yellow' when 7 then 'Black' else 'White' end as backcolor,
  case section when 1 then 'Red' when 2 then 'Blue' when 5 then 'Red' when 6 then 'White' when 7 then 'White' else 'Black' end
    as forecolor,
  t.recontype_code as recontype
from {{default_rows}} r join {{types}} t on r.recon_code = t.recon_code""",
    "proof_layout": f"""
select r.recon_code, dataset_code, section,
  cast(row_number() over (partition by r.recon_code order by section, rule_order nulls first) as int) as rec_slno,
  row_label, coalesce(dr_count, 0) as dr_count, {money("coalesce(dr_value, 0)")} as dr_value,
  {lakh("dr_value")} as formal_dr_value, coalesce(cr_count, 0) as cr_count, {money("coalesce(cr_value, 0)")} as cr_value,
  {lakh("cr_value")} as formal_cr_value, backcolor, forecolor, t.recontype_code as recontype
from {{recon_rows}} r join {{types}} t on r.recon_code = t.recon_code""",
    "folded": f"""
select recon_code, row_label, cast(sum(coalesce(dr_count, 0) + coalesce(cr_count, 0)) as bigint) as line_count,
  {money("sum(coalesce(dr_value, 0) + coalesce(cr_value, 0))")} as line_value, min(section) as section,
  min(rule_order) as rule_order, min(dataset_code) as dataset_code, min(backcolor) as backcolor, min(forecolor) as forecolor
from {{recon_rows}} group by recon_code, row_label""",
    "folded_layout": """
select *, cast(row_number() over (partition by recon_code
  order by section, rule_order nulls first, row_label) as int) as rec_slno from {folded}""",
    "pivot_rules": f"""
select recon_code, dataset_code, rule_order, source_dataset_code, comparison_dataset_code, '  ' || min(rule_name) as row_label, {LINE}
from {{fact}} where manual_matchoff = 'N'
group by recon_code, dataset_code, rule_order, source_dataset_code, comparison_dataset_code""",
    "pivot_rows": f"""
select recon_code, null as dataset_code, cast(null as decimal(9,2)) as rule_order, 1 as section, recon_name as row_label, {NO_SUMS},
  null as comparison_dataset_code, null as target_dataset_code, cast(null as bigint) as tdc, cast(null as decimal(18,2)) as tdv,
  cast(null as bigint) as tcc, cast(null as decimal(18,2)) as tcv
from (select distinct recon_code, recon_name from {{fact}})
union all
select f.recon_code, f.dataset_code, null, 2, d.dataset_name, null, null, null, null, null, null, null, null, null, null
from (select distinct recon_code, dataset_code from {{fact}}
      where manual_matchoff = 'N' and dataset_code <> comparison_dataset_code) f
left join {{recon_mst_tdataset}} d on f.dataset_code = d.dataset_code
union all
select a.recon_code, a.dataset_code, a.rule_order, 3, a.row_label, a.dr_count, a.dr_value, a.cr_count, a.cr_value,
  a.comparison_dataset_code, b.dataset_code, b.dr_count, b.dr_value, b.cr_count, b.cr_value
from (select * from {{pivot_rules}} where dataset_code = source_dataset_code) a
left join (select * from {{pivot_rules}} where dataset_code <> source_dataset_code) b
  on a.recon_code = b.recon_code and a.rule_order = b.rule_order and a.row_label = b.row_label
union all
select recon_code, dataset_code, null, 4, row_label, dr_count, dr_value, cr_count, cr_value, null, null, null, null, null, null
from {{manual_lines}}""",
    "pivot_layout": f"""
select r.recon_code, r.dataset_code, section,
  cast(row_number() over (partition by r.recon_code order by r.dataset_code nulls first, section, rule_order nulls first,
    target_dataset_code nulls first) as int) as rec_slno, row_label,
  dr_count, {money("coalesce(dr_value, 0)")} as dr_value, {lakh("coalesce(dr_value, 0)")} as formal_dr_value,
  cr_count, {money("coalesce(cr_value, 0)")} as cr_value, {lakh("coalesce(cr_value, 0)")} as formal_cr_value,
  {money("coalesce(dr_value, 0) - coalesce(cr_value, 0)")} as net_value,
  {lakh("coalesce(dr_value, 0) - coalesce(cr_value, 0)")} as formal_net_value, target_dataset_code,
  tdc as target_dr_count, {money("coalesce(tdv, 0)")} as target_dr_value, {lakh("coalesce(tdv, 0)")} as target_formal_dr_value,
  tcc as target_cr_count, {money("coalesce(tcv, 0)")} as target_cr_value, {lakh("coalesce(tcv, 0)")} as target_formal_cr_value,
  {money("coalesce(tdv, 0) - coalesce(tcv, 0)")} as target_net_value,
  {lakh("coalesce(tdv, 0) - coalesce(tcv, 0)")} as target_formal_net_value,
  case section when 1 then 'Yellow' else 'White' end as backcolor,
  case section when 1 then 'Red' when 2 then 'Blue' else 'Black' end as forecolor,
  d.dataset_name as target_label, 'Target' as group_target_row_label, t.recontype_code as recontype
from {{pivot_rows}} r join {{types}} t on r.recon_code = t.recon_code
left join {{recon_mst_tdataset}} d on r.comparison_dataset_code = d.dataset_code""",
    # Matching: rows of a key, ranks, sums.
    "ranked": """
select *, row_number() over (partition by recon_code, ref_no, tran_value, dataset_code order by tran_date, tran_gid) as place
from {fx_mtm_feed}""",
    "pairs": """
select a.recon_code, a.ref_no, a.tran_gid as gl, b.tran_gid as bnk, a.tran_value
from {ranked} a join {ranked} b on a.recon_code = b.recon_code and a.ref_no = b.ref_no and a.tran_value = b.tran_value
  and a.place = b.place where a.dataset_code = 'GL' and b.dataset_code = 'BNK'""",
    "lone": """
select * from (
  select *, row_number() over (partition by recon_code, ref_no, tran_value, dataset_code order by tran_date, tran_gid) as rest
  from {fx_mtm_feed} f anti join (select gl as paired from {pairs} union all select bnk from {pairs}) p on f.tran_gid = p.paired)""",
    # Nearest amount of the other side: the last one before or the first one after, in order of amounts.
    "around": """
select recon_code, ref_no, dataset_code, v,
  max(case when dataset_code = 'BNK' then v end) over before as low_b, max(case when dataset_code = 'GL' then v end) over before as low_g,
  min(case when dataset_code = 'BNK' then v end) over after as high_b, min(case when dataset_code = 'GL' then v end) over after as high_g
from (select distinct recon_code, ref_no, dataset_code, tran_value as v from {lone})
window before as (partition by recon_code, ref_no order by v, dataset_code rows between unbounded preceding and current row),
  after as (partition by recon_code, ref_no order by v, dataset_code rows between current row and unbounded following)""",
    "nearest": """
select recon_code, ref_no, dataset_code, v, case when high is null or v - low <= high - v then low else high end as w
from (select *, case dataset_code when 'GL' then low_b else low_g end as low, case dataset_code when 'GL' then high_b else high_g end as high
  from {around})
where least(coalesce(v - low, high - v), coalesce(high - v, v - low)) <= 2500""",
    "mates": """
select a.recon_code, a.ref_no, a.v as gl_v, a.w as bnk_v from {nearest} a join {nearest} b
  on a.recon_code = b.recon_code and a.ref_no = b.ref_no and a.v = b.w and a.w = b.v
where a.dataset_code = 'GL' and b.dataset_code = 'BNK'""",
    "near_pairs": """
select m.recon_code, a.tran_gid as gl, b.tran_gid as bnk, m.gl_v, m.bnk_v
from {mates} m join {lone} a on a.recon_code = m.recon_code and a.ref_no = m.ref_no and a.dataset_code = 'GL' and a.tran_value = m.gl_v
join {lone} b on b.recon_code = m.recon_code and b.ref_no = m.ref_no and b.dataset_code = 'BNK' and b.tran_value = m.bnk_v
  and b.rest = a.rest""",
    # Keys with very many rows: rank within an amount, rows of an amount that pair; then neighbours in order of amounts.
    "hot_ranked": """
select *, least(ng, nb) as pairs from (
  select *, row_number() over (partition by recon_code, ref_no, tran_value, dataset_code order by tran_date, tran_gid) as place,
    count(case when dataset_code = 'GL' then 1 end) over (partition by recon_code, ref_no, tran_value) as ng,
    count(case when dataset_code = 'BNK' then 1 end) over (partition by recon_code, ref_no, tran_value) as nb
  from {fx_hot})""",
    "hot_levels": """
select *, case when lag(dataset_code) over by_value <> dataset_code and v - lag(v) over by_value <= 3 then v - lag(v) over by_value end as down,
  case when lead(dataset_code) over by_value <> dataset_code and lead(v) over by_value - v <= 3 then lead(v) over by_value - v end as up
from (select distinct recon_code, ref_no, dataset_code, tran_value as v, abs(ng - nb) as n from {hot_ranked} where place > pairs)
window by_value as (partition by recon_code, ref_no order by v)""",
    "hot_mates": """
select recon_code, ref_no, dataset_code, v, n, case when lower then low else high end as mate, case when lower then low_n else high_n end as mate_n
from (
  select *, coalesce(down <= coalesce(up, down) and down < coalesce(lag(down) over by_value, 4), false) as lower,
    coalesce(up < coalesce(down, 4) and up <= coalesce(lead(up) over by_value, up), false) as upper,
    lag(v) over by_value as low, lead(v) over by_value as high, lag(n) over by_value as low_n, lead(n) over by_value as high_n
  from {hot_levels} window by_value as (partition by recon_code, ref_no order by v))
where lower or upper""",
    "key_sums": f"""
select recon_code, ref_no, count(case when dataset_code = 'GL' then 1 end) as ng, count(case when dataset_code = 'BNK' then 1 end) as nb,
  {sum_if("dataset_code = 'GL'", "tran_value")} as sg, {sum_if("dataset_code = 'BNK'", "tran_value")} as sb,
  min(tran_gid) as first_tran_gid, max(tran_gid) as last_tran_gid
from {{fx_mtm_feed}} group by recon_code, ref_no""",
    # Parents with breakups: which recons run, and what is left by order of rules (T, S then T, T then S).
    "tallied": f"""
select s.recon_code from {{scope}} s left join (
  select recon_code, sum(tran_value * tran_mult) as balance from {{fx_parent}} where tran_date <= {END} group by recon_code) x
  on s.recon_code = x.recon_code
where not (s.recontype_code in ('W', 'B') and coalesce(x.balance, 0) <> 0)""",
    "owned": f"""
select o.variant, f.*, f.tran_date between {START} and {END} and r.recon_code is not null as play, o.variant <> 'T' and q.paired is not null
    and f.tran_date between {START} and {END} and r.recon_code is not null as taken
from {{fx_mtm_feed}} f join (select 'T' as variant union all select 'ST' union all select 'TS') o on true
left join (select gl as paired from {{pairs}} union all select bnk from {{pairs}}) q on f.tran_gid = q.paired
left join {{tallied}} r on f.recon_code = r.recon_code""",
    "owned_sums": """
select *, sum(rest) over (partition by variant, parent_gid order by tran_date, tran_gid) - rest as earlier,
  sum(rest) over (partition by variant, parent_gid) as own,
  least(sum(case when dataset_code = 'GL' then rest else 0 end) over (partition by variant, recon_code, ref_no),
        sum(case when dataset_code = 'BNK' then rest else 0 end) over (partition by variant, recon_code, ref_no)) as common,
  sum(case when dataset_code = 'GL' then tran_value else -tran_value end) over (partition by variant, recon_code, ref_no) = 0 as even
from (select *, case when taken then 0 else tran_value end as rest from {owned})""",
    "owned_left": """
select *, greatest(least(rest, room - earlier), 0) as kept
from (select *, case when not play then own when variant <> 'TS' then own - common when even then 0 else own end as room from {owned_sums})""",
    "answer": """
select recon_code, tran_gid, dataset_code, tran_date, tran_acc_mode, tran_mult, tran_value, excp_value, roundoff_value, kind,
  recon_code || '-R' || case kind when 'EXACT' then '1' when 'SPLIT' then '2' when 'ROUNDOFF' then '3' else '4' end as rule_code
from {fx_tran} where delete_flag = 'N'""",
    "preview": """
select cast(1 as bigint) as job_gid, a.recon_code, a.rule_code, r.rule_name, r.rule_order, a.dataset_code, a.tran_gid, a.tran_date,
  a.tran_acc_mode, cast(a.tran_value - a.excp_value as decimal(15,2)) as ko_value, a.tran_mult as ko_mult, a.roundoff_value
from {answer} a join {recon_mst_trule} r on a.rule_code = r.rule_code where a.kind <> 'MISSING'""",
}


def stats_sql(source: str, dataset: str) -> str:
    return f"""select recon_code, {dataset} as dataset_code,
  count(case when tran_acc_mode = 'D' then 1 end) as dr_count, {sum_if("tran_acc_mode = 'D'", "excp_value")} as dr_value,
  count(case when tran_acc_mode = 'C' then 1 end) as cr_count, {sum_if("tran_acc_mode = 'C'", "excp_value")} as cr_value,
  count(*) as n, {money("sum(excp_value)")} as v from {source} where excp_value > 0 group by recon_code, {dataset}"""


def run_stats_sql(before: str, after: str, dataset: str, feed: str, flag: str = "Y") -> str:
    columns = [("dr_count", "dr_count"), ("dr_value", "dr_value"), ("cr_count", "cr_count"), ("cr_value", "cr_value"),
               ("n", "count"), ("v", "value")]
    first = ", ".join(f"b.{c} as before_{n}" for c, n in columns)
    last = ", ".join(
        (f"{money(f'coalesce(a.{c}, 0)')}" if n.endswith("value") else f"coalesce(a.{c}, 0)") + f" as after_{n}" for c, n in columns
    )
    return f"""select b.recon_code, b.dataset_code, '{feed}' as feed, '{flag}' as automatch_flag, {first}, {last}
from ({stats_sql(before, dataset)}) b left join ({stats_sql(after, dataset)}) a
  on a.recon_code = b.recon_code and a.dataset_code = b.dataset_code"""


def ko_row(where: str) -> str:
    return f"""select recon_code, recon_code || '-M' as rule_code, ng as dr_count, sg as dr_value, nb as cr_count, sb as cr_value,
  cast(0 as decimal(18,2)) as roundoff_value, first_tran_gid, last_tran_gid from {{key_sums}} where sg = sb and {where}"""


def owned_stats(flag: str, job: int) -> str:
    """Statistics of a run with rules on breakups and then on trans."""
    rows = "{tallied} r on x.recon_code = r.recon_code" + (f" where x.tran_date between {START} and {END}" if flag == "N" else "")
    left = "select distinct parent_gid, recon_code, dataset_code, tran_date, tran_acc_mode, room as excp_value from {owned_left} where variant = 'ST'"
    below = "select recon_code, dataset_code, tran_date, tran_acc_mode, kept as excp_value from {owned_left} where variant = 'ST'"
    parts = [
        run_stats_sql(f"(select x.* from {before} x join {rows})", f"(select x.* from ({after}) x join {rows})", "dataset_code", feed, flag)
        for feed, before, after in (("tran", "{fx_parent}", left), ("breakup", "{fx_mtm_feed}", below))
    ]
    return f"select *, cast({job} as bigint) as job_gid from ({' union all '.join(parts)})"


PAIR = f"""select recon_code, recon_code || '-M' as rule_code, cast(1 as bigint) as dr_count, {money("tran_value")} as dr_value,
  cast(1 as bigint) as cr_count, {money("tran_value")} as cr_value, cast(0 as decimal(18,2)) as roundoff_value,
  least(gl, bnk) as first_tran_gid, greatest(gl, bnk) as last_tran_gid from {{pairs}}"""
SIDE_COLUMNS = "kodtl_gid, tran_gid, dataset_code, source_dataset_code, comparison_dataset_code"
SUBTOTAL = f"""{SUMS}, cast(sum(dr_count) + sum(cr_count) as bigint) as tot_count,
  {money("abs(sum(dr_value) - sum(cr_value))")} as tot_value"""
DISPATCH = "layout, recon_code, section, rec_slno, row_label"
ALIVE = "from {recon_trn_ttran} t join {scope} s on t.recon_code = s.recon_code where t.delete_flag = 'N'"
VALUE = "v.ko_value + v.partialmatch_value"
WHOLE = "v.tran_value + v.openingexcp_value"

TEXTS = {
    "scope_by_code": "select s.*, t.tran_count, t.tran_value from {scope} s left join {totals} t on s.recon_code = t.recon_code",
    "scope_by_user": """
select distinct s.recon_code, s.recon_name, s.recontype_code, u.user_code, t.tran_count, t.tran_value
from {admin_mst_tusercontext} u join {admin_mst_treconcontext} c
  on u.master_syscode = c.master_syscode and u.parent_master_syscode = c.parent_master_syscode and c.delete_flag = 'N'
join {scope} s on s.recon_code = c.recon_code left join {totals} t on s.recon_code = t.recon_code
where u.active_status = 'Y' and u.delete_flag = 'N' and u.user_code in ('U1', 'U2')""",
    "eligible_recons": """
select s.*, m.recon_date_field, m.recon_date_flag, m.recon_rule_version, t.tran_count, t.tran_value
from {scope} s join {recon_mst_trecon} m on s.recon_code = m.recon_code left join {totals} t on s.recon_code = t.recon_code
where exists (select 1 from {recon_mst_trule} r where r.recon_code = s.recon_code and r.hold_flag = 'N')""",
    "active_rules": """
select r.rule_code, r.recon_code, r.rule_order, r.rule_apply_on, r.group_flag, r.system_match_flag, r.probable_match_flag, k.ko_count
from {recon_mst_trule} r left join (select rule_code, count(*) as ko_count from {recon_trn_tko} where delete_flag = 'N'
  group by rule_code) k on r.rule_code = k.rule_code where r.hold_flag = 'N'""",
    "dataset_count": """
select s.recon_code, (select count(distinct dataset_code) from {datasets} d where d.recon_code = s.recon_code) as dataset_count,
  t.tran_count, t.tran_value from {scope} s left join {totals} t on s.recon_code = t.recon_code""",
    "open_in_window": "select * from {s4}",
    "matched_in_window": "select * from {s5}",
    "open_by_load_date": "select * from {s6}",
    "matched_by_load_date": "select * from {s7}",
    "opening_exceptions": "select * from {s8}",
    "tran_universe": "select * from {universe}",
    "universe_collisions": """
select t.recon_code, t.tran_gid, t.tran_date, l.tran_date as load_date from {s8} t
join (select * from {s6} union all select * from {s7}) l on t.tran_gid = l.tran_gid""",
    "ko_detail": "select * from {detail}",
    "value_universe": "select * from {all_open}",
    "ko_line_fact": """select kodtl_gid, recon_code, recon_name, recontype_code, tran_gid, ko_value, manual_matchoff, dataset_code,
  tran_acc_mode, tran_mult, rule_name, rule_order from {fact}""",
    "ko_line_fact_sides": f"select {SIDE_COLUMNS} from {{fact}}",
    "net_exceptions": f"""
select t.recon_code, t.tran_gid, t.excp_value, {money("t.excp_value - t.roundoff_value * t.tran_mult")} as net_value
from {{fx_tran}} t where t.delete_flag = 'N' and {NET}""",
    "partial_exceptions": f"""
select t.recon_code, t.tran_gid, t.tran_value, t.excp_value from {{universe}} t
where {NET} and t.tran_value <> t.excp_value and t.tran_date >= {START}""",
    "fully_open": "select recon_code, tran_gid, excp_value from {all_open} where tran_value = excp_value and excp_value <> 0",
    "configured_date_filter": f"""
select t.recon_code, t.tran_gid, t.tran_date, t.tran_date between {START} and {END} as in_period {ALIVE}""",
    "dashboard_counts": "select * from {dashboard}",
    "dashboard_counts_scope": "select count(*) as recon_count, (select count(distinct dataset_code) from {datasets}) as dataset_count, "
    + ", ".join(
        f"cast(sum({c}) as bigint) as {c}"
        for c in ("tran_count", "ko_count", "ko_system_count", "ko_manual_count", "excp_count", "opening_excp_count",
                  "ko_zeroexcp_count", "ko_partialexcp_count")
    )
    + " from {dashboard}",
    "ko_system_vs_manual": "select recon_code, manual_ko_count, system_ko_count, ko_count from {ko_per_recon}",
    "exception_aging": f"""
select a.aging_gid, a.aging_desc, coalesce(x.n, 0) as excp_count,
  cast({percent("coalesce(x.n, 0)", "greatest(w.n, 1)")} as decimal(6,2)) as excp_percent
from {{recon_mst_taging}} a left join (
  select b.aging_gid, count(*) as n from {{universe}} t join {{recon_mst_taging}} b
    on date_diff('day', t.tran_date, {AS_OF}) between b.aging_from and b.aging_to and b.delete_flag = 'N'
  where {NET} group by b.aging_gid) x on a.aging_gid = x.aging_gid
join (select count(*) as n from {{universe}} t where {NET}) w on true""",
    "value_dashboard": f"""
select recon_code, cast(tran_n as varchar) || ' - Lines' as tran_count, tran_value, ko_count, ko_value,
  partial_n as ko_partialexcp_count, excp_count, excp_value, partialmatch_value, partialexcp_value,
  {money("partialexcp_value + partialmatch_value")} as partialexcpmatch_value, openingexcp_value, openingexcp_value_exact,
  openingexcp_count, recontype_code, {lakh("tran_value")} as c_tran_value, {lakh("ko_value + partialmatch_value")} as c_ko_value,
  {lakh("partialexcp_value")} as c_partialexpense_value, {lakh("partialmatch_value")} as c_partialmatch_value,
  {lakh("partialexcp_value")} as c_partialexcp_value, {lakh("excp_value")} as c_excp_value,
  {lakh("openingexcp_value")} as c_openingexcp_value, tran_value as v_totaltran_value, all_tran_value as v_totaltran_expvalue
from {{value_base}}""",
    "value_dashboard_percents": f"""
select v.recon_code, {share(VALUE, WHOLE, " (")} as p_ko_value, {share("v.excp_value", WHOLE, " (")} as p_exp_value,
  {share("v.partialexcp_value", "v.all_tran_value", " (")} as p_partialexpense_value,
  {share("v.partialmatch_value", "v.tran_value", " (")} as p_partialmatch_value,
  {share("v.partialexcp_value", WHOLE, " (")} as p_partialexp_value,
  {share("v.ko_count", "v.tran_n", " - Lines (")} as p_ko_count, {share("v.excp_count", "v.all_tran_n", " - Lines (")} as p_excp_count,
  {share("v.partial_n", "v.all_tran_n", " - Lines (")} as p_partial_count
from {{value_base}} v""",
    "summ_header_rows": """
select distinct recon_code, null as dataset_code, 1 as section, recon_name as row_label from {fact}
union all
select f.recon_code, f.dataset_code, 2, d.dataset_name from (select distinct recon_code, dataset_code from {fact}) f
left join {recon_mst_tdataset} d on f.dataset_code = d.dataset_code""",
    "summ_rule_rows": "select * from {rule_lines}",
    "summ_manual_rows": "select * from {manual_lines}",
    "summ_subtotal": f"select recon_code, dataset_code, {SUBTOTAL} from {{lines}} group by recon_code, dataset_code",
    "summ_grand_total": f"select recon_code, {SUBTOTAL} from {{lines}} group by recon_code",
    "summ_rule_rows_by_recon": "select * from {recon_rule_lines}",
    "summ_subtotal_by_recon": f"select recon_code, min(dataset_code) as dataset_code, {SUBTOTAL} from {{recon_lines}} group by recon_code",
    "summ_default": "select * from {default_layout}",
    "summ_proof": "select * from {proof_layout}",
    "summ_value_based": f"""select recon_code, dataset_code, section, rec_slno, row_label, line_count, line_value,
  {crore("line_value")} as formal_line_value, backcolor, forecolor
from (select * replace (case when section = 1 then 'Value Based' else row_label end as row_label) from {{folded_layout}})""",
    "summ_non_value_based": """select recon_code, dataset_code, section, rec_slno,
  case when section = 1 then 'Non Value Based' else row_label end as row_label, line_count, backcolor, forecolor
from {folded_layout}""",
    "summ_pivot": "select * from {pivot_layout}",
    "summ_dispatch": """
select 'proof' as layout, recon_code, section, rec_slno, row_label, dr_count, cast(null as bigint) as line_count,
  cast(null as bigint) as target_cr_count from {proof_layout} where recontype = 'W'
union all
select case t.recontype_code when 'V' then 'value' else 'non_value' end, f.recon_code, section, rec_slno,
  case when section <> 1 then row_label when t.recontype_code = 'V' then 'Value Based' else 'Non Value Based' end,
  null, line_count, null from {folded_layout} f join {types} t on f.recon_code = t.recon_code where t.recontype_code in ('V', 'N')
union all
select 'pivot', recon_code, section, rec_slno, row_label, dr_count, null, target_cr_count from {pivot_layout}
where recontype in ('B', 'I')""",
    "summ_dispatch_money": """
select 'proof' as layout, recon_code, section, rec_slno, cast(dr_value as decimal(18,2)) as dr_value, cast(cr_value as decimal(18,2)) as cr_value,
  cast(null as decimal(18,2)) as line_value, cast(null as decimal(18,2)) as target_dr_value, cast(null as decimal(18,2)) as target_cr_value
from {proof_layout} where recontype = 'W'
union all
select case t.recontype_code when 'V' then 'value' else 'non_value' end, f.recon_code, section, rec_slno, null, null,
  case t.recontype_code when 'V' then line_value end, null, null
from {folded_layout} f join {types} t on f.recon_code = t.recon_code where t.recontype_code in ('V', 'N')
union all
select 'pivot', recon_code, section, rec_slno, dr_value, cr_value, null, target_dr_value, target_cr_value from {pivot_layout}
where recontype in ('B', 'I')""",
    "match_one_to_one": PAIR,
    "match_one_to_one_tolerance": f"""{PAIR} union all
select recon_code, recon_code || '-M', 1, {money("least(gl_v, bnk_v)")}, 1, {money("least(gl_v, bnk_v)")},
  {money("bnk_v - gl_v")}, least(gl, bnk), greatest(gl, bnk) from {{near_pairs}}""",
    "match_one_to_many": ko_row("((ng = 1 and nb > 1) or (ng > 1 and nb = 1))"),
    "match_many_to_many": ko_row("ng > 1 and nb > 1"),
    "match_mtm_then_otm": ko_row("ng + nb > 2 and ng > 0 and nb > 0"),
    "match_partial": """
select recon_code, tran_gid, cast(taken as decimal(15,2)) as ko_value, tran_mult as ko_mult from (
  select f.*, least(greatest(least(k.sg, k.sb) - (sum(f.tran_value) over (partition by f.recon_code, f.ref_no, f.dataset_code
    order by f.tran_date, f.tran_gid) - f.tran_value), 0), f.tran_value) as taken
  from {fx_mtm_feed} f join {key_sums} k on f.recon_code = k.recon_code and f.ref_no = k.ref_no) where taken > 0""",
    "match_hot_one_to_one": """
select recon_code, tran_gid, cast(case when place <= pairs then 0 else tran_value end as decimal(15,2)) as excp_value, roundoff_value
from {hot_ranked}""",
    "match_hot_tolerance": """
select h.recon_code, h.tran_gid,
  cast(case when h.place <= h.pairs then 0 when m.mate is null or h.place - h.pairs > least(m.n, m.mate_n) then h.tran_value
    else greatest(h.tran_value - m.mate, 0) end as decimal(15,2)) as excp_value,
  cast(case when h.place > h.pairs and m.mate is not null and h.place - h.pairs <= least(m.n, m.mate_n)
    then greatest(h.tran_value - m.mate, 0) * h.tran_mult else 0 end as decimal(15,2)) as roundoff_value
from {hot_ranked} h left join {hot_mates} m
  on h.recon_code = m.recon_code and h.ref_no = m.ref_no and h.dataset_code = m.dataset_code and h.tran_value = m.v""",
    "match_hot_one_to_many": "select recon_code, tran_gid, cast(0 as decimal(15,2)) as excp_value, roundoff_value from {fx_hot_one}",
    "match_hot_many_to_many": "select recon_code, tran_gid, cast(0 as decimal(15,2)) as excp_value, roundoff_value from {fx_hot}",
    "match_hot_partial": """
select recon_code, tran_gid, cast(tran_value - greatest(least(least(sg, sb) - earlier, tran_value), 0) as decimal(15,2)) as excp_value, roundoff_value
from (
  select *, sum(case when dataset_code = 'GL' then tran_value else 0 end) over (partition by recon_code, ref_no) as sg,
    sum(case when dataset_code = 'BNK' then tran_value else 0 end) over (partition by recon_code, ref_no) as sb,
    sum(tran_value) over (partition by recon_code, ref_no, dataset_code order by tran_date, tran_gid) - tran_value as earlier
  from {fx_hot} where dataset_code = 'GL' or tran_value > 20000)""",
    "match_breakup": """
select p.recon_code, p.tran_gid, p.tran_value, cast(p.tran_value - coalesce(x.taken, 0) as decimal(15,2)) as excp_value
from {fx_parent} p left join (
  select f.parent_gid, sum(f.tran_value) as taken from {fx_mtm_feed} f
  where f.tran_gid in (select gl from {pairs}) or f.tran_gid in (select bnk from {pairs}) group by f.parent_gid) x
  on p.tran_gid = x.parent_gid""",
    "match_breakup_after_tran": """
select p.recon_code, p.tran_gid, p.tran_value,
  cast(case when e.tran_gid is not null then 0 else p.tran_value - coalesce(x.taken, 0) end as decimal(15,2)) as excp_value
from {fx_parent} p
left join (select a.tran_gid from {fx_parent} a join {fx_parent} b on a.recon_code = b.recon_code and a.ref_no = b.ref_no
  and a.tran_value = b.tran_value and a.dataset_code <> b.dataset_code) e on p.tran_gid = e.tran_gid
left join (select f.parent_gid, sum(f.tran_value) as taken from {fx_mtm_feed} f
  join (select gl as paired from {pairs} union all select bnk from {pairs}) q on f.tran_gid = q.paired group by f.parent_gid) x
  on p.tran_gid = x.parent_gid""",
    "match_tran_after_breakup": f"""
select recon_code, tran_gid, {money("tran_value")} as whole, false as below_zero from {{fx_parent}}""",
    "match_mtm_partial_otm": """
select f.recon_code, f.tran_gid, cast(f.tran_value - greatest(least(greatest(least(k.sg, k.sb) - (sum(f.tran_value) over (
    partition by f.recon_code, f.ref_no, f.dataset_code order by f.tran_date, f.tran_gid) - f.tran_value), 0), f.tran_value), 0)
  as decimal(15,2)) as excp_value
from {fx_mtm_feed} f join {key_sums} k on f.recon_code = k.recon_code and f.ref_no = k.ref_no""",
    "match_fixpoint_chain": """
select recon_code, tran_gid,
  cast(case when place % 2 = 0 then 0.01 when last_place = place then tran_value else 0 end as decimal(15,2)) as excp_value,
  cast(case when place % 2 = 0 then 0.01 else 0 end as decimal(15,2)) as roundoff_value
from (select *, max(place) over (partition by recon_code, ref_no) as last_place from {fx_chain})""",
    "match_fixpoint_long_chain": """
select recon_code, tran_gid,
  cast(case when place % 2 = 0 then 0.01 when last_place = place then tran_value else 0 end as decimal(15,2)) as excp_value,
  cast(case when place % 2 = 0 then 0.01 else 0 end as decimal(15,2)) as roundoff_value, cast(2 as int) as rounds
from (select *, max(place) over (partition by recon_code, ref_no) as last_place from {fx_long_chain})""",
    "converged_recons": f"""
select m.recon_code, cast(1 + coalesce(x.pairs, 0) as int) as rounds, true as converged, x.excp_value
from {{recon_mst_trecon}} m left join (
  select recon_code, max(last_place // 2) as pairs,
    {money("sum(case when place % 2 = 0 then 0.01 when last_place = place then tran_value else 0 end)")} as excp_value
  from (select *, max(place) over (partition by recon_code, ref_no) as last_place from {{fx_recon_chain}}) group by recon_code) x
on m.recon_code = x.recon_code""",
    "match_reversals": """
select f.recon_code, f.tran_gid, cast(-f.tran_value as decimal(15,2)) as tran_value,
  cast(case when a.kind = 'EXACT' then 0 else -f.tran_value end as decimal(15,2)) as excp_value
from {fx_feed} f join {answer} a on f.tran_gid = a.tran_gid""",
    "proposals_within_a_rule": f"""
select recon_code, tran_gid, {money("case when dataset_code = 'GL' then least(tran_value, other) else tran_value end")} as proposed
from (select f.*, sum(case when dataset_code = 'BNK' then tran_value else 0 end) over (partition by recon_code, ref_no) as other
  from {{fx_feed}} f) where other > 0""",
    "ko_headers_two_runs": """
select recon_code, rule_code, cast(2 * count(distinct tran_gid // 4) as bigint) as ko_count, cast(2 * count(*) as bigint) as line_count
from {answer} where kind <> 'MISSING' group by recon_code, rule_code""",
    "match_rules_in_order": "select recon_code, tran_gid, tran_value, excp_value, roundoff_value from {answer}",
    "match_fixpoint": "select recon_code, tran_gid, rule_code, ko_value, ko_mult, roundoff_value from {preview}",
    "state_split": """
select recon_code, tran_gid, case when excp_value <> 0 then 'open' else 'matched' end as place, excp_value from {answer}""",
    "state_fingerprint": f"""
select recon_code, count(*) as tran_count, {money("sum(excp_value)")} as excp_value from {{recon_trn_ttran}}
where delete_flag = 'N' group by recon_code""",
    "preview_state": f"select t.recon_code, t.tran_gid, t.tran_date, t.excp_value {ALIVE} and t.tran_date between {START} and {END}",
    "probable_state": f"select t.recon_code, t.tran_gid, t.tran_date, t.excp_value {ALIVE}",
    "probable_preview": f"""
select x.recon_code, x.recon_code || x.suffix as rule_code, x.tran_gid, {money("sum(x.v)")} as proposed from (
  select a.recon_code, '-R1' as suffix, a.tran_gid, a.tran_value as v from {{fx_parent}} a join {{fx_parent}} b
    on a.recon_code = b.recon_code and a.ref_no = b.ref_no and a.tran_value = b.tran_value and a.dataset_code <> b.dataset_code
  union all
  select f.recon_code, '-R2', f.parent_gid, f.tran_value from {{fx_mtm_feed}} f
    join (select gl as paired from {{pairs}} union all select bnk from {{pairs}}) q on f.tran_gid = q.paired) x
join {{scope}} s on x.recon_code = s.recon_code group by x.recon_code, x.suffix, x.tran_gid""",
    "match_preview": "select * from {preview}",
    "matched_amount_report": f"""
select job_gid, recon_code, rule_code, dataset_code, count(distinct tran_gid) as tran_count,
  {sum_if("ko_mult = -1", "ko_value")} as dr_value, {sum_if("ko_mult <> -1", "ko_value")} as cr_value,
  {money("sum(roundoff_value)")} as roundoff_value
from {{preview}} group by job_gid, recon_code, rule_code, dataset_code""",
    "run_stats": run_stats_sql("{fx_feed}", "{answer}", "dataset_code", "tran")
    + " union all "
    + run_stats_sql("(select * from {recon_trn_ttranbrkp} where delete_flag = 'N')",
                    "(select * from {recon_trn_ttranbrkp} where delete_flag = 'N')", "tranbrkp_dataset_code", "breakup"),
    "exception_report": f"""
select t.recon_code, t.dataset_code, t.tran_gid, t.tran_date, t.tran_acc_mode, t.tran_value, t.excp_value,
  {money("t.excp_value - t.roundoff_value * t.tran_mult")} as net_excp_value, b.tranbrkp_gid,
  b.tranbrkp_dataset_code as brkp_dataset_code, b.excp_value as brkp_excp_value
from {{recon_trn_ttran}} t join {{scope}} s on t.recon_code = s.recon_code
left join {{recon_trn_ttranbrkp}} b on t.tran_gid = b.tran_gid and b.delete_flag = 'N' and b.excp_value <> 0
where t.delete_flag = 'N' and {NET}""",
    "tally_check": f"""
select s.recon_code, s.recontype_code, {money("coalesce(x.balance, 0)")} as balance,
  s.recontype_code not in ('W', 'B') or coalesce(x.balance, 0) = 0 as may_run
from {{scope}} s left join (select recon_code, sum(tran_value * tran_mult) as balance from {{fx_tran}}
  where delete_flag = 'N' and tran_date <= {END} group by recon_code) x on s.recon_code = x.recon_code""",
    "key_normalise": "select tran_gid, ref_no from {fx_feed}",
    "theme_reset": f"""
select t.recon_code, t.tran_gid, case when s.recon_code is not null and t.delete_flag = 'N' and t.tran_date between {START} and {END}
  then '' else t.theme_code end as theme_code
from {{recon_trn_ttran}} t left join {{scope}} s on t.recon_code = s.recon_code""",
    "theme_reset_breakups": f"""
select t.recon_code, t.tranbrkp_gid, case when s.recon_code is not null and t.delete_flag = 'N' and t.tran_date between {START} and {END}
  then '' else t.theme_code end as theme_code
from {{recon_trn_ttranbrkp}} t left join {{scope}} s on t.recon_code = s.recon_code""",
    "run_refused": f"""
select s.recon_code, 'not tallied' as reason from {{scope}} s join (select recon_code, sum(tran_value * tran_mult) as balance from {{fx_tran}}
  where delete_flag = 'N' and tran_date <= {END} group by recon_code) x on s.recon_code = x.recon_code
where s.recontype_code in ('W', 'B') and x.balance <> 0""",
    "run_outcome": f"""
select a.recon_code, a.tran_gid, a.tran_value,
  case when a.tran_date between {START} and {END} then a.excp_value else a.tran_value end as excp_value,
  case when a.tran_date between {START} and {END} then '' else 'OLD' end as theme_code
from {{answer}} a join {{scope}} s on a.recon_code = s.recon_code where s.recontype_code not in ('W', 'B')""",
    "run_preview": f"""
select x.mode, x.recon_code, x.rule_code, count(*) as line_count, {money("sum(x.v)")} as ko_value from (
  select m.mode, a.recon_code, case a.kind when 'SPLIT' then a.recon_code || '-R4' else a.rule_code end as rule_code,
    a.tran_value - a.excp_value as v
  from {{answer}} a join (select 'once' as mode union all select 'stable') m on true
  where a.kind <> 'MISSING' and a.tran_date between {START} and {END}
  union all
  select m.mode, a.recon_code, a.recon_code || '-R2', a.tran_value
  from {{answer}} a join (select 'once' as mode union all select 'stable') m
    on m.mode = 'once' or a.tran_date not between {START} and {END}
  where a.kind = 'SPLIT') x
join {{scope}} s on x.recon_code = s.recon_code where s.recontype_code not in ('W', 'B')
group by x.mode, x.recon_code, x.rule_code""",
    "committed_tables": f"""
select recon_code, tran_gid, excp_value, case when excp_value = 0 then 'matched' else 'open' end as place,
  {money("case when excp_value <> tran_value then tran_value - excp_value end")} as ko_value
from (select t.recon_code, t.tran_gid, t.tran_value, case when s.recontype_code not in ('W', 'B') and t.delete_flag = 'N'
    and t.tran_date between {START} and {END} then a.excp_value else t.tran_value end as excp_value
  from {{fx_open}} t left join {{scope}} s on t.recon_code = s.recon_code left join {{answer}} a on t.tran_gid = a.tran_gid)""",
    "committed_breakups": f"""
select variant, tran_gid as tranbrkp_gid, cast(kept as decimal(15,2)) as excp_value, {money("room")} as parent_value from {{owned_left}}""",
    "run_stats_both_modes": f"{owned_stats('Y', 7)} union all {owned_stats('N', 8)}",
    "run_stats_replaced": f"""
select b.recon_code, b.dataset_code, j.job as job_gid, b.n as before_count, {money("b.v")} as before_value, coalesce(a.n, 0) as after_count
from (select cast(1 as bigint) as job union all select 2) j
join (select 1 as job, * from ({stats_sql("{fx_feed}", "dataset_code")}) union all
      select 2, * from ({stats_sql("{answer}", "dataset_code")})) b on b.job = j.job
left join ({stats_sql("{answer}", "dataset_code")}) a on a.recon_code = b.recon_code and a.dataset_code = b.dataset_code
where j.job = 2 or b.dataset_code = 'BNK' and b.recon_code < 'RC2'""",
    "uncommitted_preview": f"""
select cast(9 as bigint) as job_gid, x.recon_code, x.recon_code || x.suffix as rule_code, x.rule_name, x.rule_order, x.dataset_code, x.tran_gid,
  x.tran_date, x.tran_acc_mode, cast(x.v as decimal(15,2)) as ko_value, x.tran_mult as ko_mult, cast(0 as decimal(15,2)) as roundoff_value
from (
  select f.recon_code, '-R2' as suffix, 'Split' as rule_name, cast(2 as decimal(9,2)) as rule_order, f.dataset_code, f.parent_gid as tran_gid,
    f.tran_date, f.tran_acc_mode, f.tran_value as v, f.tran_mult
  from {{fx_mtm_feed}} f join {{key_sums}} k on f.recon_code = k.recon_code and f.ref_no = k.ref_no
  where k.sg = k.sb and k.ng + k.nb > 2
  union all
  select f.recon_code, '-R4', 'Partial', cast(4 as decimal(9,2)), f.dataset_code, f.tran_gid, f.tran_date, f.tran_acc_mode, least(k.sg, k.sb), f.tran_mult
  from {{fx_parent}} f join {{key_sums}} k on f.recon_code = k.recon_code and f.ref_no = k.ref_no
  where not (k.sg = k.sb and k.ng + k.nb > 2) and k.ng > 0 and k.nb > 0) x
join {{scope}} s on x.recon_code = s.recon_code where x.tran_date between {START} and {END}""",
    "committed_delta": f"""
select recon_code, tran_gid, excp_value, theme_code, case when excp_value = 0 then 'matched' else 'open' end as place,
  {money("case when excp_value <> tran_value then tran_value - excp_value end")} as ko_value
from (select t.recon_code, t.tran_gid, t.tran_value, case when p.play then a.excp_value else t.tran_value end as excp_value,
    case when p.play then '' else t.theme_code end as theme_code
  from {{fx_open}} t left join {{answer}} a on t.tran_gid = a.tran_gid
  left join {{scope}} s on t.recon_code = s.recon_code
  join (select true as play union all select false) p on p.play = coalesce(s.recontype_code not in ('W', 'B') and t.delete_flag = 'N'
    and t.tran_date between {START} and {END}, false))""",
    "theme_tag": f"""
select t.recon_code, t.tran_gid, case when not {NET} then t.theme_code when t.excp_value < t.tran_value then 'PARTLY'
  when t.excp_value >= 300000 then 'LARGE' when date_diff('day', t.tran_date, {AS_OF}) > 365 then 'AGED' else t.theme_code
  end as theme_code
from {{recon_trn_ttran}} t where t.delete_flag = 'N'""",
}

# Reports of other periods: the same text with other dates.
PERIODS = {
    "year": (START, END),
    "within": ("date '1996-03-15'", "date '1996-07-10'"),
    "all": ("date '1990-01-01'", "date '2005-12-31'"),
}


def in_periods(name: str) -> str:
    """The answer of a report for several periods."""
    sql = with_prefix(TEXTS[name], VIEWS)
    parts = [f"select '{p}' as period, * from ({sql.replace(START, a).replace(END, b)})" for p, (a, b) in PERIODS.items()]
    return " union all ".join(parts)


ORACLE = {name: with_prefix(sql, VIEWS) for name, sql in TEXTS.items()}
ORACLE |= {"dashboard_rollup": in_periods("dashboard_counts"), "aging_rollup": in_periods("exception_aging")}
# Another layout, the same rows.
ORACLE |= {f"{name}_laid_out": ORACLE[name] for name in ("ko_line_fact", "summ_default")}
