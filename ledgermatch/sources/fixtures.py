"""Test ledger derived from the TPC-H-like star schema.

Every view is plain SQL that Spark and DuckDB both run. ``{name}`` stands for another view or
for a driver table: Spark gets DataFrames for the names, the oracle gets ``WITH`` parts.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.sources.ledger import TABLES, Ledger
from ledgermatch.sources.rounds import LedgerFolder, at_size

_RULE = """
select r.recon_code || '-R{n}' as rule_code, '{name}' as rule_name, cast({n} as decimal(9,2)) as rule_order,
  r.recon_code, 'T' as rule_apply_on, '{flag}' as group_flag, 'Y' as system_match_flag, 'N' as probable_match_flag,
  '{hold}' as hold_flag, cast({tol} as decimal(15,2)) as tolerance, '{partial}' as partial_flag, 'ref_no' as match_keys,
  'GL' as source_dataset_code, 'BNK' as comparison_dataset_code, 'Y' as active_status,
  date '1995-01-01' as period_from, date '2099-12-31' as period_to, 'N' as until_active_flag, 'N' as delete_flag
from {{recon_mst_trecon}} r"""

_RULES = [
    dict(n=1, name="Exact", flag="OTO", tol="0.00", hold="N", partial="N"),
    dict(n=2, name="Split", flag="OTM", tol="0.00", hold="N", partial="N"),
    dict(n=3, name="Tolerance", flag="OTO", tol="0.01", hold="N", partial="N"),
    dict(n=4, name="Partial", flag="OTO", tol="0.00", hold="N", partial="Y"),
    dict(n=5, name="On hold", flag="MTM", tol="0.00", hold="Y", partial="N"),
]

SQL = {
    "fx_base": """
select 'RC' || cast(n.n_regionkey as varchar(10)) as recon_code, cast(o.o_orderkey as bigint) as k,
  cast(o.o_orderdate as date) as d, cast(o.o_totalprice as decimal(15,2)) as v,
  case when o.o_orderkey % 10 = 0 then 'MISSING' when o.o_orderkey % 13 = 0 then 'PARTIAL'
       when o.o_orderkey % 11 = 0 then 'ROUNDOFF' when o.o_orderkey % 7 = 0 then 'SPLIT' else 'EXACT' end as kind,
  case when o.o_orderkey % 97 = 0 then 'Y' else 'N' end as delete_flag
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey""",
    "recon_mst_trecon": """
select 'RC' || cast(r_regionkey as varchar(10)) as recon_code, r_name as recon_name,
  case r_regionkey when 0 then 'W' when 1 then 'B' when 2 then 'I' when 3 then 'V' else 'N' end as recontype_code,
  'tran_date' as recon_date_field, 'Y' as recon_date_flag, 'v1' as recon_rule_version,
  date '1995-01-01' as period_from,
  case when r_regionkey = 4 then date '1996-12-31' else date '2099-12-31' end as period_to,
  case when r_regionkey = 4 then 'Y' else 'N' end as until_active_flag, 'Y' as active_status, 'N' as delete_flag
from {region}
union all select 'RCX', 'Inactive', 'B', 'tran_date', 'Y', 'v1', date '1995-01-01', date '2099-12-31', 'N', 'N', 'N'
union all select 'RCE', 'Expired', 'B', 'tran_date', 'Y', 'v1', date '1995-01-01', date '1996-12-31', 'N', 'Y', 'N'
union all select 'RCD', 'Deleted', 'B', 'tran_date', 'Y', 'v1', date '1995-01-01', date '2099-12-31', 'N', 'Y', 'Y'""",
    "recon_mst_tdataset": """
select 'GL' as dataset_code, 'General ledger' as dataset_name, 'N' as delete_flag
union all select 'BNK', 'Bank statement', 'N'
union all select 'OLD', 'Retired feed', 'Y'""",
    "recon_mst_trecondataset": """
select recon_code, 'GL' as dataset_code, 'Y' as active_status, 'N' as delete_flag from {recon_mst_trecon}
union all select recon_code, 'BNK', 'Y', 'N' from {recon_mst_trecon}
union all select recon_code, 'OLD', 'Y', 'N' from {recon_mst_trecon}""",
    "recon_mst_trule": "\nunion all".join(_RULE.format(**r) for r in _RULES),
    "recon_mst_taging": """
select 1 as aging_gid, '0-30' as aging_desc, 0 as aging_from, 30 as aging_to, 'N' as delete_flag
union all select 2, '31-90', 31, 90, 'N'
union all select 3, '91-365', 91, 365, 'N'
union all select 4, '366+', 366, 99999, 'N'
union all select 5, 'deleted', 0, 99999, 'Y'""",
    "admin_mst_treconcontext": """
select recon_code, 'M' || substring(recon_code, 3, 1) as master_syscode, 'P1' as parent_master_syscode, 'N' as delete_flag
from {recon_mst_trecon}
union all select 'RC0', 'M1', 'P1', 'N'""",
    "admin_mst_tusercontext": """
select 'U1' as user_code, 'M0' as master_syscode, 'P1' as parent_master_syscode, 'Y' as active_status, 'N' as delete_flag
union all select 'U1', 'M1', 'P1', 'Y', 'N'
union all select 'U1', 'M2', 'P9', 'Y', 'N'
union all select 'U1', 'MX', 'P1', 'Y', 'N'
union all select 'U2', 'M3', 'P1', 'Y', 'N'
union all select 'U2', 'M4', 'P1', 'N', 'N'""",
    "recon_trn_tscheduler": """
select distinct cast(year(d) * 10000 + month(d) * 100 + day(d) as bigint) as scheduler_gid,
  cast(d + interval 30 day as timestamp) as insert_date
from {fx_base}""",
    "fx_tran": """
select recon_code, k, kind, 4*k as tran_gid, 'GL' as dataset_code, d as tran_date, 'D' as tran_acc_mode, -1 as tran_mult,
  v as tran_value,
  case kind when 'MISSING' then v when 'PARTIAL' then cast(v - cast(v*0.6 as decimal(15,2)) as decimal(15,2))
            when 'ROUNDOFF' then cast(0.01 as decimal(15,2)) else cast(0 as decimal(15,2)) end as excp_value,
  case kind when 'ROUNDOFF' then cast(-0.01 as decimal(15,2)) else cast(0 as decimal(15,2)) end as roundoff_value,
  cast(year(d) * 10000 + month(d) * 100 + day(d) as bigint) as scheduler_gid, 'OLD' as theme_code, delete_flag
from {fx_base}
union all
select recon_code, k, kind, 4*k+1, 'BNK', d, 'C', 1,
  case kind when 'PARTIAL' then cast(v*0.6 as decimal(15,2)) when 'ROUNDOFF' then cast(v-0.01 as decimal(15,2))
            when 'SPLIT' then cast(v*0.5 as decimal(15,2)) else v end,
  cast(0 as decimal(15,2)), cast(0 as decimal(15,2)),
  cast(year(d) * 10000 + month(d) * 100 + day(d) as bigint), 'OLD', delete_flag
from {fx_base} where kind <> 'MISSING'
union all
select recon_code, k, kind, 4*k+2, 'BNK', d, 'C', 1, cast(v - cast(v*0.5 as decimal(15,2)) as decimal(15,2)),
  cast(0 as decimal(15,2)), cast(0 as decimal(15,2)),
  cast(year(d) * 10000 + month(d) * 100 + day(d) as bigint), 'OLD', delete_flag
from {fx_base} where kind = 'SPLIT'""",
    "recon_trn_ttran": "select * from {fx_tran} where excp_value <> 0",
    "recon_trn_ttranko": "select * from {fx_tran} where excp_value = 0",
    "recon_trn_tko": """
select 2*k as ko_gid, recon_code, d as ko_date, case when k % 17 = 0 then 'Y' else 'N' end as manual_matchoff,
  case when k % 17 = 0 then null
       else recon_code || '-R' || case kind when 'EXACT' then '1' when 'SPLIT' then '2' when 'ROUNDOFF' then '3' else '4' end
  end as rule_code,
  cast(1 as bigint) as job_gid, delete_flag
from {fx_base} where kind <> 'MISSING'
union all
select 2*k + 1, recon_code, d, 'Y', null, cast(1 as bigint), delete_flag
from {fx_base} where kind = 'PARTIAL' and k % 3 = 0""",
    "recon_trn_tkodtl": """
select 2*t.tran_gid as kodtl_gid, 2*t.k as ko_gid, t.tran_gid, t.tran_mult as ko_mult,
  case when t.kind = 'PARTIAL' and t.k % 3 = 0 then cast(b.v*0.4 as decimal(15,2))
       else cast(t.tran_value - t.excp_value as decimal(15,2)) end as ko_value, t.delete_flag
from {fx_tran} t join {fx_base} b on t.k = b.k where t.kind <> 'MISSING'
union all
select 2*t.tran_gid + 1, 2*t.k + 1, t.tran_gid, t.tran_mult,
  cast(cast(b.v*0.6 as decimal(15,2)) - cast(b.v*0.4 as decimal(15,2)) as decimal(15,2)), t.delete_flag
from {fx_tran} t join {fx_base} b on t.k = b.k where t.kind = 'PARTIAL' and t.k % 3 = 0""",
    "recon_trn_ttranbrkp": """
select 2*tran_gid as tranbrkp_gid, tran_gid, recon_code, dataset_code, 'GLB' as tranbrkp_dataset_code,
  cast(tran_value*0.5 as decimal(15,2)) as excp_value, tran_date, tran_acc_mode, theme_code, delete_flag
from {recon_trn_ttran} where kind = 'MISSING' and k % 20 = 0
union all
select 2*tran_gid+1, tran_gid, recon_code, dataset_code, 'GLB',
  cast(tran_value - cast(tran_value*0.5 as decimal(15,2)) as decimal(15,2)), tran_date, tran_acc_mode, theme_code, delete_flag
from {recon_trn_ttran} where kind = 'MISSING' and k % 20 = 0""",
    # State before matching: it hides `kind`, so the matcher cannot see the answer.
    "fx_feed": """
select tran_gid, recon_code, dataset_code, 'REF' || cast(k as varchar(12)) as ref_no, tran_date, tran_acc_mode, tran_mult,
  tran_value, tran_value as excp_value, cast(0 as decimal(15,2)) as roundoff_value
from {fx_tran} where delete_flag = 'N'""",
    # Order lines against subtotals per return flag; every tenth order lacks one subtotal.
    "fx_line": """
select l_orderkey * 1000 + 2 * row_number() over (partition by l_orderkey
         order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag) as tran_gid,
  l_orderkey, l_returnflag, cast(l_extendedprice as decimal(15,2)) as tran_value
from {lineitem}""",
    "fx_mtm_feed": """
select l.tran_gid, b.recon_code, 'GL' as dataset_code, 'REF' || cast(l.l_orderkey as varchar(12)) as ref_no,
  b.d as tran_date, 'D' as tran_acc_mode, -1 as tran_mult, l.tran_value, l.tran_value as excp_value,
  cast(0 as decimal(15,2)) as roundoff_value, 4 * l.l_orderkey as parent_gid
from {fx_line} l join {fx_base} b on l.l_orderkey = b.k
union all
select s.tran_gid, b.recon_code, 'BNK', 'REF' || cast(s.l_orderkey as varchar(12)), b.d, 'C', 1, s.tran_value, s.tran_value,
  cast(0 as decimal(15,2)), 4 * s.l_orderkey + 1
from (select l_orderkey, min(tran_gid) + 1 as tran_gid, cast(sum(tran_value) as decimal(15,2)) as tran_value
      from {fx_line} where not (l_orderkey % 10 = 0 and l_returnflag = 'A')
      group by l_orderkey, l_returnflag) s join {fx_base} b on s.l_orderkey = b.k""",
    # Trans that own the rows of the feed above as breakups.
    "fx_parent": """
select parent_gid as tran_gid, recon_code, dataset_code, ref_no, tran_date, tran_acc_mode, tran_mult,
  cast(sum(tran_value) as decimal(15,2)) as tran_value, cast(sum(tran_value) as decimal(15,2)) as excp_value,
  cast(0 as decimal(15,2)) as roundoff_value
from {fx_mtm_feed} group by parent_gid, recon_code, dataset_code, ref_no, tran_date, tran_acc_mode, tran_mult""",
    # The ledger before a run, and values in steps of a cent on alternating sides.
    "fx_open": """
select recon_code, k, kind, tran_gid, 'REF' || cast(k as varchar(12)) as ref_no, dataset_code, tran_date, tran_acc_mode, tran_mult,
  tran_value, tran_value as excp_value, cast(0 as decimal(15,2)) as roundoff_value, scheduler_gid, theme_code, delete_flag
from {fx_tran}""",
    "fx_chain": """
select 10*k as tran_gid, recon_code, case when place % 2 = 1 then 'GL' else 'BNK' end as dataset_code,
  'CH' || cast(n - place as varchar(12)) as ref_no, d as tran_date, case when place % 2 = 1 then 'D' else 'C' end as tran_acc_mode,
  case when place % 2 = 1 then -1 else 1 end as tran_mult, cast(1 + place * 0.01 as decimal(15,2)) as tran_value,
  cast(1 + place * 0.01 as decimal(15,2)) as excp_value, cast(0 as decimal(15,2)) as roundoff_value, place
from (select b.*, 1 + (n - 1) % 12 as place from (select x.*, row_number() over (partition by recon_code order by k) as n from {fx_base} x) b) c""",
    "fx_messy": """
select tran_gid, case tran_gid % 3 when 0 then '  ' || lower(ref_no) || ' ' when 1 then '000' || ref_no else ref_no end as ref_no
from {fx_feed}""",
}

# Two keys for all complete orders of a recon, and the same with a single row on one side.
SQL["fx_hot"] = """
select tran_gid, recon_code, dataset_code, 'HOT' || cast(cast(floor(parent_gid / 4) as bigint) % 2 as varchar(1)) as ref_no, tran_date,
  tran_acc_mode, tran_mult, tran_value, excp_value, roundoff_value
from {fx_mtm_feed} where cast(floor(parent_gid / 4) as bigint) % 10 <> 0"""
SQL["fx_hot_one"] = """
select * from {fx_hot} where dataset_code = 'GL'
union all
select min(tran_gid), recon_code, dataset_code, ref_no, min(tran_date), 'C', 1, cast(sum(tran_value) as decimal(15,2)),
  cast(sum(excp_value) as decimal(15,2)), cast(0 as decimal(15,2))
from {fx_hot} where dataset_code = 'BNK' group by recon_code, dataset_code, ref_no"""
# Chains of a hundred levels and more, and chains whose length depends on the recon.
SQL["fx_long_chain"] = SQL["fx_chain"].replace("% 12 as place", "% 120 as place")
SQL["fx_recon_chain"] = SQL["fx_chain"].replace("% 12 as place", "% (2 + 2 * cast(substring(recon_code, 3, 1) as int)) as place")

GROWING = (
    "recon_trn_ttran",
    "recon_trn_ttranko",
    "recon_trn_tko",
    "recon_trn_tkodtl",
    "recon_trn_ttranbrkp",
    "recon_trn_tscheduler",
    "fx_feed",
    "fx_mtm_feed",
)

#: Feeds derived with joins, sorts or sums, which matching reads more than once: written for each set of views.
WRITTEN = ("fx_feed", "fx_open", "fx_mtm_feed", "fx_parent", "fx_hot_one", "fx_chain", "fx_long_chain", "fx_recon_chain")

#: Views as large as the orders or lines, which joins must not send to all tasks.
MERGED = ("fx_base", "fx_line", "fx_tran")

DRIVER_TABLES = ("region", "nation", "customer", "orders", "lineitem")

# Views that an oracle reads more than once and that cost a sort or a join.
MATERIALIZED = ("fx_mtm_feed", "ranked", "pairs", "lone", "nearest", "owned_left", "hot_ranked", "hot_levels")

_NAME = re.compile(r"\{(\w+)\}")


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def with_prefix(sql: str, views: dict[str, str] | None = None) -> str:
    """Oracle text: ``sql`` with the views it needs in front of it; ``views`` adds some."""
    known = {**SQL, **(views or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(sql)
    kept = {name: " materialized" if name in MATERIALIZED else "" for name in order}
    parts = [f"{name} as{kept[name]} ({_NAME.sub(r'\1', known[name])})" for name in order]
    body = _NAME.sub(r"\1", sql)
    return f"with {', '.join(parts)} {body}" if parts else body


class Fixtures:
    """Fixture views of one data folder as lazy DataFrames.

    Views are derived anew in every query unless :meth:`store` has written them out before.
    """

    stored: dict[str, str] = {}

    @classmethod
    def store(cls, spark: SparkSession, sf_dir: str, folder: str) -> None:
        """Write the growing tables and feeds of ``sf_dir`` below ``folder`` and use them from now on."""
        views = cls(spark, sf_dir)
        for name in GROWING:
            views[name].write.mode("errorifexists").parquet(f"{folder}/{name}")
        cls.stored[sf_dir] = folder

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}
        self._folder = LedgerFolder(spark)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in GROWING and self.sf_dir in self.stored:
                df = self.spark.read.parquet(f"{self.stored[self.sf_dir]}/{name}")
            elif name in DRIVER_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = SQL[name]
                frames = {n: self[n] for n in names_in(sql)}
                df = self.spark.sql(sql, **{n: at_size(f) if n in MERGED else f for n, f in frames.items()})
                if name in WRITTEN:
                    df = self._folder.table(df, name)
            self._frames[name] = df
        return self._frames[name]

    @cached_property
    def ledger(self) -> Ledger:
        return Ledger.from_frames({name: self[name] for name in TABLES.values()})
