"""Stand-in tables derived from the driver's parquet files.

Each text below is one SELECT that both Spark SQL and DuckDB accept, so a query and the SQL that
checks it start from identical rows.  ``{table}`` is replaced by the parquet path (Spark) or the
view name (DuckDB).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BANDS = ("green", "red", "nir", "swir1", "swir2")

FIXTURES: dict[str, str] = {}

# Irregular satellite observations: one row per line item.
FIXTURES["obs"] = """
select l_partkey as pixel, l_shipdate as ts, cast(cast(l_shipdate as date) as string) as day,
  case when l_linestatus = 'O' then 'L30' else 'S30' end as sensor,
  l_tax * 0.5 + 0.02 as blue, l_discount + 0.03 as green, 0.02 + l_quantity / 200.0 as red,
  case when l_orderkey % 17 = 0 then null else 0.05 + l_extendedprice / 200000.0 end as nir,
  0.05 + (l_suppkey % 100) / 300e0 as swir1, 0.03 + l_linenumber / 40e0 as swir2,
  cast(case when l_orderkey % 5 = 0 then (l_orderkey * 7) % 64 else 0 end as int) as fmask,
  cast((l_orderkey * 5) % 256 as int) as qa, cast(l_suppkey % 2 as int) as radsat
from {lineitem}"""

# Annual layers: one row per pixel and year.
FIXTURES["annual"] = """
select l_partkey as pixel, cast(floor(l_partkey / 64) as bigint) as prow, l_partkey % 64 as pcol,
  cast(year(l_shipdate) as int) as yr,
  avg(0.05 + l_extendedprice / 200000.0) as nir, avg(0.02 + l_quantity / 200.0) as red,
  avg(0.05 + (l_suppkey % 100) / 300e0) as swir1, avg(0.03 + l_linenumber / 40e0) as swir2,
  cast(max(case when l_returnflag = 'R' and l_quantity >= 44 then 7
                when l_quantity <= 1 and l_tax >= 0.08 then 16
                when l_discount >= 0.1 then 12 else 11 end) as int) as change
from {lineitem} group by 1, 2, 3, 4"""

# Raster channels with repeated cells.
FIXTURES["px"] = """
select l_orderkey as cell, cast(floor(l_orderkey / 64) as bigint) as prow, l_orderkey % 64 as pcol,
  cast(floor(l_orderkey / 1024) as bigint) as patch_row, cast(floor((l_orderkey % 64) / 16) as bigint) as patch_col,
  l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax,
  l_discount > 0.01 as valid, cast(l_suppkey % 12 as int) as code, l_linenumber as line_no
from {lineitem}"""

# Static layers: one row per grid cell.
FIXTURES["static_px"] = """
select o_orderkey as cell, cast(floor(o_orderkey / 128) as bigint) as prow, o_orderkey % 128 as pcol,
  o_totalprice / 1000.0 as elevation, cast(o_custkey % 9 as int) as evt,
  case when o_custkey % 10 < 9 then 1 else 0 end as aoi, case when o_orderstatus = 'F' then 0 else 1 end as forest,
  cast(o_custkey % 23 as int) as ysfc, cast(year(o_orderdate) as int) as yr
from {orders}"""

# Vectors on a 25-column grid; 5x5 blocks in a checkerboard give test, val and train.
FIXTURES["emb"] = """
select vec_id as id, label as evt, embedding as z, cast(floor(vec_id / 25) as bigint) as prow, vec_id % 25 as pcol,
  cast(floor(vec_id / 125) as bigint) as brow, cast(floor((vec_id % 25) / 5) as bigint) as bcol,
  case when (floor(floor(vec_id / 125) / 2) + floor(floor((vec_id % 25) / 5) / 2)) % 2 = 0
        and (floor(vec_id / 125) + floor((vec_id % 25) / 5)) % 4 = 0 then 'test'
       when (floor(floor(vec_id / 125) / 2) + floor(floor((vec_id % 25) / 5) / 2)) % 2 = 0
        and (floor(vec_id / 125) + floor((vec_id % 25) / 5)) % 4 = 2 then 'val'
       else 'train' end as split
from {embeddings}"""

FIXTURES["response"] = """
select p_partkey as id, cast(p_size as double) as y, p_retailprice as y2 from {part}"""

FIXTURES["cond"] = """
select cast(l_orderkey as string) as plt_cn, l_linenumber as condid, l_quantity / 50.0 as condprop,
  case when l_returnflag = 'N' then null else l_extendedprice / 1000.0 end as balive,
  cast(l_partkey % 900 as int) as fortypcd, l_suppkey as owner
from {lineitem}"""

FIXTURES["tree"] = """
select cast(l_orderkey as string) as plt_cn, case when l_linestatus = 'O' then 1 else 2 end as statuscd,
  cast((l_suppkey * 7) % 900 as int) as spcd, l_quantity as tpa, l_extendedprice / 1000.0 as vol
from {lineitem}"""

FIXTURES["grm"] = """
select cast(l_orderkey as string) as plt_cn,
  case when l_returnflag = 'R' then l_discount * l_extendedprice end as remv,
  case when l_linestatus = 'F' then l_quantity end as tpa_remv
from {lineitem}"""

FIXTURES["plots"] = """
select cast(o_orderkey as string) as cn, n_regionkey as unitcd, n_nationkey as statecd,
  (c_acctbal + 999.0) / 110.0 as tcc, cast(year(o_orderdate) as int) as invyr,
  case when o_custkey % 3 = 0 then null else cast(o_custkey as string) end as prev_plt_cn
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey"""

# Confusion counts between two code axes, one table per order status.
FIXTURES["confusion"] = """
select o_orderstatus as tbl, s_nationkey as a, c_nationkey as b, cast(count(*) as double) as n
from {lineitem} join {supplier} on l_suppkey = s_suppkey join {orders} on l_orderkey = o_orderkey
  join {customer} on o_custkey = c_custkey
group by 1, 2, 3"""

# Plot table with area-weighted basal area; the frame most stratification queries use.
FIXTURES["frame"] = """
select p.cn, p.unitcd, p.tcc, p.invyr, b.balive, b.n_cond
from ({plots}) p join (
  select plt_cn, sum(coalesce(balive, 0) * condprop) / sum(condprop) as balive, count(*) as n_cond
  from ({cond}) group by plt_cn) b on p.cn = b.plt_cn
where p.tcc between 0 and 100"""

_SEG_BANDS = {"green": 0.30, "red": 0.25, "nir": 1.00, "swir1": 0.60, "swir2": 0.40}


def _seg_formulas(p: str = "") -> dict[str, dict[str, str]]:
    """SQL of each band's columns, over names with the prefix ``p``."""
    return {b: {
        f"{b}_c0": f"0.05 + {s} * {p}price / 100000.0", f"{b}_c1": f"({p}qty - 25.0) * {s} / 100000.0",
        f"{b}_cos": f"{p}disc * {s}", f"{b}_sin": f"{p}tax * {s}", f"{b}_rmse": f"(0.01 + {p}tax) * {s}",
        f"{b}_mag": f"({p}qty - 35.0) * {s} / 100.0"} for b, s in _SEG_BANDS.items()}


def _seg_break(p: str = "") -> str:
    return f"case when {p}seg_no < {p}n_seg then {p}t_end else 0.0 end"


_seg_cols = ",\n  ".join(", ".join(f"{e} as {n}" for n, e in cols.items()) for cols in _seg_formulas().values())
_seg_from = """
from (
  select pixel, row_number() over (partition by pixel order by t_start) as seg_no,
    count(*) over (partition by pixel) as n_seg, t_start, t_end, price, qty, disc, tax
  from (
    select pixel, t_start, lead(t_start) over (partition by pixel order by t_start) as t_end, price, qty, disc, tax
    from (
      select l_partkey as pixel,
        year(l_shipdate) + (dayofyear(l_shipdate) - 1) / 365.25e0 as t_start,
        max(l_extendedprice) as price, max(l_quantity) as qty, max(l_discount) as disc, max(l_tax) as tax
      from {lineitem} group by 1, 2) d) e
  where t_end is not null) f"""
# Segment history, one row per (pixel, seg_no): consecutive ship dates of a part.
FIXTURES["seg_rows"] = f"""
select pixel, seg_no, t_start, t_end, {_seg_break()} as t_break,
  {_seg_cols}{_seg_from}"""
# The same rows before the band columns, which are SEG_COLUMNS of such a row ``s``.
FIXTURES["seg_parts"] = "select f.*" + _seg_from
SEG_COLUMNS = {"t_break": _seg_break("s."), **{n: e for cols in _seg_formulas("s.").values() for n, e in cols.items()}}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _expand(text: str, table) -> str:
    def sub(m):
        name = m.group(1)
        return _expand(FIXTURES[name], table) if name in FIXTURES else table(name)

    return _PLACEHOLDER.sub(sub, text)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a Spark DataFrame."""
    return spark.sql(_expand(FIXTURES[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def seg_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``seg_parts``; one shuffle by pixel serves the dates, the windows and what is grouped by pixel after them."""
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return spark.sql(_expand(FIXTURES["seg_parts"], lambda t: "{lineitem}"), lineitem=items.repartition("l_partkey"))


def ctes(*names: str) -> str:
    """``with a as (...), b as (...)`` for DuckDB."""
    return "with " + ", ".join(f"{n} as ({_expand(FIXTURES[n], lambda t: t)})" for n in names) + " "
