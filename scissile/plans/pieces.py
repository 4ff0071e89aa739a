"""Queries over pieces of molecules: orders as straight chains, cut again and again and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decomposition
from ..operators.classes import Classes, classes
from ..operators.molecules import Molecules, molecules
from ..tables import stored, table
from .structures import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]

#: An order as a row of atoms. A bond between carbon and another element is cut where the carbon has a carbon on its other side, and the
#: other atom is inside the row; nitrogen must not have nitrogen or oxygen on its other side. A segment between cuts has the labels of its ends.
_SEGMENTS = """
line as (select l_orderkey as t, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k, case l_partkey % 8 when 5 then 'N' when 6 then 'O' when 7 then 'S' else 'C' end as x from lineitem),
row_ as (select t, count(*) as n, string_agg(x, '' order by k) as s from line group by t),
bond as (select t, n, s, k, s[k] as a, s[k + 1] as b, case when k > 1 then s[k - 1] else '' end as p, case when k + 2 <= n then s[k + 2] else '' end as q from (select *, unnest(range(1, n)) as k from row_)),
cut as (select t, k from bond where (a = 'C' and p = 'C' and b <> 'C' and q <> '' and not (b = 'N' and q in ('N', 'O'))) or (b = 'C' and q = 'C' and a <> 'C' and p <> '' and not (a = 'N' and p in ('N', 'O')))),
edge as (select t, 0 as k from row_ union all select t, n from row_ union all select t, k from cut),
side as (select t, k, s, n, lead(k) over (partition by t order by k) as next from edge join row_ using (t)),
label as (select unnest(['C', 'O', 'N', 'S']) as x, unnest(['4', '3', '5', '11']) as number),
segment as (select e.t, e.s[e.k + 1:f.k] as body, case when e.k = 0 then '' else (select number from label where x = e.s[e.k + 1]) end as l, case when f.k = f.n then '' else (select number from label where x = f.s[f.k]) end as r, f.k = e.next as leaf
            from side e join side f on f.t = e.t and f.k > e.k),
piece as (select t, leaf, body, l, r, least(l || ':' || body || ':' || r, r || ':' || reverse(body) || ':' || l) as form from segment)"""


def rows_of_atoms(spark: SparkSession, sf_dir: str) -> tuple[Classes, Molecules]:
    """Orders as straight chains of atoms, a line each: those of the same text, and the molecule of the first one."""
    order = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    part = F.col("l_partkey") % 8
    symbol = F.when(part == 5, "N").when(part == 6, "O").when(part == 7, "S").otherwise("C")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("k"), symbol.alias("x"))
    texts = lines.groupBy(F.col("l_orderkey").alias("target_id")).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("x"))
    same = classes(texts.select("target_id", F.array_join("x.x", "").alias("form")))
    return same, molecules(same.firsts.select("target_id", F.col("form").alias("smiles")))


@query("with " + _SEGMENTS + """,
held as (select form, count(distinct t) as targets from piece where leaf group by form)
select t as target_id, count(distinct form) as n_pieces, count(distinct form) filter (leaf) as n_leaves, count(distinct form) filter (leaf and targets > 1) as n_common from piece left join held using (form) group by t""")
def recursive_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces an order can be cut into, how many of them cannot be cut further, and how many of these other orders have as well."""
    same, mols = rows_of_atoms(spark, sf_dir)
    graph = decomposition.cut_graph(mols)
    leaves = stored(decomposition.reached(graph), "leaves")
    common = leaves.join(same.firsts.select("target_id", "n_same"), "target_id").groupBy("key").agg((F.sum("n_same") > 1).alias("common"))
    ends = leaves.join(common, "key").groupBy("target_id").agg(F.count("*").alias("n_leaves"), F.count_if("common").alias("n_common"))
    every = decomposition.reached(graph, keep_nodes=True).groupBy("target_id").agg(F.count("*").alias("n_pieces"))
    return same.of_all(stored(every.join(ends, "target_id").select("target_id", "n_pieces", "n_leaves", "n_common"), "pieces-of-first"))


@query("with " + _SEGMENTS + """,
way as (select distinct t, l, body, r from piece where leaf union select distinct t, r, reverse(body), l from piece where leaf),
fit as (select unnest(['3', '4', '4', '4', '5', '11']) as x, unnest(['4', '3', '5', '11', '4', '4']) as y),
one as (select distinct a.t, a.l, a.body || b.body as body, b.r from way a join fit on a.r = x join way b on b.t = a.t and b.l = y),
form1 as (select distinct t, least(l || ':' || body || ':' || r, r || ':' || reverse(body) || ':' || l) as form, l = '' and r = '' as complete from one),
turned as (select t, l, body, r from one union select t, r, reverse(body), l from one),
two as (select distinct a.t, a.l, a.body || b.body as body, b.r from turned a join fit on a.r = x join way b on b.t = a.t and b.l = y),
form2 as (select distinct t, least(l || ':' || body || ':' || r, r || ':' || reverse(body) || ':' || l) as form, l = '' and r = '' as complete from two anti join form1 f
          on f.t = two.t and f.form = least(l || ':' || body || ':' || r, r || ':' || reverse(body) || ':' || l)),
every_ as (select *, 0 as depth from form1 union all select *, 1 from form2)
select t as target_id, depth as depth, complete, count(*) as n from every_ group by all""")
def recombined_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's smallest pieces can be put together to in one or two joins: how many results are complete, and how many can go on."""
    same, mols = rows_of_atoms(spark, sf_dir)
    pieces = stored(decomposition.decompose(mols), "leaves")
    made = decomposition.recombine(pieces, max_depth=1, only_complete=False)
    return same.of_all(stored(made.groupBy("target_id", "depth", "complete").agg(F.count("*").alias("n")), "made-of-first"))
