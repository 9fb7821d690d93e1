"""Spark's own relational operators over the given tables (extensions)."""

from __future__ import annotations

from lodestream.plans.registry import relational

relational(
    "pricing_summary",
    """select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
       from {lineitem} where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus""",
)
relational(
    "revenue_by_nation",
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey
       join {nation} on n_nationkey = c_nationkey group by n_name""",
)
relational("rollup_sources", "select lang, source, count(*) as n from {documents} group by rollup (lang, source)")
relational("grouping_sets_orders", "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
relational("full_outer_labels", "select coalesce(d.doc_id, l.doc_id) as doc_id, d.source, l.quality from {documents} d full outer join {labels} l on l.doc_id = d.doc_id")
relational("intersect_keys", "select l_suppkey as k from {lineitem} intersect select s_suppkey as k from {supplier}")
relational("top_customers", "select c_custkey, total from (select o_custkey as c_custkey, round(sum(o_totalprice), 2) as total from {orders} group by o_custkey) order by total desc, c_custkey limit 20")
