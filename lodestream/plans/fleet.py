"""Fleet joins and control-plane rules over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import cdc, documents, eventlog, fleet
from lodestream.plans.registry import query, read, relational

relational(
    "dedupe_probe_present",
    "select o_orderkey from {orders} where exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_returnflag = 'R')",
)
relational(
    "dedupe_probe_needed",
    "select o_orderkey from {orders} where not exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_returnflag = 'R')",
)
relational(
    "upload_validation",
    """select l_orderkey, l_linenumber, case when l_quantity <= 0 then 'size' when n > 1 then 'duplicate' when l_linenumber > 6 then 'too_many' when total > 250 then 'batch_bytes' else 'ok' end as reason from (
         select l_orderkey, l_linenumber, l_quantity, count(*) over (partition by l_orderkey, l_linenumber) as n,
           sum(l_quantity) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and current row) as total from {lineitem})""",
)


@query(
    """with a as (select c_custkey, lower(c_mktsegment) || '-' || (c_custkey % 40) as host from customer),
            b as (select s_suppkey, case when s_suppkey % 2 = 0 then 'BUILDING-' else 'machinery-' end || s_suppkey || '.corp.example' as fqdn from supplier),
            bk as (select s_suppkey, lower(split_part(fqdn, '.', 1)) as host from b),
            an as (select *, count(*) over (partition by host) as na from a), bn as (select *, count(*) over (partition by host) as nb from bk)
       select c_custkey, case when nb is null then 'unmatched' when na > 1 or nb > 1 then 'ambiguous' else 'matched' end as status,
         case when na = 1 and nb = 1 then s_suppkey end as import_id
       from an left join bn using (host)"""
)
def metadata_import_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows matched to installs by the first label of the host name, unless either side has several."""
    installs = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_custkey") % 40).alias("host"))
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "BUILDING-").otherwise("machinery-"), "s_suppkey", F.lit(".corp.example"))
    return fleet.match_hosts(installs, "c_custkey", read(spark, sf_dir, "supplier").select("s_suppkey", name.alias("host")), "s_suppkey")


@query(
    """with pairs as (select distinct o_custkey as install, l_suppkey as source_id from orders join lineitem on l_orderkey = o_orderkey)
       select source_id, count(*) as installs from pairs join customer on c_custkey = install where c_acctbal >= 0 group by source_id"""
)
def fleet_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active installs that report each source."""
    reports = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("install"), F.col("l_suppkey").alias("source_id"))
    active = read(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("install"))
    return fleet.catalog_counts(reports, active)


relational(
    "install_overview",
    """select c.c_custkey, o.last_seen, case when o.last_seen is null then null else datediff(date '1998-12-31', o.last_seen) end as silent_days
       from {customer} c left join (select o_custkey, cast(max(o_orderdate) as date) as last_seen from {orders} group by o_custkey) o on o.o_custkey = c.c_custkey""",
    """select c.c_custkey, o.last_seen, case when o.last_seen is null then null else cast(date '1998-12-31' - o.last_seen as int) end as silent_days
       from {customer} c left join (select o_custkey, cast(max(o_orderdate) as date) as last_seen from {orders} group by o_custkey) o on o.o_custkey = c.c_custkey""",
)
_LAYERS = """select n_regionkey as layer, 'f' || cast(n_nationkey % 4 as varchar) as field, n_name as value, n_nationkey from nation"""


@query(
    f"""select field, arg_max(value, layer * 1000 + n_nationkey) as value, max(layer) as origin, array_to_string(list_sort(list(distinct value)), ',') as all_values from ({_LAYERS}) group by field"""
)
def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of ordered layers: the last writer wins, with its layer as origin, and the union of all values."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("layer"), F.concat(F.lit("f"), (F.col("n_nationkey") % 4).cast("string")).alias("field"), F.col("n_name").alias("value"), "n_nationkey")
    return fleet.merge_layers(rows, "field", "value", "layer", "n_nationkey")


@query(
    """select n_nationkey, case when n_nationkey % 3 = 0 then 'name=' || n_name else 'name=' || n_name || ',tier=' || n_regionkey end as metadata from nation"""
)
def metadata_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch over a map; a null value deletes the key."""
    old = F.create_map(F.lit("name"), F.lit("?"), F.lit("tier"), F.col("n_regionkey").cast("string"))
    patch = F.create_map(F.lit("name"), F.col("n_name"), F.lit("tier"), F.when(F.col("n_nationkey") % 3 == 0, None).otherwise(F.col("n_regionkey").cast("string")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(fleet.patched(old, patch))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return read(spark, sf_dir, "nation").select("n_nationkey", shown.alias("metadata"))


relational(
    "repo_survey",
    """select user_id, cast(sum(value * 100) as bigint) as bytes, count(*) as files, count(case when event_type = 'error' then 1 end) as pending, max(cast(ts as date)) as last_day,
       min(case when event_type <> 'view' then 1 else 0 end) = 1 as all_marked from {events} group by user_id""",
    """select user_id, cast(floor(sum(value * 100)) as bigint) as bytes, count(*) as files, count(case when event_type = 'error' then 1 end) as pending, max(cast(ts as date)) as last_day,
       min(case when event_type <> 'view' then 1 else 0 end) = 1 as all_marked from {events} group by user_id""",
)


@query()
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches of at most 5 objects and a price of 400,000 for each customer's orders; tested against a plain loop."""
    return fleet.batches(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 5, 400_000.0)
relational(
    "install_lifecycle",
    """select user_id, case when count(case when event_type = 'error' then 1 end) >= 20 then 'revoked' when count(case when event_type = 'signup' then 1 end) > 0 then 'active' else 'pending' end as status,
       min(case when event_type = 'signup' then ts end) as since from {events} group by user_id""",
)


@query(
    """with recursive e as (select distinct user_id, ts from events where ts is not null),
       k as (select user_id, min(ts) as ts from e group by user_id
             union all select k.user_id, min(e.ts) as ts from k join e on e.user_id is not distinct from k.user_id and e.ts >= k.ts + interval 1 minute group by k.user_id, k.ts)
       select user_id, ts from k"""
)
def last_seen_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps that are written at most once a minute for each user, counted from the last one written."""
    return eventlog.throttled(read(spark, sf_dir, "events"), 60)


relational(
    "telemetry_admission",
    """select event_type, count(case when ts between timestamp '2024-01-15 00:00:00' - interval 5 minutes and timestamp '2024-01-15 00:00:00' + interval 1 day then 1 end) as admitted, count(*) as seen
       from {events} group by event_type""",
)
relational(
    "organizations_with_config",
    """select distinct r_name from {region} where r_regionkey in (select n_regionkey from {nation})""",
)


@query("select o_orderkey, case when o_orderkey % 11 = 0 then 'missing' when o_orderkey % 7 = 0 then 'duplicate' else 'paired' end as status from orders")
def ticket_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload tickets paired with their objects by id."""
    objects = read(spark, sf_dir, "orders").select("o_orderkey")
    tickets = objects.filter("o_orderkey % 11 <> 0")
    return fleet.paired(objects, tickets.unionByName(tickets.filter("o_orderkey % 7 = 0")), "o_orderkey")


@query("select p_partkey, case when p_partkey % 4 = 0 then 'left out: not in this build' else 'served' end as note from part")
def served_collection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection's rows that a build knows, and a note for the rest."""
    part = read(spark, sf_dir, "part")
    return fleet.served(part, part.filter("p_partkey % 4 <> 0"), "p_partkey")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'b' || c_custkey when c_custkey % 3 = 1 then 'a' || c_custkey end as author from customer")
def authorship_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote a configuration, by the hash of its bytes."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("{cfg: "), "c_custkey", F.lit("}")).alias("text"))
    entry = lambda who, at, keep: customers.filter(keep).select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit(who), "c_custkey").alias("author"), F.lit(at).alias("at"))
    return fleet.authors(customers, entry("a", 1, "c_custkey % 3 < 2").unionByName(entry("b", 2, "c_custkey % 3 = 0")), "c_custkey", "text")


@query(
    """select n_regionkey, case when bool_or(c_custkey % 90 = 0) then 'failure' when bool_or(c_custkey % 9 = 0) then 'warning' when bool_or(c_custkey % 2 = 0) then 'info' else 'ok' end as severity, count(*) as rows
       from customer join nation on n_nationkey = c_nationkey group by n_regionkey"""
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst finding of each region; one of an unknown kind is a failure."""
    kind = "case when c_custkey % 90 = 0 then 'odd' when c_custkey % 9 = 0 then 'warning' when c_custkey % 2 = 0 then 'info' else 'ok' end"
    findings = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).selectExpr("n_regionkey", f"{kind} as severity")
    return fleet.worst(findings, "n_regionkey")


@query("select source, count(case when doc_id % 4 in (1, 3) then 1 end) as outstanding from documents group by source")
def resend_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files sent under another policy than the one in force."""
    state = read(spark, sf_dir, "documents").selectExpr("source", "if(doc_id % 4 = 0, '', 'h') as hash", "case doc_id % 4 when 1 then 'old' when 2 then 'now' end as policy")
    return cdc.resend_outstanding(state, "source", "now")


@query("select n_nationkey, case n_nationkey % 3 when 0 then 'a,b' when 1 then 'b,x,a' else 'z,a,b' end as recipients, n_nationkey % 3 <> 0 as changed from nation")
def recipient_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients that a sealed object lacks are added; one that has all of them stays."""
    k = F.col("n_nationkey") % 3
    own = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("b"), F.lit("x"))).otherwise(F.array(F.lit("z")))
    out = read(spark, sf_dir, "nation").select("n_nationkey", documents.resealed(own, F.array(F.lit("a"), F.lit("b"))).alias("x"))
    return out.select("n_nationkey", F.array_join("x.recipients", ",").alias("recipients"), "x.changed")
