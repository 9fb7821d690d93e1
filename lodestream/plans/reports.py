"""Queries of reports over the sales, event and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import reports
from lodestream.plans.registry import query, read


@query(
    """with o as (select doc_id, lang || '/' || doc_id % 400 as key, sha256(coalesce(text, '')) as source, sha256(coalesce(text, '') || source) as shipped, doc_id % 9 <> 0 as mirror from documents),
            s as (select key, source, case when doc_id % 5 = 0 then '' else shipped end as shipped from o where doc_id % 2 = 0)
       select doc_id as object_id, mirror and exists (select 1 from s where s.key = o.key and s.source = o.source and s.shipped = o.shipped and s.shipped <> '') as settled from o"""
)
def settled_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents offered to a store that holds every other one, some without a shipped hash: which needn't be sent."""
    text = F.coalesce("text", F.lit(""))
    offered = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.concat_ws("/", "lang", (F.col("doc_id") % 400).cast("string")).alias("key"), F.sha2(text, 256).alias("source_hash"), F.sha2(F.concat(text, "source"), 256).alias("shipped_hash"), (F.col("doc_id") % 9 != 0).alias("mirror"))
    stored = offered.filter("object_id % 2 = 0").select("key", "source_hash", F.when(F.col("object_id") % 5 != 0, F.col("shipped_hash")).otherwise("").alias("shipped_hash"))
    return reports.stored_already(offered, stored).select("object_id", "settled")


_SUPPORT = """with i as (select c_custkey, c_acctbal > 0 as active, 'd' || c_nationkey as digest from customer),
            s as (select i.*, max(o_orderdate) as at from i left join orders on o_custkey = c_custkey group by all),
            r as (select s.* from s join nation n on s.digest = 'd' || n.n_nationkey and n.n_regionkey <> 3 where s.active and s.at is not null),
            c as (select 'd' || n_nationkey as digest, unnest(['region' || n_regionkey, 'nation' || n_nationkey % 7, 'all']) as source from nation),
            a as (select distinct source from c union select 'none'),
            t as (select (select count(*) from r) as reporting, (select count(*) from i where active) as active),
            n as (select a.source, count(r.c_custkey) as n from a left join (select distinct digest, source from c) c on c.source = a.source left join r on r.digest = c.digest group by a.source),
            x as (select source, n as supported, reporting - n as unsupported, active - reporting as unknown, n > 0 as known from n, t)"""


@query(
    _SUPPORT
    + """ select source, supported::bigint as supported, unsupported::bigint as unsupported, unknown::bigint as unknown,
         case when known then supported || case when supported = 1 then ' install reports' else ' installs report' end || ' it can collect this source' else 'Not reported by any install' end
         || case when known and unsupported > 0 then ' · ' || unsupported || case when unsupported = 1 then ' reports' else ' report' end || ' it cannot' else '' end
         || case when unknown > 0 then ' · ' || unknown || case when unknown = 1 then ' install has' else ' installs have' end || ' not reported what it can collect' else '' end as text from x"""
)
def source_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as installs, nations as catalogs by digest: how many installs can collect each source, can't, and haven't said."""
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    digest = lambda c: F.format_string("d%d", c)
    installs = customer.select(F.col("c_custkey").alias("install_id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("revoked").alias("status"))
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    seen = customer.join(last, customer["c_custkey"] == last["o_custkey"], "left").select(F.col("c_custkey").alias("install_id"), digest("c_nationkey").alias("digest"), "at")
    catalogs = nation.select(digest("n_nationkey").alias("digest"), (F.col("n_regionkey") != 3).alias("usable"))
    entries = nation.select(digest("n_nationkey").alias("digest"), F.explode(F.array(F.format_string("region%d", "n_regionkey"), F.format_string("nation%d", F.col("n_nationkey") % 7), F.lit("all"))).alias("source"))
    asked = entries.select("source").unionByName(spark.range(1).select(F.lit("none").alias("source")))
    return reports.support(installs, seen, catalogs, entries, asked)


@query(
    """with f as (select user_id, event_id, event_type as kind, row_number() over (partition by user_id order by event_id desc) as rn from events where user_id is not null and value > 20),
            u as (select user_id, count(*) as n from events where user_id is not null group by user_id),
            k as (select user_id, string_agg(event_id || '=' || kind, ',' order by event_id) as faults from f where rn <= 20 group by user_id)
       select u.user_id as install_id, case when u.user_id % 10 = 0 then 'refused: no such active install' else 'stored' end as status, case when u.user_id % 10 <> 0 then u.n end as consecutive,
         case when u.user_id % 10 <> 0 then coalesce(k.faults, '') end as faults from u left join k using (user_id)"""
)
def health_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as installs that report their events as faults: what is kept of each report, and which are refused."""
    events = read(spark, sf_dir, "events").filter("user_id is not null").withColumn("install_id", F.col("user_id"))
    sent = events.groupBy("install_id").agg(F.count("*").alias("consecutive"))
    faults = events.filter("value > 20").select("install_id", F.col("event_id").alias("place"), F.concat(F.lit(" "), "event_type").alias("kind"), F.col("ts").cast("string").alias("at"), F.lit(None).cast("string").alias("message"))
    installs = sent.select("install_id", F.when(F.col("install_id") % 10 != 0, "active").otherwise("revoked").alias("status"))
    kept = reports.health(sent, faults, installs, F.lit("2024-02-01").cast("timestamp"))
    text = F.array_join(F.transform("faults", lambda f: F.concat(f["place"].cast("string"), F.lit("="), f["kind"])), ",")
    return kept.select("install_id", "status", "consecutive", text.alias("faults"))


@query(
    """with p as (select o_custkey as host, o_orderpriority as family, o_orderkey % 3 as s, count(*) as pending from orders group by all),
            h as (select c_custkey as host, c_nationkey as n from customer where c_custkey % 6 not in (0, 1)),
            j as (select p.*, h.host is not null as there, h.host is not null and p.s < 2 as recorded, h.n from p left join h using (host))
       select host, family, bool_or(recorded) as recorded, case when bool_or(there) then timestamp '2024-01-05 00:00:00' end as at, sum(case when recorded then n + s else 0 end)::bigint as shipped, sum(case when recorded then s else 0 end)::bigint as failed, sum(pending)::bigint as pending
       from j group by host, family"""
)
def last_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hosts whose heartbeats speak of two of three sources: each family's last upload, and what it still has."""
    probes = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("host"), F.col("o_orderpriority").alias("family"), F.format_string("s%d", F.col("o_orderkey") % 3).alias("source_id")).agg(F.count("*").alias("pending"))
    entry = lambda k: F.struct(F.lit(f"s{k}").alias("source_id"), (F.col("c_nationkey") + k).alias("shipped"), F.lit(k).alias("failed"))
    whole = F.to_json(F.struct(F.lit("2024-01-05T00:00:00Z").alias("at"), F.array(entry(0), entry(1)).alias("sources")))
    document = F.when(F.col("c_custkey") % 6 == 1, F.left(whole, F.lit(30))).otherwise(whole)
    beats = read(spark, sf_dir, "customer").filter("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("host"), document.alias("document"))
    return reports.last_uploads(probes, beats)


@query(
    """with f as (select l_returnflag || l_linestatus as agent, '/r/' || l_suppkey as dir, l_partkey as size, l_shipdate as mtime, case when l_suppkey % 5 = 0 or l_linenumber = 1 and l_suppkey % 5 = 1 then '.m' || l_linenumber % 2 end as marker, l_quantity > 25 as pending from lineitem),
            r as (select agent, dir, sum(size)::bigint as bytes, coalesce(sum(case when pending then size end), 0)::bigint as pending, max(mtime) as last, string_agg(distinct marker, ',' order by marker) as markers, bool_and(marker is not null) as off from f group by agent, dir),
            a as (select agent, row_number() over (order by max(last) desc, agent) as agent_place from r group by agent)
       select agent, agent_place::int as agent_place, dir, (row_number() over (partition by agent order by last::date desc, bytes desc, dir))::int as place, bytes, pending, coalesce(markers, '') as markers, off from r join a using (agent)"""
)
def survey_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of agents in suppliers' repositories, in the order of a survey."""
    line = read(spark, sf_dir, "lineitem")
    marker = F.when((F.col("l_suppkey") % 5 == 0) | ((F.col("l_linenumber") == 1) & (F.col("l_suppkey") % 5 == 1)), F.format_string(".m%d", F.col("l_linenumber") % 2))
    files = line.select(F.concat("l_returnflag", "l_linestatus").alias("agent"), F.format_string("/r/%d", "l_suppkey").alias("dir"), F.col("l_partkey").alias("size"), F.col("l_shipdate").alias("mtime"), marker.alias("marker"), (F.col("l_quantity") > 25).alias("pending"))
    return reports.surveyed(files).select("agent", "agent_place", "dir", "place", "bytes", "pending", F.array_join("markers", ",").alias("markers"), "off")


@query(
    """with u as (select o_orderkey as k, l_partkey % 3 as m, l_suppkey % 2 as p, sum(l_quantity)::bigint as tokens from lineitem join orders on o_orderkey = l_orderkey group by all),
            x as (select k, sha256('sessions' || chr(0) || k || chr(0) || '["m' || m || '","p' || p || '","https://x' || p || '",null,"t"]') as h, m, p, tokens from u)
       select k as session_id, 'session' as type, 1::bigint as place, '{"id":"' || o_orderkey || '","source":"' || o_orderpriority || '"}' as record from (select o_orderkey as k, * from orders)
       union all select l_orderkey, 'message', (row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_returnflag))::bigint, '{"content":"' || l_returnflag || '","id":' || l_linenumber || ',"timestamp":' || epoch(l_shipdate)::bigint || '}' from lineitem
       union all select k, 'usage', (row_number() over (partition by k order by m, p))::bigint, '{"billing_provider":"p' || p || '","model":"m' || m || '","task":"t","tokens":' || tokens || ',"usage_id":"' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '"}' from x"""
)
def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions with messages and usage by model, as records of one form."""
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    sessions = orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("source"))
    messages = line.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("content"), F.unix_timestamp("l_shipdate").alias("timestamp"))
    by = [F.col("l_orderkey").alias("session_id"), F.format_string("m%d", F.col("l_partkey") % 3).alias("model"), F.format_string("p%d", F.col("l_suppkey") % 2).alias("billing_provider")]
    usage = line.groupBy(*by).agg(F.sum("l_quantity").cast("bigint").alias("tokens"))
    usage = usage.select("*", F.concat(F.lit("https://x"), F.substr("billing_provider", F.lit(2))).alias("billing_base_url"), F.lit(None).cast("string").alias("billing_mode"), F.lit("t").alias("task"))
    return reports.usage_records(sessions, messages, usage, "sessions")


@query("select page_id, array_to_string(list_reverse(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '')), chr(10)) as lines from pages")
def reversed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' lines, the last one first, blank ones left out."""
    return read(spark, sf_dir, "pages").select("page_id", reports.oldest_first(F.col("html")).alias("lines"))
