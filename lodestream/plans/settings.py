"""Queries of roots, schedules, patterns, pauses and identities, over values made from several columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import settings
from lodestream.plans.registry import query, read


@query(
    """with c as (select c_custkey, c_nationkey as n, c_mktsegment as seg, c_acctbal from customer),
            r as (select *, c_custkey % 4 = 0 as had, c_custkey % 7 <> 0 as on_,
                    case when n % 3 <> 0 and n % 2 = 0 then '/data/' || n || '/projects/' || lower(seg) end as first, '/home/h' || n || '/.agent/' || lower(seg) as second from c),
            e as (select *, case when first is not null and c_acctbal > 2000 then first when c_acctbal > 0 then second end as pick from r)
       select 'h' || c_custkey as host, lower(seg) as source, case when had then '/kept/' || c_custkey when on_ then pick end as root, coalesce(not had and on_ and pick is not null, false) as found,
         case when not had and on_ and pick is null then case when first is null then 'root ${BASE}/projects/../projects/' || lower(seg) || ' does not expand' else first || ' does not exist' end || '; ' || second || ' does not exist' end as reasons
       from e"""
)
def picked_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hosts with a source each: absent roots picked anew from templates with variables and ``~``, those there kept."""
    hosts = read(spark, sf_dir, "customer").select("c_custkey", F.format_string("h%d", "c_custkey").alias("host"), F.lower("c_mktsegment").alias("source"), F.col("c_nationkey").alias("n"), "c_acctbal")
    sources = hosts.select("host", "source", (F.col("c_custkey") % 7 != 0).alias("enabled"), F.when(F.col("c_custkey") % 4 == 0, F.format_string("/kept/%d", "c_custkey")).alias("root"))
    segments = hosts.select("source").distinct()
    templates = segments.select("source", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("${BASE}/projects/../projects/"), "source").alias("template")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("~/./.agent/"), "source").alias("template")))).alias("t"))
    # The variable is unset for some hosts and empty for others.
    base = F.when(F.col("n") % 3 == 0, F.create_map(F.lit("OTHER"), F.lit("/x"))).otherwise(F.create_map(F.lit("BASE"), F.when(F.col("n") % 2 == 0, F.format_string("/data//%d", "n")).otherwise("")))
    env = hosts.select("host", base.alias("env"), F.format_string("/home/h%d", "n").alias("home"))
    rich, some = hosts.filter("c_acctbal > 2000"), hosts.filter("c_acctbal > 0")
    existing = rich.select("host", F.concat(F.format_string("/data/%d/projects/", "n"), "source").alias("path")).unionByName(some.select("host", F.concat(F.format_string("/home/h%d/.agent/", "n"), "source").alias("path")))
    return settings.picked(sources, templates.select("source", "t.rank", "t.template"), env, existing)


@query(
    """with s as (select l_orderkey, l_linenumber, l_partkey % 5 as k, l_suppkey % 90 as a, l_linenumber % 7 as b, l_quantity::bigint as q from lineitem),
            v as (select l_orderkey, l_linenumber, case k when 0 then a || 'm' when 1 then b || 'h' || a || 'm' when 2 then (a - 40) || '.5m' || q || 's' when 3 then q || ' m' else ' ' || a || 's' || q || 'ms ' end as schedule,
                    case k when 0 then a * 60e9 when 1 then b * 3600e9 + a * 60e9 when 2 then case when a < 40 then -1 else (a - 40) * 60e9 + 30e9 + q * 1e9 end when 3 then null else a * 1e9 + q * 1e6 end::bigint as ns from s)
       select l_orderkey, l_linenumber, case when ns is null or ns <= 0 then 900000000000 when ns < 60000000000 then 60000000000 else ns end as ns,
         case when ns is null then 'mode.schedule "' || schedule || '": not a duration like "5m", ticking every 15m0s instead' when ns <= 0 then 'mode.schedule "' || schedule || '": a tick interval must be positive, ticking every 15m0s instead'
              when ns < 60000000000 then 'mode.schedule "' || schedule || '" is under the 1m0s floor, ticking every 1m0s' end as warning from v"""
)
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as schedules of several shapes: the tick that each means, and what is said of bad ones."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 5 as k", "l_suppkey % 90 as a", "l_linenumber % 7 as b", "cast(l_quantity as bigint) as q")
    text = "case k when 0 then concat(a, 'm') when 1 then concat(b, 'h', a, 'm') when 2 then concat(a - 40, '.5m', q, 's') when 3 then concat(q, ' m') else concat(' ', a, 's', q, 'ms ') end"
    told = rows.selectExpr("l_orderkey", "l_linenumber", f"{text} as schedule").select("l_orderkey", "l_linenumber", settings.tick(F.col("schedule")).alias("t"))
    return told.select("l_orderkey", "l_linenumber", "t.ns", "t.warning")


@query(
    """with p as (select p_partkey, p_partkey % 11 as k, replace(p_name, ' ', '/') || p_size as n from part)
       select p_partkey, case k when 0 then 'backslash' when 1 then 'not relative' when 2 then 'not relative' when 3 then 'empty or dot segment' when 4 then 'empty or dot segment' when 5 then 'not a glob' when 6 then 'not a glob' when 7 then 'not a glob' end as fault from p"""
)
def pattern_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as patterns to leave out, some of which can't be."""
    n = "concat(replace(p_name, ' ', '/'), p_size)"
    shapes = [f"concat({n}, '\\\\\\\\x')", f"concat('/', {n})", f"concat('~/', {n})", f"concat('a//', {n})", f"concat({n}, '/../x')", f"concat({n}, '[a-')", f"concat('{{a,', {n})", f"concat({n}, '[b-]/}}')", f"concat({n}, '/**/*.[jt]s')", f"concat('{{a,{{b,c}}}}/', {n})", f"concat({n}, '[!a-f0-9]?')"]
    pattern = f"case p_partkey % 11 {' '.join(f'when {k} then {s}' for k, s in enumerate(shapes))} end"
    return read(spark, sf_dir, "part").selectExpr("p_partkey", f"{pattern} as pattern").select("p_partkey", settings.pattern_fault(F.col("pattern")).alias("fault"))


@query(
    """with f as (select o_orderkey, o_orderkey % 6 as k, o_orderdate as d, o_orderpriority as why from orders),
            s as (select *, case k when 3 then d <= timestamp '1995-06-01 00:00:00' else false end as over from f)
       select o_orderkey, k <> 0 and not over as paused, case when k = 0 or over then null when k in (1, 5) then 'the pause flag exists but could not be parsed' when k = 4 then null else why end as reason from s"""
)
def pause_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pause flags: none, torn ones, some without an end, and some past theirs or not."""
    until = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("o_orderkey") % 6
    whole = F.to_json(F.struct(F.lit(True).alias("paused"), F.col("o_orderpriority").alias("reason"), F.when(k == 3, until).alias("until")))
    flag = F.when(k == 1, F.left(whole, F.lit(20))).when(k == 5, F.lit("[")).when(k == 4, F.lit('{"paused":true}')).when(k > 1, whole)
    told = read(spark, sf_dir, "orders").select("o_orderkey", settings.paused(flag, F.lit("1995-06-01 00:00:00").cast("timestamp")).alias("p"))
    return told.select("o_orderkey", "p.paused", "p.reason")


@query(
    r"""select page_id, case when regexp_matches(url, '/([^/?#]*)([/?#]|$)') then regexp_replace(regexp_extract(url, '^https?://([^/?#]+)/?([^?#]*)', 0), '^https?://([^/?#]+)/?([^?#]*)', 'site/\1::\2') else '' end as identity from pages"""
)
def template_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pattern captures in each page's address, put into a template."""
    return read(spark, sf_dir, "pages").select("page_id", settings.identity(F.col("url"), r"^https?://([^/?#]+)/?([^?#]*)", "site/$1::$2").alias("identity"))


@query(
    """with r as (select o_custkey, count(*) as files, count(*) filter (o_orderstatus = 'F') as shipped, bool_or(o_orderpriority = '1-URGENT' and o_totalprice > 300000) as failed from orders group by o_custkey)
       select o_custkey, case when not failed and files > 12 and least(files, 12) > 0 and shipped > 0 then 15 else 900 end::bigint as wait_s from r"""
)
def next_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as runs over files, twelve at most: how long each waits for its next one."""
    runs = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("files"), F.count_if(F.col("o_orderstatus") == "F").alias("shipped"), F.bool_or((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)).alias("failed"))
    return runs.select("o_custkey", settings.next_wait(F.col("failed"), F.col("files") > 12, F.col("shipped"), F.lit(900).cast("bigint")).alias("wait_s"))


_LAYERS = [
    (0, True, "schedule", "true", "'15m'"), (2, False, "schedule", "c % 2 = 1", "c % 50 || 'm'"), (3, True, "schedule", "c % 3 = 0", "'1h'"),
    (0, True, "packs", "true", "'a,b'"), (2, False, "packs", "c % 5 = 0", "'c,a'"), (3, True, "packs", "c % 7 = 0", "'d'"),
    (0, True, "autoupdate", "true", "'true'"), (2, False, "autoupdate", "c % 6 = 1", "'false'"), (2, False, "autoupdate", "c % 50 = 3", "'true'"), (3, True, "autoupdate", "c % 4 = 0", "'false'"),
    (3, True, "state_dir", "c % 8 = 0", "'/x' || c"), (2, False, "state_dir", "c % 60 = 7", "'/y'"), (2, False, "endpoint", "c % 3 = 1", "'/t'"), (3, True, "endpoint", "c % 70 = 9", "'/u'"), (3, True, "typo", "c % 90 = 11", "'1'"),
]


@query(
    "with n as (select c_custkey as c from customer), e as ("
    + " union all ".join(f"select c, {rank} as rank, {str(local).lower()} as loc, '{field}' as field, {value} as value from n where {when}" for rank, local, field, when, value in _LAYERS)
    + """), w as (select *, case when field = 'typo' then 'no such setting' when field = 'state_dir' and not loc then 'machine-owner only' when field = 'endpoint' and loc then 'served by the control plane only'
                        when field = 'autoupdate' and not loc and value = 'true' then 'may be turned off but never on' end as reason from e),
         r as (select c, arg_min((field, rank, reason), (rank, field)) as f from w where reason is not null group by c),
         o as (select *, arg_max(value, rank) over (partition by c, field) as last, max(rank) over (partition by c, field) as origin from e where c not in (select c from r)),
         p as (select distinct c, field, origin, case when field = 'packs' then 'a,b' || case when c % 5 = 0 then ',c' else '' end || case when c % 7 = 0 then ',d' else '' end else last end as value from o)
       select c as host, field, value, origin from p union all select c, 'refused: ' || f[1] as field, f[3] as value, f[2] as origin from r"""
)
def resolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hosts with four layers of settings: what they make together, with origins, and which are refused and why."""
    hosts = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    each = [F.when(F.expr(when), F.struct(F.lit(rank).alias("rank"), F.lit(local).alias("local"), F.lit(field).alias("field"), F.split(F.expr(value), ",").alias("value"))) for rank, local, field, when, value in _LAYERS]
    entries = hosts.select(F.col("c").alias("host"), F.explode(F.array(*each)).alias("e")).filter("e is not null").select("host", "e.*")
    merged, refused = settings.resolved(entries, {"schedule": "last", "packs": "union", "autoupdate": "off", "state_dir": "local", "endpoint": "remote"})
    shown = merged.select("host", "field", F.array_join("value", ",").alias("value"), "origin")
    return shown.unionByName(refused.select("host", F.concat(F.lit("refused: "), "field").alias("field"), F.col("reason").alias("value"), F.col("rank").alias("origin")))
