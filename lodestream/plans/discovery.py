"""Discovery, identity, change detection and size rules over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import detect
from lodestream.operators import cdc, discover
from lodestream.plans.registry import query, read, relational


@query(
    """select page_id, case when path like 'private/%' or regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.(?:pem|key)$') then 'denied'
       when regexp_matches(path, '^(?:[^/]+/)*[^/]*[02468]$') then 'excluded' when regexp_matches(path, '^.*$') then 'included' else 'unmatched' end as verdict
       from (select page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') as path from pages)"""
)
def glob_deny_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include, exclude and deny globs over the paths of pages; deny outranks exclude, exclude outranks include."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+/", "").alias("path"))
    verdict = discover.verdict("path", include=["**"], exclude=["**/*[02468]"], deny=["private/**", "**/*.{pem,key}"])
    return pages.select("page_id", verdict.alias("verdict"))


@query(
    """select identity, o_orderkey, form from (
         select *, row_number() over (partition by identity order by day desc, form, o_orderkey) as rn from (
           select 'customer-' || o_custkey as identity, o_orderkey, cast(o_orderdate as date) as day, cast(o_orderkey % 2 as int) as form from orders))
       where rn = 1"""
)
def identity_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several forms of one identity the newest stays, plain before compressed, then the least path."""
    forms = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer-"), "o_custkey").alias("identity"), "o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 2).cast("int").alias("form")
    )
    return discover.keep_best(forms, "identity", [F.desc("day"), "form", "o_orderkey"]).select("identity", "o_orderkey", "form")


@query(
    """with r as (select source, doc_id, row_number() over (partition by source order by n_chars, doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
       select source, doc_id from r where exists (select 1 from (values (0), (1), (2), (3), (4)) g(k) where i = cast(floor(k * (n - 1) / 4.0) as bigint))"""
)
def sniff_sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spread documents of each source, in order of size."""
    return discover.sample_grid(read(spark, sf_dir, "documents"), "source", "n_chars", "doc_id", 5).select("source", "doc_id")


relational(
    "size_cap_split",
    """select source, count(*) as files, sum(case when n_chars <= 5000 then 1 else 0 end) as kept, sum(case when n_chars > 5000 then 1 else 0 end) as oversize,
       max(case when n_chars > 5000 then n_chars end) as largest from {documents} group by source""",
    """select source, count(*) as files, cast(sum(case when n_chars <= 5000 then 1 else 0 end) as bigint) as kept, cast(sum(case when n_chars > 5000 then 1 else 0 end) as bigint) as oversize,
       max(case when n_chars > 5000 then n_chars end) as largest from {documents} group by source""",
)


@query(
    """select source, doc_id, rn <= 20 as admitted, greatest(n - 20, 0) as remaining from (
         select source, doc_id, row_number() over (partition by source order by n_chars, doc_id) as rn, count(*) over (partition by source) as n from documents)"""
)
def oldest_first_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents of each source by size are admitted."""
    return discover.within_budget(read(spark, sf_dir, "documents"), "source", "n_chars", "doc_id", 20).select("source", "doc_id", "admitted", "remaining")


@query(
    """select c_custkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) as session_key
       from (select c_custkey, sha256(encode('session') || encode(chr(0)) || encode(c_name)) as h from customer)"""
)
def session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUID-shaped surrogate keys of a namespace and a value."""
    return read(spark, sf_dir, "customer").select("c_custkey", detect.session_key("session", F.col("c_name")).alias("session_key"))


@query(
    """select n_nationkey, 'host.example' as host, 'team/' || lower(replace(n_name, ' ', '-')) as path from nation"""
)
def remote_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of git remotes written in three ways."""
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    form = F.col("n_nationkey") % 3
    url = (
        F.when(form == 0, F.concat(F.lit("git@host.example:team/"), name, F.lit(".git")))
        .when(form == 1, F.concat(F.lit("https://user:pw@HOST.example/team/"), name))
        .otherwise(F.concat(F.lit("ssh://git@host.example:22/team/"), name, F.lit(".git/")))
    )
    return read(spark, sf_dir, "nation").select("n_nationkey", url.alias("url")).select("n_nationkey", *discover.remote("url"))


relational(
    "output_veto",
    """with refs as (select l_orderkey as file, l_suppkey % 7 = 0 as ignored from {lineitem})
       select o_orderkey as file from {orders} where o_orderkey in (select file from refs where not ignored) and o_orderkey not in (select file from refs where ignored)""",
)
relational(
    "session_generations",
    """select user_id, 'old' as generation, count(*) as n from {events} where user_id not in (select user_id from {events} where event_type = 'signup') group by user_id
       union all select user_id, 'new' as generation, count(*) as n from {events} where user_id in (select user_id from {events} where event_type = 'signup') group by user_id""",
)

@query(
    """select d.day, count(e.event_id) as n, d.day < date '2024-01-29' as settled
       from (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as day) d left join events e on cast(e.ts as date) = d.day group by d.day"""
)
def usage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day from the first to the last one that has any; days before the last two are settled. The SQL has the calendar of the test tables."""
    counts = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("event_id").alias("n"))
    ends = counts.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = ends.select(F.explode(F.sequence("first", "last")).alias("day"), "last")
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), (F.col("day") < F.date_sub("last", 1)).alias("settled"))


_VERSIONS = """with old as (select source as source_id, cast(doc_id as varchar) as id, n_chars as size, md5(text) as hash, doc_id % 50 = 0 as parked from documents where doc_id % 11 <> 0),
  new as (select source as source_id, cast(doc_id as varchar) as id,
            case when doc_id % 5 = 0 then n_chars + 2 when doc_id % 7 = 0 then n_chars - 1 else n_chars end as size,
            md5(case when doc_id % 5 = 0 then text || ' x' when doc_id % 7 = 0 then substr(text, 1, n_chars - 1) else text end) as hash from documents where doc_id % 13 <> 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A remembered state of documents, and the documents as changed since."""
    docs = read(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 11 <> 0").selectExpr("source as source_id", "cast(doc_id as string) as id", "n_chars as size", "md5(text) as hash", "doc_id % 50 = 0 as parked")
    text = "case when doc_id % 5 = 0 then text || ' x' when doc_id % 7 = 0 then substr(text, 1, n_chars - 1) else text end"
    size = "case when doc_id % 5 = 0 then n_chars + 2 when doc_id % 7 = 0 then n_chars - 1 else n_chars end"
    new = docs.filter("doc_id % 13 <> 0").selectExpr("source as source_id", "cast(doc_id as string) as id", f"{size} as size", f"md5({text}) as hash")
    return old, new


@query(
    _VERSIONS
    + """ select n.source_id, n.id, case when o.id is null then 'new' when o.parked then 'parked' when o.size = n.size and o.hash = n.hash then 'unchanged'
            when n.size < o.size then 'shrunk' else 'changed' end as decision from new n left join old o using (source_id, id)"""
)
def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has changed since the remembered state."""
    old, new = _versions(spark, sf_dir)
    return cdc.classify(new, old).select("source_id", "id", "decision")


@query(
    _VERSIONS
    + """ select o.source_id, o.id from old o where exists (select 1 from new n where n.source_id = o.source_id) and not exists (select 1 from new n where n.source_id = o.source_id and n.id = o.id)"""
)
def vanished_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remembered documents that are gone, of sources that were collected."""
    old, new = _versions(spark, sf_dir)
    return cdc.vanished(old, new).select("source_id", "id")


@query(
    _VERSIONS
    + """ select source_id, count(*) filter (where decision = 'new') as n_new, count(*) filter (where decision in ('changed', 'shrunk')) as n_shipped,
            count(*) filter (where decision = 'unchanged') as n_unchanged, count(*) filter (where decision = 'parked') as n_parked,
            cast(list_sort(list(size) filter (where decision in ('new', 'changed', 'shrunk')))[cast(floor(count(*) filter (where decision in ('new', 'changed', 'shrunk')) / 2.0) as bigint) + 1] as bigint) as upper_median
          from (select n.source_id, n.size, case when o.id is null then 'new' when o.parked then 'parked' when o.size = n.size and o.hash = n.hash then 'unchanged'
            when n.size < o.size then 'shrunk' else 'changed' end as decision from new n left join old o using (source_id, id)) group by source_id"""
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and the upper median of shipped sizes for each source."""
    old, new = _versions(spark, sf_dir)
    return cdc.report(cdc.classify(new, old))


@query(
    """select attempt, key, cast(least(60 * cast(power(2, least(attempt, 8)) as bigint), 3600) as bigint) as delay_s
       from range(0, 12) a(attempt), (select n_name as key from nation) k"""
)
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential backoff by attempt, capped at an hour."""
    keys = read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("attempt"))
    return keys.select("attempt", "key", cdc.backoff("attempt").alias("delay_s"))


relational(
    "source_health",
    """select source, case when files = 0 then 'agent_absent' when ok = 0 then 'root_present_no_match' when unreadable * 2 > files then 'unreadable' else 'collected' end as health, files, ok
       from (select source, count(*) as files, count(case when n_chars >= 500 then 1 end) as ok, count(case when n_chars < 200 then 1 end) as unreadable from {documents} group by source)""",
)
relational(
    "pending_backlog",
    """select d.source, count(*) as files, count(case when l.doc_id is null then 1 end) as pending, cast(coalesce(sum(case when l.doc_id is null then d.n_chars end), 0) as bigint) as pending_chars
       from {documents} d left join {labels} l on l.doc_id = d.doc_id group by d.source""",
)


@query("select source, doc_id from documents where doc_id % 2 = cast(substr(source, 4) as int) % 2")
def spec_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remembered files whose source is still read in the same way."""
    docs = read(spark, sf_dir, "documents")
    state = docs.select(F.col("source").alias("source_id"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("spec"))
    specs = docs.select(F.col("source").alias("source_id")).distinct().withColumn("spec", F.when(F.substr("source_id", F.lit(4)).cast("int") % 2 == 0, "v2").otherwise("v1"))
    return cdc.of_spec(state, specs).select(F.col("source_id").alias("source"), "doc_id")
