"""Queries of what is remembered of files: what is pending, what is only refreshed, surveys, logs, and oversize files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import cdc, eventlog, paths, reports
from lodestream.plans.registry import query, read, relational


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of three sources."""
    own = "o_orderkey as l_orderkey", "o_orderkey % 7 as l_linenumber", "o_custkey % 97 as l_suppkey", "o_custkey * 3 as l_partkey", "o_orderkey * 7 % 50 as l_quantity", "o_orderstatus as l_returnflag", "left(o_orderpriority, 1) as l_linestatus", "o_orderdate as l_shipdate"
    line = read(spark, sf_dir, "orders").selectExpr(*own)
    return line.select(F.format_string("s%d", F.col("l_suppkey") % 3).alias("source_id"), F.format_string("%d/%d", "l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("size"), F.col("l_shipdate").alias("mtime"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")


_OWN = """(select o_orderkey as l_orderkey, o_orderkey % 7 as l_linenumber, o_custkey % 97 as l_suppkey, o_custkey * 3 as l_partkey, o_orderkey * 7 % 50 as l_quantity, o_orderstatus as l_returnflag,
    left(o_orderpriority, 1) as l_linestatus, o_orderdate as l_shipdate from orders)"""
_PENDING = f"""with f as (select l_suppkey % 3 as s, l_orderkey as k, l_linenumber as n, l_partkey as size, l_shipdate as mtime, l_linenumber = 2 as session, l_quantity as q, l_suppkey, l_returnflag, l_linestatus from {_OWN}),
            t as (select *, k % 5 <> 0 as known, size + case when q > 45 then 1 else 0 end as was_size, mtime - case when q < 5 then interval 1 hour else interval 0 hour end as was_mtime, case when q > 40 then '' else 'h' end as hash, q between 30 and 33 as parked from f),
            c as (select *, max(case when session and known then was_mtime end) over (partition by s) as checked from t),
            p as (select *, case when s = 1 or not known then true when session then hash = '' or parked or was_mtime < checked else was_size <> size or was_mtime <> mtime end as pending from c)"""


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumns({"spec": F.lit("now"), "session": F.col("l_linenumber") == 2})
    later = F.when(F.col("l_quantity") < 5, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))
    state = files.filter("l_orderkey % 5 <> 0").select("source_id", "id", (F.col("size") + (F.col("l_quantity") > 45).cast("int")).alias("size"), (F.col("mtime") - later).alias("mtime"), F.when(F.col("l_quantity") > 40, "").otherwise("h").alias("hash"), F.col("l_quantity").between(30, 33).alias("parked"))
    specs = files.filter("source_id <> 's2'").select("source_id", F.when(F.col("source_id") == "s1", "before").otherwise("now").alias("spec")).distinct()
    return cdc.pending(files, state, specs)


@query(_PENDING + " select k as l_orderkey, n as l_linenumber, pending from p")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sessions of three sources, one of another spec: which are still to be sent."""
    return _pending(spark, sf_dir).select("l_orderkey", "l_linenumber", "pending")


@query(
    _PENDING
    + """, a as (select *, l_returnflag || l_linestatus as agent, case when l_suppkey % 4 > 0 then '/w/r' || l_suppkey % 20 end as dir from p),
            r as (select agent, dir, sum(size)::bigint as bytes, coalesce(sum(case when pending then size end), 0)::bigint as pending, max(mtime) as last from a where dir is not null group by agent, dir)
       select agent, dir, (row_number() over (partition by agent order by last::date desc, bytes desc, dir))::int as place, bytes, pending from r"""
)
def survey_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files attributed to the checkouts above them, with what is pending of each, in the order of a survey."""
    files = _pending(spark, sf_dir).withColumn("path", F.format_string("/w/r%d/x/%s", F.col("l_suppkey") % 20, "id"))
    roots = files.filter("l_suppkey % 4 > 0").select(F.format_string("/w/r%d", F.col("l_suppkey") % 20).alias("dir")).distinct()
    placed = files.join(paths.nearest(files, "id", "path", roots), "id").filter("root is not null")
    rows = placed.select(F.concat("l_returnflag", "l_linestatus").alias("agent"), F.col("root").alias("dir"), "size", "mtime", F.lit(None).cast("string").alias("marker"), "pending")
    return reports.surveyed(rows).select("agent", "dir", "place", "bytes", "pending")


@query(
    f"""with f as (select l_orderkey as k, l_linenumber as n, l_partkey as size, l_quantity as q, case when l_suppkey % 4 = 0 then 'b' else 'a' end as path from {_OWN}),
            t as (select *, k % 5 <> 0 as known, size + case when q > 40 then 7 else -7 end as was_size, case when n = 3 then 'a' else path end as was_path, n % 2 = 0 as same, q between 10 and 12 as other_policy from f)
       select k as l_orderkey, n as l_linenumber, case when known and same and not other_policy then 'unchanged' when known and size < was_size and path = was_path then 'shrunk' else 'shipped' end as decision, size as next_size, 0::int as next_attempts from t"""
)
def refresh_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were read, against what is remembered: those of the same content are only remembered anew, and wait no longer."""
    files = _files(spark, sf_dir)
    path = F.when(F.col("l_suppkey") % 4 == 0, "b").otherwise("a")
    hash_ = lambda same: F.when(same, F.lit("h")).otherwise(F.lit("g"))
    now = files.select("source_id", "id", path.alias("path"), "size", "mtime", F.lit("h").alias("hash"))
    state = files.filter("l_orderkey % 5 <> 0").select(
        "source_id", "id", F.when(F.col("l_linenumber") == 3, "a").otherwise(path).alias("path"), (F.col("size") + F.when(F.col("l_quantity") > 40, 7).otherwise(-7)).alias("size"), "mtime",
        hash_(F.col("l_linenumber") % 2 == 0).alias("hash"), F.lit(True).alias("parked"), F.lit(3).alias("attempts"), (~F.col("l_quantity").between(10, 12)).alias("policy_met"),
    )
    told, after = cdc.refreshed(now, state)
    both = told.select("source_id", "id", "decision").join(after.select("source_id", "id", F.col("size").alias("next_size"), F.col("attempts").alias("next_attempts")), ["source_id", "id"])
    at = lambda k: F.element_at(F.split("id", "/"), k).cast("bigint")
    return both.select(at(1).alias("l_orderkey"), at(2).alias("l_linenumber"), "decision", "next_size", "next_attempts")


@query(
    """with e as (select event_id, case when event_id % 3 = 0 then 0 else 1 end as generation, event_id % 7 = 0 as torn, event_type from events where event_id % 11 <> 0),
            l as (select * from e where not torn order by generation desc, event_id desc limit 500)
       select event_id, generation, event_type, (select count(*) from e where torn)::bigint as malformed from l"""
)
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five hundred entries of a log of two generations with torn and blank lines, made of all events."""
    whole = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 11 == 0, " ").when(F.col("event_id") % 7 == 0, F.left(whole, F.lit(14))).otherwise(whole)
    lines = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("generation"), F.col("event_id").alias("line_no"), line.alias("line"))
    tail, bad = eventlog.audit_tail(lines, 500)
    return tail.select(F.col("line_no").alias("event_id"), "generation", F.col("entry")["event_type"].alias("event_type")).join(F.broadcast(bad))  # one row


@query(
    """with e as (select user_id, ts, event_id, event_type in ('error', 'click') as failed, event_type || event_id as message from events where user_id is not null and ts is not null),
            g as (select user_id, max((ts, event_id)) as good from e where not failed group by user_id),
            s as (select e.* from e left join g using (user_id) where failed and (good is null or (ts, event_id) > good)),
            r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from s)
       select user_id, count(*)::bigint as streak, min(ts) as first, string_agg(message, ',' order by ts, event_id) filter (rn <= 3) as log from r group by user_id"""
)
def failure_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's failures since the last success: how many, since when, and the last three."""
    events = read(spark, sf_dir, "events").filter("user_id is not null and ts is not null")
    outcomes = events.select("user_id", "ts", "event_id", F.col("event_type").isin("error", "click").alias("failed"), F.concat("event_type", F.col("event_id").cast("string")).alias("message"))
    return eventlog.failure_log(outcomes, "user_id", ["ts", "event_id"], 3).select("user_id", "streak", "first", F.array_join("log", ",").alias("log"))


relational(
    "oversize_examples",
    """select source, count(*) as files, max(n_chars) as largest, max_by(doc_id, named_struct('n', n_chars, 'id', -doc_id)) as example, 600 as limit_chars from {documents} where n_chars > 600 group by source""",
    """select source, count(*) as files, max(n_chars) as largest, arg_max(doc_id, (n_chars, -doc_id)) as example, 600 as limit_chars from documents where n_chars > 600 group by source""",
)
