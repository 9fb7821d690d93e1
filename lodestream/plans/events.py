"""Queries over event logs: streaks, runs, tails, buckets, late data."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import eventlog
from lodestream.plans.registry import query, read, relational
from lodestream.streaming import changes

relational(
    "tail_n_audit",
    "select event_type, event_id, ts from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from {events}) where rn <= 20",
)
relational(
    "failure_streak",
    """select user_id, count(case when event_type = 'error' and (last_ok is null or (ts, event_id) > last_ok) then 1 end) as streak from (
         select *, max(case when event_type = 'purchase' then struct(ts, event_id) end) over (partition by user_id) as last_ok from {events}) group by user_id""",
    """select user_id, count(case when event_type = 'error' and (last_ok is null or row(ts, event_id) > last_ok) then 1 end) as streak from (
         select *, max(case when event_type = 'purchase' then row(ts, event_id) end) over (partition by user_id) as last_ok from {events}) group by user_id""",
)
relational(
    "crash_runs",
    """select user_id, run, min(ts) as began, count(*) as n, max(case when event_type = 'purchase' then 1 else 0 end) = 1 as clean from (
         select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as run from {events})
       group by user_id, run""",
    """select user_id, cast(run as bigint) as run, min(ts) as began, count(*) as n, max(case when event_type = 'purchase' then 1 else 0 end) = 1 as clean from (
         select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as run from {events})
       group by user_id, run""",
)


@query("select time_bucket(interval 15 minutes, ts) as bucket, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in tumbling windows of 15 minutes."""
    return eventlog.buckets(read(spark, sf_dir, "events"), "15 minutes")


@query(
    """with h as (select user_id, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2)
       select user_id, day, n, coalesce(n <> lag(n) over (partition by user_id order by day), true) as changed from h"""
)
def series_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots of each user that differ from the one before."""
    daily = read(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return eventlog.changed(daily, "user_id", "day", "n")


relational("late_recompute_flag", "select event_id, ts >= timestamp '2024-01-29 00:00:00' - interval 24 hours as recompute, cast(ts as date) < date '2024-01-28' as settled from {events}")
relational(
    "tick_verdict",
    """select cast(ts as date) as day, case when count(case when event_type = 'purchase' then 1 end) = 0 and count(case when event_type = 'error' then 1 end) > 0 then 'failure' else 'ok' end as verdict,
       min(case when event_type = 'error' then event_id end) as first_failure from {events} group by cast(ts as date)""",
)
relational(
    "audit_elision",
    """select event_type, event_id, cast(1 as bigint) as n from {events} where event_type <> 'view'
       union all select event_type, cast(null as bigint) as event_id, count(*) as n from {events} where event_type = 'view' group by event_type""",
)
relational(
    "field_path_explode",
    "select event_id, '$.k' as path, cast(get_json_object(props, '$.k') as bigint) as value from {events} where get_json_object(props, '$.k') is not null",
    "select event_id, '$.k' as path, cast(json_extract_string(props, '$.k') as bigint) as value from events where json_extract_string(props, '$.k') is not null",
)
relational(
    "json_sniff",
    "select event_id, case when props is null or trim(props) = '' then 'empty' when try_parse_json(props) is not null and substr(trim(props), 1, 1) = chr(123) then 'ok' else 'unexpected_shape' end as shape from {events}",
    "select event_id, case when props is null or trim(props) = '' then 'empty' when json_valid(props) and substr(trim(props), 1, 1) = chr(123) then 'ok' else 'unexpected_shape' end as shape from {events}",
)


@query()
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate limit of each user: 5 tokens, one back an hour; tested against a plain loop."""
    return eventlog.rate_limited(read(spark, sf_dir, "events"), capacity=5, refill_s=3600)


@query(
    """with e as (select cast(user_id as varchar) as id, ts as "at", floor(value)::bigint as size, event_type as hash from events where user_id is not null),
            o as (select *, row_number() over w as n, lag("at") over w as was_at, lag(size) over w as was_size, lag(hash) over w as was_hash, lead("at") over w as next_at from e
                  window w as (partition by id order by "at", size nulls first, hash nulls first)),
            d as (select id, "at", case when was_at is null or was_at + interval 12 hour <= "at" then 'new' when was_size is not distinct from size and was_hash is not distinct from hash then 'unchanged'
                    when coalesce(size, 0) < coalesce(was_size, 0) then 'shrunk' else 'changed' end as decision, next_at from o)
       select id, "at", decision from d
       union all select id, "at" + interval 12 hour as "at", 'forgotten' as decision from d where next_at is null or "at" + interval 12 hour <= next_at"""
)
def watched_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as snapshots of their users' files: what is done about each, and when a file not seen for twelve hours is forgotten. Parked files and streams are tested apart."""
    events = read(spark, sf_dir, "events").filter("user_id is not null")
    none = F.lit(None).cast("string")
    rows = events.select(F.lit("events").alias("source_id"), F.col("user_id").cast("string").alias("id"), F.col("ts").alias("at"), none.alias("path"), F.floor("value").cast("bigint").alias("size"), F.col("event_type").alias("hash"), none.alias("error"))
    return changes.decided(rows, datetime(2200, 1, 1), forget=timedelta(hours=12)).select("id", "at", "decision")
