"""What installs report, and what is shown of it: catalogs by digest, health, last uploads, surveys, and objects that are stored already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.detect import session_key
from lodestream.operators.paths import bounded

#: Faults that a report keeps, and characters of their facts and messages.
FAULTS, FACT, MESSAGE = 20, 200, 1000


def stored_already(offered: DataFrame, stored: DataFrame) -> DataFrame:
    """``offered`` (object_id, key, source_hash, shipped_hash, mirror) with ``settled``: whether the store holds the object under that key with the same two hashes.

    An object stored without a shipped hash, one that couldn't be read (``stored``: key,
    source_hash, shipped_hash), and one that isn't a mirror's are sent: a match missed
    costs one upload, a wrong one the object.
    """
    held = stored.filter(F.coalesce("shipped_hash", F.lit("")) != "").select(F.col("key").alias("_key"), F.col("source_hash").alias("_source"), F.col("shipped_hash").alias("_shipped")).distinct()
    same = (F.col("key") == F.col("_key")) & (F.col("source_hash") == F.col("_source")) & (F.col("shipped_hash") == F.col("_shipped")) & F.col("mirror")
    found = offered.join(held, same, "left_semi").select("object_id", F.lit(True).alias("settled")).distinct()
    return offered.join(found, "object_id", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))


def reporting(installs: DataFrame, seen: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(install_id, digest, at, newest) of active ``installs`` (install_id, status) that report a catalog, with their place by time, the newest first.

    An install reports if it was ``seen`` (install_id, digest, at) with a digest and a time
    and there is a usable catalog of that digest (``catalogs``: digest, usable); one whose
    catalog is missing or unusable counts as reporting none.
    """
    active = installs.filter("status = 'active'").select("install_id")
    told = seen.filter((F.coalesce("digest", F.lit("")) != "") & F.col("at").isNotNull()).join(active, "install_id", "left_semi")
    return told.join(catalogs.filter("usable").select("digest").distinct(), "digest", "left_semi").select("install_id", "digest", "at")


def support(installs: DataFrame, seen: DataFrame, catalogs: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, supported, unsupported, unknown, text) for each of ``asked`` (source): how many active installs can collect it, can't, and haven't said.

    ``entries`` has (digest, source), what each catalog holds. Installs are counted by
    digest first, so that catalogs are joined once for each digest, not for each install.
    """
    by_digest = reporting(installs, seen, catalogs).groupBy("digest").agg(F.count("*").alias("n"))
    total = by_digest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reporting")).crossJoin(installs.filter("status = 'active'").agg(F.count("*").alias("active")))  # one row
    held = entries.distinct().join(by_digest, "digest").groupBy("source").agg(F.sum("n").alias("n"))
    out = asked.select("source").distinct().join(held, "source", "left").crossJoin(F.broadcast(total))
    supported = F.coalesce("n", F.lit(0))
    counts = out.select("source", F.col("n").isNotNull().alias("known"), supported.alias("supported"), (F.col("reporting") - supported).alias("unsupported"), (F.col("active") - F.col("reporting")).alias("unknown"))
    said = lambda c, one, many: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {one}").otherwise(f" {many}"))
    text = F.concat_ws(
        " · ",
        F.when(F.col("known"), F.concat(said("supported", "install reports", "installs report"), F.lit(" it can collect this source"))).otherwise("Not reported by any install"),
        F.when(F.col("known") & (F.col("unsupported") > 0), F.concat(said("unsupported", "reports", "report"), F.lit(" it cannot"))),
        F.when(F.col("unknown") > 0, F.concat(said("unknown", "install has", "installs have"), F.lit(" not reported what it can collect"))),
    )
    return counts.select("source", "supported", "unsupported", "unknown", text.alias("text"))


def health(reports: DataFrame, faults: DataFrame, installs: DataFrame, now: Column) -> DataFrame:
    """(install_id, status, reported_at, consecutive, faults): what is kept of ``reports`` (install_id, consecutive) and their ``faults`` (install_id, place, kind, at, message).

    A report of an install that isn't active is ``refused``, as is one with a fault
    without a kind; the time is the server's. Of a report's faults the last ``FAULTS`` stay,
    in order, bounded. No report's faults are gathered before they are that few.
    """
    known = reports.join(installs.filter("status = 'active'").select("install_id", F.lit(True).alias("active")), "install_id", "left")
    bare = faults.withColumn("kind", bounded(F.coalesce("kind", F.lit("")), FACT))
    odd = bare.filter("kind = ''").select("install_id", F.lit(True).alias("odd")).distinct()
    last = bare.withColumn("_rank", F.row_number().over(Window.partitionBy("install_id").orderBy(F.desc("place")))).filter(F.col("_rank") <= FAULTS)
    entry = F.struct("place", "kind", bounded(F.coalesce("at", F.lit("")), FACT).alias("at"), bounded(F.coalesce("message", F.lit("")), MESSAGE).alias("message"))
    kept = last.groupBy("install_id").agg(F.array_sort(F.collect_list(entry)).alias("faults"))
    both = known.join(odd, "install_id", "left").join(kept, "install_id", "left")
    status = F.when(F.col("active").isNull(), "refused: no such active install").when(F.col("odd"), "refused: a fault without a kind").otherwise("stored")
    good = status == "stored"
    return both.select("install_id", status.alias("status"), F.when(good, now).alias("reported_at"), F.when(good, F.col("consecutive")).alias("consecutive"), F.when(good, F.coalesce("faults", F.array().cast(kept.schema["faults"].dataType))).alias("faults"))


def last_uploads(probes: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """(host, family, recorded, at, shipped, failed, pending) of ``probes`` (host, family, source_id, pending), from each host's heartbeat document (``heartbeats``: host, document).

    A document that can't be read, or has no time, says nothing of any source.
    """
    kind = "at string, sources array<struct<source_id:string,shipped:bigint,failed:bigint>>"
    read = heartbeats.select("host", F.from_json("document", kind).alias("d")).select("host", F.try_to_timestamp("d.at").alias("at"), "d.sources").filter("at is not null")
    each = read.select("host", F.explode("sources").alias("s")).groupBy("host", "s.source_id").agg(F.last("s").alias("s")).select("host", F.col("source_id"), F.coalesce("s.shipped", F.lit(0)).alias("shipped"), F.coalesce("s.failed", F.lit(0)).alias("failed"))
    both = probes.join(each, ["host", "source_id"], "left").join(read.select("host", "at"), "host", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return both.groupBy("host", "family").agg(F.bool_or(F.col("shipped").isNotNull()).alias("recorded"), F.max("at").alias("at"), total("shipped"), total("failed"), total("pending"))


def surveyed(files: DataFrame) -> DataFrame:
    """(agent, agent_place, dir, place, bytes, pending, last, markers, off) of ``files`` (agent, dir, size, mtime, marker, pending): repositories and agents in the order that a survey shows them.

    Repositories come by the day of their last file, the latest first, then by bytes,
    then by name; agents by their last file. One all of whose files are below a marker is
    ``off``. Places are counted among an agent's repositories and among agents.
    """
    marked = F.coalesce("marker", F.lit("")) != ""
    repos = files.groupBy("agent", "dir").agg(
        F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.col("pending"), F.col("size"))), F.lit(0)).cast("bigint").alias("pending"), F.max("mtime").alias("last"),
        F.array_sort(F.collect_set(F.when(marked, F.col("marker")))).alias("markers"), F.bool_and(marked).alias("off"),
    )
    placed = repos.withColumn("place", F.row_number().over(Window.partitionBy("agent").orderBy(F.to_date("last").desc(), F.desc("bytes"), "dir")))
    agents = repos.groupBy("agent").agg(F.max("last").alias("agent_last"))
    agents = agents.select("agent", F.row_number().over(Window.orderBy(F.desc("agent_last"), "agent")).alias("agent_place"))  # a row for each agent
    return placed.join(agents, "agent").select("agent", "agent_place", "dir", "place", "bytes", "pending", "last", "markers", "off")


def usage_records(sessions: DataFrame, messages: DataFrame, usage: DataFrame, namespace: str) -> DataFrame:
    """(session_id, type, place, record): a session's row, its messages in order of time and id (equal ones by what they hold) and its usage by model, as JSON; what each has is what its table has.

    Usage gets ``usage_id``, a key of the session and of model, provider, base address,
    mode and task; the address itself is left out.
    """
    scope = F.to_json(F.array(*(F.col(c).cast("string") for c in ("model", "billing_provider", "billing_base_url", "billing_mode", "task"))), {"ignoreNullFields": "false"})
    keyed = usage.withColumn("usage_id", session_key(namespace, F.concat("session_id", F.lit("\0"), scope)))
    whole = lambda df, kind, place: df.select("session_id", F.lit(kind).alias("type"), place.cast("bigint").alias("place"), F.to_json(F.struct(*sorted(c for c in df.columns if c not in ("session_id", "billing_base_url")))).alias("record"))
    at = lambda *by: F.row_number().over(Window.partitionBy("session_id").orderBy(*by))
    return (
        whole(sessions, "session", F.lit(1))
        .unionByName(whole(messages, "message", at("timestamp", "id", F.to_json(F.struct(*sorted(messages.columns))))))
        .unionByName(whole(keyed, "usage", at("model", "billing_provider", "billing_base_url", "billing_mode", "task")))
    )


def oldest_first(text: Column) -> Column:
    """Lines that come with the newest first, the other way round; blank ones go."""
    return F.array_join(F.reverse(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")), "\n")
