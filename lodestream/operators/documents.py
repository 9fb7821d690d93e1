"""What surrounds an object in the archive: visible metadata, output names, remembered state, audit lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The manifest fields that may be seen beside a sealed object, and the names that they have there.
VISIBLE = {
    "manifest_version": "manifest-version", "source_id": "source-id", "source_hash": "source-hash", "shipped_hash": "shipped-hash", "artifact_class": "artifact-class",
    "agent_version": "agent-version", "shape_sniff": "shape-sniff", "derived": "derived", "enrich_status": "enrich-status",
}
#: Bytes of an audit reason, and the version of the state's layout.
REASON_BYTES, STATE_VERSION = 500, 1


def object_metadata(have: list[str]) -> Column:
    """The visible fields among the columns ``have`` as a JSON object of texts; empty ones are left out. No path is ever visible."""
    shown = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).alias(name) for c, name in VISIBLE.items() if c in have]
    return F.to_json(F.struct(*shown))


def claimed(rows: DataFrame, key: str, name: str, tag: str) -> DataFrame:
    """(key, output, failed): of equal names the first by key has it, each later one ``name~tag`` with eight letters of its own tag; if that is taken as well it has none and failed."""
    rn = F.row_number().over(Window.partitionBy(name).orderBy(key))
    placed = rows.select(key, name, tag).withColumn("rn", rn)
    later = placed.filter("rn > 1").withColumn("alt", F.concat(name, F.lit("~"), F.left(tag, F.lit(8))))
    later = later.withColumn("alt_rn", F.row_number().over(Window.partitionBy("alt").orderBy(key)))
    late = later.select(key, F.when(F.col("alt_rn") == 1, F.col("alt")).alias("output"), (F.col("alt_rn") > 1).alias("failed"))
    return placed.filter("rn = 1").select(key, F.col(name).alias("output"), F.lit(False).alias("failed")).unionByName(late)


def windows_fault(name: Column) -> Column:
    """Whether Windows takes no file of that name: a character that it reserves, a dot or blank at the end, a device's name."""
    return name.rlike(r'[<>:"|?*\p{Cc}]|[. ]$') | name.rlike(r"(?i)^(?:con|prn|aux|nul|com[0-9]|lpt[0-9]) *(?:\..*)?$")


def safe_path(native: Column, windows: bool = False) -> Column:
    """A path of any system as one below a folder: slashes, no empty or dot segments, a drive as its letter. Null if it climbs, holds a NUL or is empty, or, for ``windows``, if a segment can't be a name there."""
    parts = F.filter(F.split(F.replace(native, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    first = F.get(parts, F.lit(0))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    led = F.when(first.rlike("^[A-Za-z]:$"), F.left(first, F.lit(1))).otherwise(first)
    whole = F.concat(F.array(led), rest)
    bad = F.array_contains(parts, "..") | F.contains(native, F.lit("\0")) | (F.size(parts) == 0)
    if windows:
        bad = bad | F.exists(whole, windows_fault)
    return F.when(~bad, F.array_join(whole, "/"))


def audit_reason(reason: Column) -> Column:
    """A reason fit for the audit log: one line, cut after 500 bytes at a whole character, withheld if it holds a sentinel."""
    line = F.translate(reason, "\n\r", "  ")
    raw = F.encode(line, "UTF-8")
    cut = F.make_valid_utf8(F.substr(raw, F.lit(1), F.lit(REASON_BYTES)).cast("string"))
    short = F.when(F.octet_length(line) > REASON_BYTES, F.concat(F.regexp_replace(cut, "�+$", ""), F.lit("…(truncated)"))).otherwise(line)
    return F.when(F.contains(line, F.lit("__REDACTED:")), "(reason withheld: contained payload-derived text)").otherwise(short)


def checksums(state: DataFrame, by: str) -> DataFrame:
    """(by, version, rows, checksum) of a state table: the sums, modulo 2**60, of quarters of its rows' SHA-256 over their JSON with columns in order of name.

    It doesn't depend on the order of rows, so it is a sum over partitions; equal rows
    count as often as they are there.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(state.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [(F.sum(F.conv(F.substr("h", F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("decimal(38,0)")) % F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint") for k in range(4)]
    text = F.concat(*(F.lpad(F.lower(F.hex(x)), 15, "0") for x in lanes))
    return state.select(by, row.alias("h")).groupBy(by).agg(F.lit(STATE_VERSION).alias("version"), F.count("*").alias("rows"), text.alias("checksum"))


def loaded(state: DataFrame, sums: DataFrame, by: str, attempts: str = "attempts") -> DataFrame:
    """The rows of those documents whose version, row number and checksum are right and that hold no negative ``attempts``; the others count as empty."""
    found = checksums(state, by).withColumnsRenamed({"version": "_v", "rows": "_n", "checksum": "_c"}).drop("_v")
    bad = state.groupBy(by).agg(F.min(attempts).alias("_least"))
    good = sums.filter(F.col("version") == STATE_VERSION).join(found, by).join(bad, by).filter("rows = _n and checksum = _c and coalesce(_least, 0) >= 0")
    return state.join(good.select(by), by, "left_semi")


def resealed(recipients: Column, wanted: Column) -> Column:
    """(recipients, changed): an object's recipients with those of ``wanted`` that it lacks, in their order; unchanged if it lacks none."""
    missing = F.array_except(wanted, recipients)
    return F.struct(F.concat(recipients, missing).alias("recipients"), (F.size(missing) > 0).alias("changed"))


def heartbeat(outcomes: DataFrame, by: str) -> DataFrame:
    """(by, document): one JSON document for each source with counts by decision, bytes shipped and the newest time."""
    n = lambda d: F.count_if(F.col("decision") == d)
    shipped = F.col("decision").isin("new", "changed", "shrunk")
    fields = {"files": F.count("*"), "new": n("new"), "unchanged": n("unchanged"), "parked": n("parked"), "shipped_bytes": F.coalesce(F.sum(F.when(shipped, F.col("size"))), F.lit(0)).cast("bigint")}
    return outcomes.groupBy(by).agg(*(v.alias(k) for k, v in fields.items())).select(by, F.to_json(F.struct(*fields)).alias("document"))


def first_failure(rules: dict[str, Column], good: str = "ok") -> Column:
    """The name of the first rule that holds, in the order given; a rule that is null doesn't hold."""
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(list(rules.items())), F.lit(good))
