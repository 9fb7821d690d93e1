"""What settings mean: templates of paths, roots, schedules, patterns, pauses, and identities, as expressions over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.detect import clean_path

#: A tick where none is set, and the shortest one, in nanoseconds.
DEFAULT_TICK, LEAST_TICK = 15 * 60 * 10**9, 60 * 10**9
#: The wait before a run that goes on with what the last one left, in seconds.
CATCH_UP = 15

_VARIABLE = r"\$(?:\{([^}]*)\}|([A-Za-z0-9_]+))"
_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def expanded(template: Column, env: Column, home: Column) -> Column:
    """A root's template as a path: variables of ``env`` (a map) put in, ``~`` at its begin as ``home``, and cleaned.

    Null if a variable is unset or empty, or the result isn't absolute. What a variable
    holds isn't looked at again.
    """
    names = F.transform(F.regexp_extract_all(template, F.lit(_VARIABLE), F.lit(0)), lambda v: F.regexp_replace(v, r"^\$\{?|\}$", ""))
    values = F.transform(names, lambda n: F.nullif(F.element_at(env, n), F.lit("")))
    between = F.split(template, _VARIABLE, -1)
    # null wherever a variable is unset
    filled = F.aggregate(F.arrays_zip(between.alias("text"), values.alias("value")), F.lit(""), lambda done, x: F.concat(done, x["text"], F.coalesce(x["value"], F.lit(""))))
    unset = F.exists(values, lambda v: v.isNull())
    whole = F.when(F.startswith(filled, F.lit("~")), F.concat(home, F.substr(filled, F.lit(2)))).otherwise(filled)
    return F.when(~F.coalesce(unset, F.lit(True)) & F.startswith(whole, F.lit("/")), F.concat(F.lit("/"), clean_path(whole)))


def picked(sources: DataFrame, candidates: DataFrame, env: DataFrame, existing: DataFrame) -> DataFrame:
    """(host, source, root, found, reasons): the roots of ``sources`` (host, source, enabled, root), absent ones picked anew.

    A root that is there stays, so that what was read from it isn't read from elsewhere.
    An absent one of an enabled source is the first of its ``candidates`` (source, rank,
    template) that expands by its host's ``env`` (host, env, home) and is in ``existing``
    (host, path); ``reasons`` says why the others weren't, in order.
    """
    absent = sources.filter(F.col("enabled") & (F.coalesce("root", F.lit("")) == "")).select("host", "source")
    asked = absent.join(candidates, "source").join(env, "host").select("host", "source", "rank", "template", expanded(F.col("template"), F.col("env"), F.col("home")).alias("path"))
    there = existing.select("host", "path", F.lit(True).alias("there")).distinct()
    known = asked.join(there, ["host", "path"], "left")
    why = F.when(F.col("path").isNull(), F.concat(F.lit("root "), "template", F.lit(" does not expand"))).when(F.col("there").isNull(), F.concat("path", F.lit(" does not exist")))
    best = known.withColumn("why", why).groupBy("host", "source").agg(
        F.min(F.when(F.col("why").isNull(), F.struct("rank", "path"))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("rank", "why")))).alias("whys")
    )
    reasons = F.when(F.col("first").isNull(), F.array_join(F.transform("whys", lambda w: w["why"]), "; "))
    out = sources.join(best, ["host", "source"], "left")
    root = F.coalesce(F.nullif("root", F.lit("")), F.col("first.path"))
    return out.select("host", "source", root.alias("root"), F.col("first").isNotNull().alias("found"), reasons.alias("reasons"))


def tick(schedule: Column) -> Column:
    """(nanoseconds, warning) of a schedule such as ``1h30m`` or ``90s``: the default for none and, with a warning, for a bad one; never under the least."""
    bare = F.trim(F.coalesce(schedule, F.lit("")))
    unit = "|".join(sorted(_UNITS, key=len, reverse=True))
    part = rf"([0-9]*\.?[0-9]*)({unit})"
    good = bare.rlike(rf"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:{unit}))+$") | bare.rlike("^[+-]?0$")
    numbers, units = (F.regexp_extract_all(bare, F.lit(part), F.lit(k)) for k in (1, 2))
    worth = F.create_map(*(F.lit(x) for pair in _UNITS.items() for x in pair))
    each = F.zip_with(numbers, units, lambda n, u: F.try_to_number(n, F.lit("999999999999.999999999")).cast("decimal(30,9)") * F.element_at(worth, u))
    size = F.floor(F.aggregate(each, F.lit(0).cast("decimal(38,9)"), lambda a, b: (a + F.coalesce(b, F.lit(0))).cast("decimal(38,9)"))).cast("bigint")
    value = F.when(F.startswith(bare, F.lit("-")), -size).otherwise(size)
    warned = lambda why: F.concat(F.lit('mode.schedule "'), schedule, F.lit(f'"{why}'))
    return (
        F.when(bare == "", F.struct(F.lit(DEFAULT_TICK).alias("ns"), F.lit(None).cast("string").alias("warning")))
        .when(~good, F.struct(F.lit(DEFAULT_TICK).alias("ns"), warned(": not a duration like \"5m\", ticking every 15m0s instead").alias("warning")))
        .when(value <= 0, F.struct(F.lit(DEFAULT_TICK).alias("ns"), warned(": a tick interval must be positive, ticking every 15m0s instead").alias("warning")))
        .when(value < LEAST_TICK, F.struct(F.lit(LEAST_TICK).alias("ns"), warned(" is under the 1m0s floor, ticking every 1m0s").alias("warning")))
        .otherwise(F.struct(value.alias("ns"), F.lit(None).cast("string").alias("warning")))
    )


def next_wait(failed: Column, truncated: Column, shipped: Column, tick_s: Column) -> Column:
    """Seconds to the next run: a short wait after one that didn't fail, left something and shipped something; else a tick."""
    return F.when(~failed & truncated & (shipped > 0), F.lit(CATCH_UP).cast("bigint")).otherwise(tick_s)


def pattern_fault(pattern: Column) -> Column:
    """Why a pattern can't be added to what a source leaves out; null if it can.

    It must be relative to the source's root, with forward slashes, without empty and dot
    segments, and a valid glob: classes that are closed, not empty and of whole ranges,
    and braces in pairs.
    """
    p = F.coalesce(pattern, F.lit(""))
    bare = F.regexp_replace(p, r"\[[!^]?(?:[^\]\-](?:-[^\]\-])?)+\]", "c")
    depth = F.aggregate(F.split(F.regexp_replace(bare, r"[^{}]", ""), ""), F.lit(0), lambda d, c: F.when((d < 0) | ((c == "}") & (d == 0)), -1).when(c == "{", d + 1).when(c == "}", d - 1).otherwise(d))
    segments = F.split(p, "/")
    return (
        F.when(F.contains(p, F.lit("\\")), "backslash")
        .when((p == "") | p.rlike(r"^[/~$]") | p.rlike(r"^(?s).:") | F.contains(p, F.lit("\0")), "not relative")
        .when(F.exists(segments, lambda x: x.isin("", ".", "..")), "empty or dot segment")
        .when(F.contains(bare, F.lit("[")) | (depth != 0), "not a glob")
    )


def paused(flag: Column, now: Column) -> Column:
    """(paused, reason) of a pause flag's JSON: none isn't paused; one that can't be read is; one past its end isn't."""
    read = F.from_json(flag, "paused boolean, reason string, at string, until string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    until = F.try_to_timestamp(read["until"])
    torn = read.isNull() | read["_bad"].isNotNull()
    yes = lambda reason: F.struct(F.lit(True).alias("paused"), reason.alias("reason"))
    no = F.struct(F.lit(False).alias("paused"), F.lit(None).cast("string").alias("reason"))
    return F.when(flag.isNull(), no).when(torn, yes(F.lit("the pause flag exists but could not be parsed"))).when(until.isNotNull() & (now >= until), no).otherwise(yes(read["reason"]))


def identity(rel: Column, pattern: str, template: str) -> Column:
    """The identity that a path has: what ``pattern`` (a regular expression) captures in it, put into ``template`` (``$1``, ``${name}``); empty if it doesn't match."""
    return F.when(rel.rlike(pattern), F.regexp_replace(F.regexp_extract(rel, f"(?:{pattern})", 0), pattern, template)).otherwise("")


def catalog(specs: DataFrame) -> DataFrame:
    """(family, id, ...) of the sources of ``specs`` (family, sources: an array of structs with ``id``), in order of id. An id that is there twice, and a source without one, end the job."""
    each = specs.select("family", F.explode("sources").alias("s")).select("family", "s.*")
    at = Window.partitionBy("id")
    told = each.withColumn("_n", F.count("*").over(at)).withColumn("_families", F.array_sort(F.collect_list("family").over(at)))
    fault = F.when(F.coalesce("id", F.lit("")) == "", F.concat(F.lit("catalog: a source of family "), "family", F.lit(" has no id"))).when(
        F.col("_n") > 1, F.concat(F.lit('catalog: source id "'), "id", F.lit('" declared twice (family '), F.array_join("_families", " and "), F.lit(")"))
    )
    return told.withColumn("id", F.when(fault.isNull(), F.col("id")).otherwise(F.raise_error(fault).cast("string"))).drop("_n", "_families").orderBy("id")


def first_fault(faults: dict[str, Column]) -> Column:
    """The name of the first fault that holds; null if none does."""
    return reduce(lambda rest, f: F.when(f[1], f[0]).otherwise(rest), reversed(list(faults.items())), F.lit(None).cast("string"))


def resolved(entries: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """What layers of settings make together, and the hosts whose layers are refused.

    ``entries`` has (host, rank, local, field, value: array of texts), a row for each field
    that a layer sets; ``kinds`` says of each field how layers combine: ``last`` (the
    highest layer's value), ``union`` (all values, those of lower layers first), ``off``
    (as ``last``, but a layer that isn't the machine owner's may only turn it off),
    ``local`` (the machine owner's layers alone), ``remote`` (others alone). The first
    entry, by layer and then by name, that may not be refuses its host's whole
    configuration: (host, field, rank, reason). The rest is (host, field, value, origin),
    the origin being the highest layer that said something.
    """
    kind = F.coalesce(*(F.when(F.col("field") == f, F.lit(k)) for f, k in kinds.items()))
    told = entries.withColumn("kind", kind)
    fault = first_fault(
        {
            "no such setting": F.col("kind").isNull(),
            "machine-owner only": (F.col("kind") == "local") & ~F.col("local"),
            "served by the control plane only": (F.col("kind") == "remote") & F.col("local"),
            "may be turned off but never on": (F.col("kind") == "off") & ~F.col("local") & (F.get("value", F.lit(0)) == "true"),
        }
    )
    refused = told.withColumn("reason", fault).filter("reason is not null").groupBy("host").agg(F.min(F.struct("rank", "field", "reason")).alias("f")).select("host", "f.field", "f.rank", "f.reason")
    said = told.join(refused.select("host"), "host", "left_anti").filter(F.size("value") > 0)
    # A few layers for each field.
    merged = said.groupBy("host", "field", "kind").agg(F.max("rank").alias("origin"), F.max_by("value", "rank").alias("last"), F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("all"))
    union = F.array_distinct(F.flatten(F.transform("all", lambda x: x["value"])))
    return merged.select("host", "field", F.when(F.col("kind") == "union", union).otherwise(F.col("last")).alias("value"), "origin"), refused
