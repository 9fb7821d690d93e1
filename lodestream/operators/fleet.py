"""Joins and rules of a fleet's control plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_hosts(installs: DataFrame, install_id: str, imports: DataFrame, import_id: str) -> DataFrame:
    """(install_id, status, import_id): matched by the lower-case first label of ``host``, ambiguous where a label is not unique on both sides."""
    label = F.lower(F.substring_index("host", ".", 1))
    by = Window.partitionBy("label")
    a = installs.withColumn("label", label).withColumn("na", F.count("*").over(by)).select(install_id, "label", "na")
    b = imports.withColumn("label", label).withColumn("nb", F.count("*").over(by)).select(F.col(import_id).alias("_import"), "label", "nb")
    single = (F.col("na") == 1) & (F.col("nb") == 1)
    status = F.when(F.col("nb").isNull(), "unmatched").when(single, "matched").otherwise("ambiguous")
    return a.join(b, "label", "left").select(install_id, status.alias("status"), F.when(single, F.col("_import")).alias("import_id"))


def paired(objects: DataFrame, tickets: DataFrame, key: str) -> DataFrame:
    """(key, status) of each object: ``missing`` without a ticket of its id, ``duplicate`` with several, else ``paired``."""
    held = tickets.groupBy(key).agg(F.count("*").alias("_n"))
    return objects.select(key).join(held, key, "left").select(key, F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("paired").alias("status"))


def served(collection: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """(key, note) of a collection's rows for a build: those that the build knows are served, the others are named as left out."""
    known = build.select(key, F.lit(True).alias("_known")).distinct()
    return collection.select(key).join(known, key, "left").select(key, F.when(F.col("_known"), "served").otherwise("left out: not in this build").alias("note"))


def layer_in_force(fetched: Column, cached: Column, age_s: Column, lasts_s: int) -> Column:
    """(value, origin): the fetched layer, else the cached one while it lasts, else none."""
    usable = cached.isNotNull() & (age_s < lasts_s)
    return F.struct(F.coalesce(fetched, F.when(usable, cached)).alias("value"), F.when(fetched.isNotNull(), "fetched").when(usable, "cached").when(cached.isNotNull(), "expired").otherwise("none").alias("origin"))


def authors(configs: DataFrame, log: DataFrame, key: str, text: str) -> DataFrame:
    """(key, author): who wrote exactly these bytes, by their SHA-256; of several, the last."""
    by_hash = log.groupBy("sha256").agg(F.max_by("author", "at").alias("author"))
    return configs.select(key, F.sha2(text, 256).alias("sha256")).join(by_hash, "sha256", "left").select(key, "author")


#: Findings from the least to the worst.
SEVERITIES = ("ok", "info", "warning", "failure")


def worst(findings: DataFrame, by: str) -> DataFrame:
    """(by, severity, rows): the worst finding of each group; one of an unknown kind counts as a failure."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)), F.lit(len(SEVERITIES)))
    return findings.groupBy(by).agg(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(rank).cast("int")).alias("severity"), F.count("*").alias("rows"))


def enabled(default: Column, served: Column, local: Column) -> Column:
    """Whether a source is read: as served, else by default; what is disabled locally stays so, and can't be enabled locally."""
    return F.when(~local, False).otherwise(F.coalesce(served, default))


def merged_sets(layers: DataFrame, key: str, members: str) -> DataFrame:
    """(key, members): a map of sets, such as exemptions by family: the union of what any layer lists, in order."""
    return layers.select(key, F.explode(members).alias("_m")).groupBy(key).agg(F.array_sort(F.collect_set("_m")).alias(members))


def catalog_counts(reports: DataFrame, active: DataFrame) -> DataFrame:
    """Active installs by source; a source reported twice by an install counts once."""
    return reports.distinct().join(active, "install", "left_semi").groupBy("source_id").agg(F.count("*").alias("installs"))


def merge_layers(rows: DataFrame, field: str, value: str, layer: str, tie: str) -> DataFrame:
    """The value of the highest layer for each field, its layer, and all distinct values in order."""
    last = F.max_by(value, F.struct(layer, tie))
    return rows.groupBy(field).agg(last.alias(value), F.max(layer).alias("origin"), F.array_join(F.array_sort(F.collect_set(value)), ",").alias("all_values"))


def patched(old: Column, patch: Column) -> Column:
    """``old`` with the entries of ``patch``; entries that the patch sets to null go."""
    merged = F.map_zip_with(old, patch, lambda k, a, b: F.when(F.array_contains(F.map_keys(patch), k), b).otherwise(a))
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def batches(rows: DataFrame, key: str, order: list[str], size: str, most: int, bytes_: float) -> DataFrame:
    """``rows`` with ``batch``: greedy packing of a key's rows in order, by count and size; a larger one goes alone."""
    item = F.struct(*order, F.col(size).alias("_size"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("out"))

    def add(done: Column, x: Column) -> Column:
        new = (done["n"] > 0) & ((done["n"] >= most) | (done["total"] + x["_size"] > bytes_))
        batch = done["batch"] + F.when(new, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(new, 1).otherwise(done["n"] + 1).alias("n"), F.when(new, x["_size"]).otherwise(done["total"] + x["_size"]).alias("total"), F.array_append(done["out"], batch).alias("out"))

    zipped = F.explode(F.arrays_zip("items", F.aggregate("items", start, add)["out"].alias("batch")))
    return listed.select(key, zipped.alias("z")).select(key, *(F.col(f"z.items.{c}").alias(c) for c in order), F.col("z.batch").alias("batch"))


def accepted(asked: DataFrame, reported: DataFrame, stored: DataFrame, unverified: DataFrame) -> DataFrame:
    """(doc, at, id) for each document of ``asked`` (doc, at, id): its first entry that nothing accepts; null where all are accepted.

    An entry is accepted if ``reported`` (id) has its id, or the document itself already
    has it (``stored``: doc, id) or confirms it (``unverified``: doc, id). What a document
    holds comes from one union by document and id; only entries left are looked for
    among the reported ones.
    """
    ours = asked.select("doc", "id", "at", F.lit(False).alias("held"))
    theirs = stored.select("doc", "id").unionByName(unverified.select("doc", "id")).select("doc", "id", F.lit(None).cast(asked.schema["at"].dataType).alias("at"), F.lit(True).alias("held"))
    open_ = ours.unionByName(theirs).groupBy("doc", "id").agg(F.min("at").alias("at"), F.max("held").alias("held")).filter("not held and at is not null")
    first = open_.join(reported.select("id").distinct(), "id", "left_anti").groupBy("doc").agg(F.min(F.struct("at", "id")).alias("f"))
    return asked.select("doc").distinct().join(first, "doc", "left").select("doc", "f.at", "f.id")
