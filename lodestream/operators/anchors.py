"""Where a session ran: anchor files beside it, heads of its own file, and the checkout that governs a folder.

Files are given as tables of paths and contents, as ``binaryFile`` or a listing yields
them; nothing is opened here. All joins are equality joins on paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.detect import clean_path
from lodestream.operators.paths import ancestors

#: Bytes of a file's head that are asked for a working directory.
HEAD_BYTES = 64 << 10
#: Pointers that are followed from a checkout to where its history lies.
HOPS = 4

_STRING = r'("(?:[^"\\]|\\[\s\S])*+(?:"|\z))'


def json_of(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON. Strings are left as they are; what follows an open comment is dropped."""
    bare = F.regexp_replace(text, _STRING + r"|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, _STRING + r"|,(?=\s*[}\]])", "$1")


def local_path(uri: Column) -> Column:
    """A file URI as a path of this machine; null for other schemes, other hosts, an empty path, and escapes that are none."""
    found = F.regexp_extract(uri, r"^(?i:file)://([^/?#]*)(/[^?#]*)", 0) != ""
    host = F.lower(F.regexp_extract(uri, r"^(?i:file)://([^/?#]*)(/[^?#]*)", 1))
    path = F.try_url_decode(F.replace(F.regexp_extract(uri, r"^(?i:file)://([^/?#]*)(/[^?#]*)", 2), F.lit("+"), F.lit("%2B")))
    return F.when(found & host.isin("", "localhost"), F.regexp_replace(path, "^/(?=[A-Za-z]:)", ""))


def resolved(path: Column, base: Column) -> Column:
    """A path from a file in folder ``base``, cleaned; null of an empty one and of the root itself."""
    bare = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    drive = bare.rlike("^[A-Za-z]:/")
    whole = F.when(F.startswith(bare, F.lit("/")) | drive, bare).otherwise(F.concat(base, F.lit("/"), bare))
    clean = clean_path(whole)
    return F.when((bare != "") & (clean != ""), F.when(whole.rlike("^[A-Za-z]:/"), clean).otherwise(F.concat(F.lit("/"), clean)))


def text_field(record: Column, field: str) -> Column:
    """A dotted field of a JSON record (a variant), if it is a text that isn't empty."""
    at = "$" + "".join(f".{p}" for p in field.split("."))
    found = F.try_variant_get(record, at, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.try_variant_get(record, at, "string"), F.lit("")))


def probed(heads: DataFrame, fields: list[str]) -> DataFrame:
    """(path, cwd) of ``heads`` (path, content): the first of ``fields`` that the first line with one has, cleaned; null if the first ``HEAD_BYTES`` have none.

    Lines that aren't JSON are passed over.
    """
    head = F.make_valid_utf8(F.substr(F.encode("content", "UTF-8"), F.lit(1), F.lit(HEAD_BYTES)).cast("string"))
    lines = heads.select("path", F.posexplode_outer(F.split(head, "\n")).alias("n", "line")).filter(F.contains("line", F.lit("{")))
    record = lines.withColumn("record", F.try_parse_json("line"))
    said = record.select("path", "n", F.coalesce(*(text_field(F.col("record"), f) for f in fields)).alias("cwd")).filter("cwd is not null")
    first = said.groupBy("path").agg(F.min_by("cwd", "n").alias("cwd"))
    return heads.select("path").distinct().join(first, "path", "left").select("path", resolved(F.col("cwd"), F.lit("")).alias("cwd"))


def started(anchors: DataFrame, fields: list[str]) -> DataFrame:
    """(dir, folder) of session folders with an event log (dir, content): a field of the first line, once that line is whole."""
    line = F.when(F.contains("content", F.lit("\n")), F.substring_index("content", "\n", 1))
    record = anchors.select("dir", F.try_parse_json(line).alias("record"))
    return record.select("dir", resolved(F.coalesce(*(text_field(F.col("record"), f) for f in fields)), F.lit("")).alias("folder")).filter("folder is not null")


def opened(anchors: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(dir, folder) of workspace folders with a workspace file (dir, content): its one folder, or each folder that the file listing several (``workspaces``: path, content) has.

    Folders of other machines name nothing.
    """
    record = anchors.select("dir", F.try_parse_json("content").alias("record"))
    folder, listing = text_field(F.col("record"), "folder"), text_field(F.col("record"), "workspace")
    one = record.select("dir", resolved(local_path(folder), F.lit("")).alias("folder"))
    listed = record.filter(folder.isNull()).select("dir", local_path(listing).alias("path")).filter("path is not null").join(workspaces, "path")
    parsed = F.from_json(json_of(F.col("content")), "folders array<struct<path:string,uri:string>>")
    each = listed.select("dir", F.regexp_replace("path", "/[^/]*$", "").alias("base"), F.explode(parsed["folders"]).alias("f"))
    uri = F.nullif(F.col("f.uri"), F.lit(""))
    many = each.select("dir", F.when(uri.isNotNull(), resolved(local_path(uri), F.lit(""))).otherwise(resolved(F.col("f.path"), F.col("base"))).alias("folder"))
    return one.unionByName(many).filter("folder is not null").distinct()


def anchored(files: DataFrame, depths: dict[str, int], folders: DataFrame) -> DataFrame:
    """(key, folder) of ``files`` (key, source_id, root, rel): each folder of the anchor in the session folder, so many segments below the root as ``depths`` says of the source.

    ``folders`` has (dir, folder). A file not below such a folder, or that climbs, has none.
    """
    depth = F.coalesce(*(F.when(F.col("source_id") == s, F.lit(n)) for s, n in depths.items()))
    parts = F.split(F.replace("rel", F.lit("\\"), F.lit("/")), "/")
    head = F.slice(parts, 1, F.col("depth"))
    placed = files.select("*", depth.alias("depth")).filter("depth is not null").filter((F.size(parts) > F.col("depth")) & ~F.array_contains(head, ".."))
    at = placed.select("key", F.concat("root", F.lit("/"), F.array_join(head, "/")).alias("dir"))
    return at.join(folders, "dir").select("key", "folder").distinct()


def single(folders: DataFrame) -> DataFrame:
    """(key, cwd): the working directory of files with one folder; those with several have none."""
    return folders.groupBy("key").agg(F.count("*").alias("n"), F.first("folder").alias("cwd")).filter("n = 1").select("key", "cwd")


def pointer(content: Column, prefix: str, base: Column) -> Column:
    """Where a pointer file leads: what follows ``prefix``, from ``base``; null if it leads nowhere."""
    bare = F.trim(F.regexp_replace(content, r"^\s+|\s+$", ""))
    return F.when(F.startswith(bare, F.lit(prefix)), resolved(F.substr(bare, F.lit(len(prefix) + 1)), base))


def followed(starts: DataFrame, pointers: DataFrame, hops: int = HOPS) -> DataFrame:
    """(key, end) of ``starts`` (key, at): where a chain of ``pointers`` (at, to: one row for each ``at``) ends. A circle, a pointer that leads nowhere and a chain of more than ``hops`` have no end.

    Each round is one equality join of the keys that still move.
    """
    leads = pointers.select(F.col("at").alias("_from"), F.coalesce("to", F.lit("")).alias("_to"))
    now = starts.select("key", "at", F.array("at").alias("seen"))
    ends = []
    for _ in range(hops + 1):
        step = now.join(leads, now["at"] == leads["_from"], "left")
        ends.append(step.filter("_to is null").select("key", F.col("at").alias("end")))
        now = step.filter((F.col("_to") != "") & ~F.array_contains("seen", F.col("_to"))).select("key", F.col("_to").alias("at"), F.array_append("seen", F.col("_to")).alias("seen"))
    found = reduce(DataFrame.unionByName, ends)
    return starts.select("key").join(found, "key", "left")


def checkouts(cwds: DataFrame, entries: DataFrame, commons: DataFrame, ceiling: str = "") -> DataFrame:
    """(key, root, common, main) of ``cwds`` (key, cwd): the nearest folder from it up that has a ``.git``, below ``ceiling``.

    ``entries`` has (dir, content) of each ``.git``, content null where it is a folder; a
    file leads to the checkout's own folder, and ``commons`` (dir, content: what its
    ``commondir`` says) from there to the one that all worktrees share. ``main`` is the
    checkout that holds it, null of a bare one. A pointer that leads nowhere leaves the
    folder without a checkout, even if one lies above.
    """
    up = cwds.filter(F.startswith("cwd", F.lit("/"))).select("key", "cwd", F.explode(F.concat(F.array(F.struct(F.lit(1 << 30).alias("depth"), F.col("cwd").alias("dir"))), ancestors(F.col("cwd")))).alias("a"))
    if ceiling:
        up = up.filter(F.startswith("a.dir", F.lit(ceiling + "/")) | ~F.startswith(F.concat("cwd", F.lit("/")), F.lit(ceiling + "/")))
    met = up.select("key", "a.depth", "a.dir").join(entries.select("dir").distinct(), "dir").groupBy("key").agg(F.max_by("dir", "depth").alias("root"))
    files = entries.filter("content is not null").select(F.concat("dir", F.lit("/.git")).alias("at"), pointer(F.col("content"), "gitdir:", F.col("dir")).alias("to"))
    shared = commons.select(F.col("dir").alias("at"), pointer(F.col("content"), "", F.col("dir")).alias("to"))
    ends = followed(met.select("key", F.concat("root", F.lit("/.git")).alias("at")), files.unionByName(shared.filter("to is not null")).dropDuplicates(["at"]))
    both = met.join(ends.filter("end is not null"), "key").select("key", "root", F.col("end").alias("common"))
    main = F.when(F.col("common").rlike("/\\.git$"), F.regexp_replace("common", "/\\.git$", ""))
    return cwds.select("key").join(both, "key", "left").select("key", "root", "common", main.alias("main"))
