"""Queries of anchor files, heads of files, and checkouts, on trees made from the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import anchors
from lodestream.plans.registry import query, read


@query(
    """with f as (select page_id, page_id // 7 as k, page_id % 3 as s from pages)
       select page_id, '/home/u+/p ' || k as folder from f where s = 0 and k % 3 = 0
       union all select page_id, '/c/p' || k from f where s = 0 and k % 3 = 1
       union all select page_id, '/q/' || k from f where s = 0 and k % 3 = 1
       union all select page_id, '/run/' || k from f where s = 1 and k % 4 <> 0"""
)
def anchored_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the folders that the anchor of their session names: a workspace of one folder, of several, one elsewhere, or a session's first event."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 7).cast("bigint").alias("k"))
    source = F.when(F.col("page_id") % 3 == 0, "workspace").when(F.col("page_id") % 3 == 1, "session").otherwise("other")
    rel = F.when(F.col("page_id") % 3 == 0, F.format_string("w%d/f%d.json", "k", "page_id")).otherwise(F.format_string("a/s%d/f%d.json", "k", "page_id"))
    files = pages.select(F.col("page_id").alias("key"), source.alias("source_id"), F.lit("/s").alias("root"), rel.alias("rel"))
    own = pages.select("k").distinct()
    said = F.when(F.col("k") % 3 == 0, F.format_string('{"folder": "file:///home/u+/p%%20%d"}', "k")).when(F.col("k") % 3 == 1, F.format_string('{"workspace": "file://localhost/c/d/%d.code-workspace"}', "k")).otherwise('{"folder": "vscode-remote://ssh/x"}')
    listing = F.format_string('{ // "two" folders\n "folders": [ {"path": "../p%d", "name": "// no comment"}, /* and */ {"uri": "file:///q/%d", },\n ], }', "k", "k")
    opened = anchors.opened(own.select(F.format_string("/s/w%d", "k").alias("dir"), said.alias("content")), own.select(F.format_string("/c/d/%d.code-workspace", "k").alias("path"), listing.alias("content")))
    begun = F.format_string('{"type": "session.start", "data": {"cwd": "/run/%d/./x/.."}}', "k")
    started = anchors.started(own.select(F.format_string("/s/a/s%d", "k").alias("dir"), F.when(F.col("k") % 4 == 0, begun).otherwise(F.concat(begun, F.lit("\n{"))).alias("content")), ["cwd", "data.cwd"])
    return anchors.anchored(files, {"workspace": 1, "session": 2}, opened.unionByName(started)).select(F.col("key").alias("page_id"), "folder")


@query(
    """select page_id, case when strlen(html) + case when page_id % 3 = 0 then 65000 else 0 end + strlen('{"payload":{"cwd":" /w/' || page_id || '/ "}}') + 27 <= 65536 then '/w/' || page_id end as cwd from pages"""
)
def probed_cwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The working directory in each file's head: a page's text, lines that don't say it, and one that does, for some of them too far down."""
    said = F.format_string('{"payload":{"cwd":" /w/%d/ "}}', "page_id")
    filler = F.when(F.col("page_id") % 3 == 0, F.repeat(F.lit("x"), F.lit(65000))).otherwise("")
    content = F.concat(F.translate("html", "{", "("), filler, F.lit("\n\n"), F.lit('{"cwd":5}\n{"cwd":"",}\n{"x"'), F.lit("\n"), said, F.lit('\n{"cwd":"/later"}'))
    heads = read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), content.alias("content"))
    return anchors.probed(heads, ["cwd", "payload.cwd"]).select(F.col("path").alias("page_id"), "cwd")


@query(
    """with f as (select page_id, page_id % 50 as j, '/home/u/r' || (page_id % 50) as root from pages),
            c as (select page_id, case when j % 5 < 4 then root end as root, case j % 5 when 0 then root || '/.git' when 1 then '/home/u/main/.git' when 2 then '/x/modules/r' || j end as common from f)
       select page_id, case when common is not null then root end as root, common, case when common like '%/.git' then left(common, length(common) - 5) end as main from c"""
)
def checkout_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with their checkouts: plain ones, worktrees whose pointers lead to the shared folder in two steps, modules, and pointers that lead in a circle."""
    pages = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 50).alias("j"))
    cwds = pages.select(F.col("page_id").alias("key"), F.format_string("/home/u/r%d/src/%d", "j", "page_id").alias("cwd"))
    own = pages.select("j").distinct()
    kind = F.col("j") % 5
    leads = F.when(kind == 1, F.format_string("gitdir: ../main/.git/worktrees/r%d\n", "j")).when(kind == 2, F.format_string("gitdir: /x/modules/r%d", "j")).when(kind == 3, F.lit("gitdir: ./x/../.git"))
    entries = own.filter(kind < 4).select(F.format_string("/home/u/r%d", "j").alias("dir"), leads.alias("content")).unionByName(spark.createDataFrame([("/home/u", None)], "dir string, content string"))
    commons = own.filter(kind == 1).select(F.format_string("/home/u/main/.git/worktrees/r%d", "j").alias("dir"), F.lit("../..\n").alias("content"))
    found = anchors.checkouts(cwds, entries, commons, ceiling="/home/u")
    return found.select(F.col("key").alias("page_id"), "root", "common", "main")
