"""Control-plane rules: trees and markers, configuration layers, ticket checks, bounded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import align, cdc, discover, documents, fleet, jsonl, paths, records
from lodestream.plans.registry import query, read, relational

_TREE = "'/home/u' || (page_id % 5) || '/r' || (page_id % 7) || '/src/f' || page_id"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/home/u"), F.col("page_id") % 5, F.lit("/r"), F.col("page_id") % 7, F.lit("/src/f"), "page_id")
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(
    f"""with f as (select page_id, {_TREE} as path from pages),
          roots as (select '/home/u' || k as dir from range(0, 4) a(k) union all select '/home/u1/r' || k from range(0, 3) b(k))
        select page_id, (select arg_max(dir, length(dir)) from roots where starts_with(path, dir || '/')) as root from f"""
)
def nearest_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest checkout above each file."""
    roots = spark.createDataFrame([(f"/home/u{k}",) for k in range(4)] + [(f"/home/u1/r{k}",) for k in range(3)], "dir string")
    return paths.nearest(_tree(spark, sf_dir), "page_id", "path", roots)


@query(f"select page_id, path from (select page_id, {_TREE} as path from pages) where path not like '/home/u2/%' and path not like '/home/u3/r1/%'")
def marker_opt_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no marker above them takes out."""
    markers = spark.createDataFrame([("/home/u2",), ("/home/u3/r1",)], "dir string")
    return paths.unmarked(_tree(spark, sf_dir), "page_id", "path", markers)


@query("select page_id, right('at …/src/f' || page_id || ' failed', 18) as message from pages")
def telemetry_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with shortened paths, cut at the front."""
    tree = _tree(spark, sf_dir)
    return tree.select("page_id", paths.short_paths(F.concat(F.lit("at "), "path", F.lit(" failed")), 18).alias("message"))


@query("select doc_id, regexp_replace(left(trim(text), 40), '[\\x00-\\x1f\\x7f]', '', 'g') as head from documents")
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts bounded for display: trimmed, cut, control characters dropped."""
    return read(spark, sf_dir, "documents").select("doc_id", paths.bounded(F.col("text"), 40).alias("head"))


relational(
    "ticket_bijection",
    """select coalesce(o.o_orderkey, l.l_orderkey) as object_id, case when o.o_orderkey is null then 'unexpected' when l.l_orderkey is null then 'missing' else 'paired' end as status
       from (select o_orderkey from {orders} where o_orderkey % 3 <> 0) o full outer join (select distinct l_orderkey from {lineitem} where l_orderkey % 4 <> 0) l on l.l_orderkey = o.o_orderkey""",
)
relational(
    "newest_faults",
    """select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from {events} where event_type = 'error') where rn <= 5""",
)
relational(
    "completeness",
    """select d.source, count(l.doc_id) as labelled, count(*) as files, round(cast(100 as double) * count(l.doc_id) / count(*), 3) as percent from {documents} d left join {labels} l on l.doc_id = d.doc_id group by d.source""",
)
relational(
    "duplicate_ids",
    "select o_custkey, count(*) as n from {orders} group by o_custkey having count(*) > 1",
)


@query("select s_suppkey, sha256(length(s_name) || ':' || s_name || length(cast(s_nationkey as varchar)) || ':' || s_nationkey) as fingerprint from supplier")
def spec_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over the length-prefixed fields of a specification."""
    fields = ["s_name", "s_nationkey"]
    text = F.concat(*(x for f in fields for x in (F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string"))))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(text, 256).alias("fingerprint"))


_KEYS = ("cursorAuth/accessToken", "CURSORAUTH.refresh", "cursorAuth/cachedEmail", "cursorauth/stripeMembershipType", "cursorAuth/cachedTeams", "composerData:1", "xcursorauth/y")


@query("select event_id, event_id % 7 in (0, 1, 4) as denied from events")
def denied_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store keys that hold credentials, with their exceptions."""
    key = F.get(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % len(_KEYS)).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", records.key_denied(key).alias("denied"))


@query("select c_custkey, ['ok', 'version', 'targets', 'packs', 'version'][c_custkey % 5 + 1] as failure from customer")
def enforcement_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of a served configuration that doesn't hold: a version that can be read, a target, known packs."""
    k = "c_custkey % 5"
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"if({k} in (1, 4), 9, 2) as version", f"if({k} in (2, 4), 0, 1) as targets", f"if({k} = 3, array('core', 'x'), array('core')) as packs")
    known = F.array(F.lit("core"), F.lit("pii"))
    rules = {"version": F.col("version") > 3, "targets": F.col("targets") == 0, "packs": F.size(F.array_except("packs", known)) > 0}
    return rows.select("c_custkey", documents.first_failure(rules).alias("failure"))


@query("select n_nationkey, case n_nationkey % 4 when 0 then n_name when 1 then 'cached' end as value, ['fetched', 'cached', 'expired', 'none'][n_nationkey % 4 + 1] as origin from nation")
def cached_or_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer in force: fetched, else cached while it lasts."""
    k = F.col("n_nationkey") % 4
    layer = fleet.layer_in_force(F.when(k == 0, F.col("n_name")), F.when(k < 3, F.lit("cached")), F.when(k == 2, 900).otherwise(10), 600)
    return read(spark, sf_dir, "nation").select("n_nationkey", layer.alias("x")).select("n_nationkey", "x.value", "x.origin")


@query(
    """select rule, cast(sum(n) as bigint) as hits, count(*) as files from (
         select 'email' as rule, 1 as n from conversations union all select 'key-name', 1 from conversations where turn % 2 = 0 union all select 'path-user', 1 from conversations where turn % 3 = 0) group by rule"""
)
def rule_hit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule hits of scrubbed lines, added up."""
    line = """concat('{"to":"u', conv_id, '@mail.example.org"', if(turn % 2 = 0, ',"password":"p"', ''), if(turn % 3 = 0, ',"cwd":"/home/jane/x /home/jane"', ''), '}')"""
    rows = read(spark, sf_dir, "conversations").selectExpr("conv_id", f"{line} as line")
    hits = jsonl.scrub(rows, "conv_id", "line", user="jane").select(F.explode("rule_hits").alias("rule", "n"))
    return hits.groupBy("rule").agg(F.sum("n").alias("hits"), F.count("*").alias("files"))


@query("select doc_id, doc_id % 4 = 1 as skipped from documents")
def parked_backoff_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parked files that wait: not after their time, nor where a new snapshot is there."""
    rows = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id % 4 > 0 as parked", "if(doc_id % 4 = 2, 90, 110) as backoff_until", "100 as now", "doc_id % 4 = 3 as new_snapshot", "1 as size", "2 as was_size", "1 as mtime", "1 as was_mtime", "'h' as was_hash",
        "'p' as path", "'p' as was_path", "true as policy_met",
    )
    return rows.select("doc_id", (cdc.before_reading() == "skipped").alias("skipped"))


@query("select o_orderkey, [true, true, false, false, false][o_orderkey % 5 + 1] as satisfied from orders")
def policy_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file needs no sending anew under the policy in force."""
    k = F.col("o_orderkey") % 5
    sealed = F.when(k == 1, "now").when(k == 2, "before").when(k == 3, "").otherwise(F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", cdc.policy_met(k > 0, F.when(k == 3, "").otherwise("now"), sealed).alias("satisfied"))


_NAMES = (("Shell", "run_terminal_command_v2", True), ("StrReplace", "search_replace", True), ("Write", "create_file_v2", True), ("Read", "read_file_v2", True), ("Shell", "edit_file_v2", False), ("CallMcpTool", "mcp_x_y", True), ("CallMcpTool", "run", False), ("", "x", True), ("Grep", None, True), ("Write", "edit_file", False))


@query(f"select p_partkey, [{', '.join(str(ok).lower() for *_, ok in _NAMES)}][p_partkey % {len(_NAMES)} + 1] as compatible from part")
def tool_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool names of transcripts and of the side store that may be one tool."""
    pick = lambda k: F.get(F.array(*(F.lit(x[k]) for x in _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", align.names_match(pick(0), pick(1)).alias("compatible"))


@query(
    """with r as (select conv_id, turn from conversations where turn % 7 <> 6)
       select conv_id, conv_id || '-' || turn as row_id, row_number() over (partition by conv_id order by case when conv_id % 3 = 0 then -turn else turn end) as place
       from (select * from r where conv_id % 3 <> 1 union all select conv_id, turn from conversations where conv_id % 3 = 1)"""
)
def bubble_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows as their conversation's headers list them, else as it holds them itself, else by time."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("row_id")).distinct()
    rows = turns.filter("turn % 7 <> 6 and conv_id % 3 <> 1").select("conv_id", "row_id", F.format_string("%08d", "turn").alias("created"))
    headers = turns.filter("conv_id % 3 = 0").select("conv_id", F.negate("turn").cast("bigint").alias("pos"), "row_id")
    inline = turns.filter("conv_id % 3 = 1").select("conv_id", F.col("turn").cast("bigint").alias("pos"), "row_id")
    return align.ordered_rows(headers, inline, rows)


@query(
    """with t as (select conv_id, turn, turn % 5 <> 3 as kept, max(case when turn % 5 <> 3 then turn end) over (partition by conv_id) as last from conversations)
       select status, count(*) as n from (select case when kept then 'matched' when last is not null and turn > last then 'tail' else 'mismatch' end as status from t) group by status"""
)
def enrich_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by what became of them in the alignment."""
    from lodestream.plans.text import align_transcript

    return align_transcript(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("select f.family, string_agg(distinct f.path, ',' order by f.path) as paths from (select 'f' || (n_nationkey % 3) as family, 'p' || n_regionkey as path from nation union all select '*', 'version') f group by f.family")
def exemption_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exempt paths by family, united over layers."""
    layers = read(spark, sf_dir, "nation").selectExpr("concat('f', n_nationkey % 3) as family", "array(concat('p', n_regionkey)) as paths").unionByName(spark.sql("select '*' as family, array('version') as paths"))
    return fleet.merged_sets(layers, "family", "paths").select("family", F.array_join("paths", ",").alias("paths"))


@query(
    """with c as (select page_id % 20 as source, page_id as place, '/r' || page_id as root, case when page_id % 5 = 0 then 'unset variable' when page_id % 7 = 0 then 'denied' when page_id % 3 = 0 then 'absent' when page_id % 4 = 1 then 'no such folder in it' end as why from pages),
            p as (select source, min(place) filter (why is null) as first from c group by source)
       select p.source, '/r' || p.first as root, count(case when why = 'denied' then 1 end) as denied, count(why) as refused
       from p left join c on c.source = p.source and why is not null and (p.first is null or place < p.first) group by p.source, p.first"""
)
def root_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first root of each source that can be used, and how many before it were refused."""
    k = "page_id"
    candidates = read(spark, sf_dir, "pages").selectExpr(f"{k} % 20 as source", f"{k} as place", f"concat('/r', {k}) as root", f"{k} % 5 <> 0 as expands", f"{k} % 3 <> 0 as exists", f"{k} % 7 = 0 as denied", f"{k} % 4 <> 1 as fits")
    found = discover.pick_root(candidates, "source")
    total = F.aggregate(F.coalesce(F.map_values("reasons"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select("source", "root", F.coalesce(F.try_element_at("reasons", F.lit("denied")), F.lit(0)).alias("denied"), total.alias("refused"))


@query("select n_nationkey, [true, false, true, false, false, true, false][n_nationkey % 7 + 1] as enabled from nation")
def source_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as they are in force: default, served override, local veto."""
    k = F.col("n_nationkey") % 7
    default = k.isin(0, 1, 4, 5)
    served = F.when(k == 1, False).when(k == 2, True).when(k == 4, True)
    local = F.when(k.isin(4, 6), False).when(k.isin(3, 5), True)
    return read(spark, sf_dir, "nation").select("n_nationkey", fleet.enabled(default, served, local).alias("enabled"))


@query(
    """with t as (select conv_id, turn, turn % 5 <> 3 as kept, max(case when turn % 5 <> 3 then turn end) over (partition by conv_id) as last from conversations)
       select conv_id, count(case when not kept and last is not null and turn > last then 1 end) as tail, count(case when not kept and (last is null or turn < last) then 1 end) as mismatch from t group by conv_id"""
)
def shortfall_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each conversation that the store lacks: at its end, and between."""
    from lodestream.plans.text import align_transcript

    n = lambda s: F.count_if(F.col("status") == s)
    return align_transcript(spark, sf_dir).groupBy("conv_id").agg(n("tail").alias("tail"), n("mismatch").alias("mismatch"))
