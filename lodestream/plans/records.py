"""Queries over records: each makes its lines from a table's keys, and its SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import cdc, discover, documents, records, redaction
from lodestream.plans.registry import query, read


@query(
    """select conv_id, max(case when turn = conv_id % 3 then case conv_id % 4 when 0 then '1.' || conv_id when 1 then '2.' || conv_id when 2 then '3.' || conv_id end end) as version from conversations group by conv_id"""
)
def version_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The producer's version, from the first line that names one in any of the places where it may stand."""
    line = """case when turn <> conv_id % 3 then '{"x":1,"version":""}' when conv_id % 4 = 0 then concat('{"version":"1.', conv_id, '"}') when conv_id % 4 = 1 then concat('{"payload":{"cli_version":"2.', conv_id, '"}}')
        when conv_id % 4 = 2 then concat('{"data":{"copilotVersion":"3.', conv_id, '"}}') else '{"data":{"version":"4"}}' end"""
    lines = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{line} as line")
    return records.producer_version(lines, "conv_id", "turn", "line")


_HEADS = ["unhex('7B7D0A')", "unhex('7B7D0A00')", "unhex('0A7B7D')", "unhex('5B315D0A')", "unhex('7B22612231')", "cast('' as binary)", "unhex('28B52FFD01')", "cast(null as binary)"]


@query(
    """select page_id, ['ok', 'unexpected_shape', 'empty', 'unexpected_shape', 'unexpected_shape', 'empty', 'unexpected_shape', 'unreadable'][page_id % 8 + 1] as jsonl,
         ['ok', 'ok', 'ok', 'ok', 'ok', 'empty', 'unexpected_shape', 'unreadable'][page_id % 8 + 1] as json,
         ['unexpected_shape', 'unexpected_shape', 'unexpected_shape', 'unexpected_shape', 'unexpected_shape', 'empty', 'ok', 'unreadable'][page_id % 8 + 1] as magic,
         ['ok', 'unexpected_shape', 'ok', 'ok', 'ok', 'empty', 'ok', 'unreadable'][page_id % 8 + 1] as text from pages"""
)
def shape_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of files judged as each kind of file."""
    head = f"case page_id % 8 {' '.join(f'when {k} then {h}' for k, h in enumerate(_HEADS))} end"
    heads = read(spark, sf_dir, "pages").selectExpr("page_id", f"{head} as head")
    return heads.select("page_id", *(records.sniff(F.col("head"), kind, "28b52ffd").alias(kind) for kind in ("jsonl", "json", "magic", "text")))


@query(
    """with r as (select source, doc_id, row_number() over (partition by source order by n_chars, doc_id) - 1 as i, count(*) over (partition by source) as n from documents),
            g as (select source, doc_id from r where exists (select 1 from (values (0), (1), (2), (3), (4)) g(k) where i = cast(floor(k * (n - 1) / 4.0) as bigint)))
       select source, case when bool_and(doc_id % 3 <> 0) then 'unexpected_shape' else 'ok' end as shape, count(case when doc_id % 3 <> 0 then 1 end) as failures from g group by source"""
)
def source_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources condemned only where every file of their spread sample fails."""
    grid = discover.sample_grid(read(spark, sf_dir, "documents"), "source", "n_chars", "doc_id", 5)
    samples = grid.selectExpr("source", "doc_id as place", "if(doc_id % 3 = 0, 'ok', 'unexpected_shape') as shape")
    return records.source_sniff(samples, "source")


@query(
    """select o_orderkey, case when o_orderkey % 2 = 0 then '{"a":[{"b":' || o_orderkey || '}],"c":"é"}' else '{ "c" : "é", "a" : 1.50 }' end as value, cast(case when o_orderkey % 2 = 0 then 2 else 0 end as bigint) as changed from orders"""
)
def stripped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key material stripped from JSON at any depth; values without any stay letter by letter."""
    value = """case when o_orderkey % 2 = 0 then concat('{"c":"é", "blobEncryptionKey":{"x":1},"a":[{"speculativeSummarizationEncryptionKey":"k","b":', o_orderkey, '}]}') else '{ "c" : "é", "a" : 1.50 }' end"""
    return records.stripped(read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{value} as value"), "o_orderkey", "value")


@query(
    """select user_id, event_id, '{"at":"2024-01-01T10:' || case when event_id % 2 = 0 then '05' else '06' end || ':00Z","n":[{"v":' || user_id || '}],"note":"2024-01-01"}' as value from events"""
)
def noise_free_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in the form that is compared: no fields that change with every read, times to the minute."""
    value = """concat('{"note":"2024-01-01","as_of":', event_id, ',"at":"2024-01-01T10:05:', if(event_id % 2 = 0, '29.9', '30'), 'Z","n":[{"reset_after_seconds":5,"v":', user_id, '}]}')"""
    rows = read(spark, sf_dir, "events").selectExpr("struct(user_id, event_id) as id", f"{value} as value")
    return records.noise_free(rows, "id", "value").select("id.user_id", "id.event_id", "value")


@query(
    """select o_orderkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) as execution_key from (
         select o_orderkey, sha256(encode('store:message:user') || encode(chr(0)) || encode((o_orderkey % 10) || ':{"a":{"id":1},"b":' || (o_orderkey % 7) || '}')) as h from orders)"""
)
def execution_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of records by time and content: other ids and another order of fields give the same key."""
    data = """if(o_orderkey % 2 = 0, concat('{"id":"', o_orderkey, '","b":', o_orderkey % 7, ',"a":{"id":1}}'), concat('{"a":{"id":1},"parentID":null,"b":', o_orderkey % 7, '}'))"""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 10 as created", f"{data} as data")
    return records.execution_keys(rows, "o_orderkey", F.lit("store:message:user"), F.col("created"), "data")


@query(
    """select l_orderkey, l_linenumber, '/out/' || l_orderkey as path from lineitem where l_linenumber % 4 = 1
       union all select l_orderkey, l_linenumber, '/out/m' || l_orderkey as path from lineitem where l_linenumber % 4 = 2"""
)
def output_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cut-off tool outputs were written to."""
    tool = lambda path, cut: f"""concat('{{"type":"tool","state":{{"metadata":{{"truncated":{cut},"outputPath":"{path}', l_orderkey, '"}}}}}}')"""
    line = f"""case l_linenumber % 4 when 1 then concat('{{"type":"part","data":', {tool("/out/", "true")}, '}}')
        when 2 then concat('{{"type":"session_message","message_type":"assistant","data":{{"content":[{{"type":"text"}},', {tool("/out/m", "true")}, ',', {tool("/no/", "false")}, ']}}}}')
        when 3 then concat('{{"type":"session_message","message_type":"user","data":{{"content":[', {tool("/no/", "true")}, ']}}}}') else 'no json' end"""
    rows = read(spark, sf_dir, "lineitem").selectExpr("struct(l_orderkey, l_linenumber) as id", f"{line} as line")
    return records.output_paths(rows, "id", "line").select("id.l_orderkey", "id.l_linenumber", "path")


@query(
    """select page_id, case page_id % 4 when 0 then 'jane' when 1 then 'u' || page_id when 2 then null else 'joe' end as user, case page_id % 4 when 0 then 'app' when 1 then 'repo' || page_id when 2 then null else 'x' end as repository,
         case page_id % 4 when 0 then 'p' || page_id end as project from pages"""
)
def names_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User, repository and project folder, from paths of three systems."""
    pick = lambda *xs: "case page_id % 4 " + " ".join(f"when {k} then {x}" for k, x in enumerate(xs)) + " end"
    state = pick("'/Users/jane/Library/x'", "concat('/home/u', page_id, '/.state')", "'/var/lib/x'", r"'C:\\Users\\joe\\AppData'")
    cwd = pick("'/Users/jane/app/'", "concat('/w/repo', page_id)", "'/'", r"' D:\\a\\x '")
    rel = pick("concat('projects/p', page_id, '/s.jsonl')", "'a/projects'", "''", "'myprojects/x'")
    rows = read(spark, sf_dir, "pages").selectExpr("page_id", f"{state} as s", f"{cwd} as c", f"{rel} as r")
    return rows.select("page_id", records.path_user(F.col("s")).alias("user"), records.repository_name(F.col("c")).alias("repository"), records.project_dir(F.col("r")).alias("project"))


@query(
    """select page_id, case page_id % 6 when 0 then 'C/a b/' || page_id when 1 then 'srv/' || page_id when 2 then null when 3 then null when 4 then 'x/y' else 'a/C:' end as path from pages"""
)
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native paths as paths below a folder; those that climb or are empty have none."""
    native = r"""case page_id % 6 when 0 then concat('C:\\a b\\', page_id) when 1 then concat('/srv//./', page_id) when 2 then '/srv/../x' when 3 then '//' when 4 then 'x/./y/' else 'a/C:' end"""
    return read(spark, sf_dir, "pages").selectExpr("page_id", f"{native} as native").select("page_id", documents.safe_path(F.col("native")).alias("path"))


@query(
    """select doc_id, case when doc_id % 3 = 0 then '(reason withheld: contained payload-derived text)' when doc_id % 3 = 1 then 'failed at ' || doc_id || ' again' else repeat('x', 500) || '…(truncated)' end as reason from documents"""
)
def audit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons fit for the audit log."""
    reason = "case when doc_id % 3 = 0 then concat('saw __REDACTED:email__ in ', doc_id) when doc_id % 3 = 1 then concat('failed at ', doc_id, '\n', 'again') else repeat('x', 501) end"
    return read(spark, sf_dir, "documents").selectExpr("doc_id", f"{reason} as reason").select("doc_id", documents.audit_reason(F.col("reason")).alias("reason"))


@query(
    """with s as (select o_orderstatus as source, o_orderkey as id, o_custkey % 3 as attempts from orders),
            h as (select source, sha256('{"attempts":' || attempts || ',"id":' || id || ',"source":"' || source || '"}') as h from s),
            x as (select source, count(*) as rows, (sum(cast('0x' || h[1:15] as bigint)::hugeint) % 1152921504606846976)::bigint as a, (sum(cast('0x' || h[16:30] as bigint)::hugeint) % 1152921504606846976)::bigint as b, (sum(cast('0x' || h[31:45] as bigint)::hugeint) % 1152921504606846976)::bigint as c, (sum(cast('0x' || h[46:60] as bigint)::hugeint) % 1152921504606846976)::bigint as d from h group by source)
       select source, 1 as version, rows, lpad(lower(to_hex(a)), 15, '0') || lpad(lower(to_hex(b)), 15, '0') || lpad(lower(to_hex(c)), 15, '0') || lpad(lower(to_hex(d)), 15, '0') as checksum from x"""
)
def state_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of remembered state by source, whatever the order of its rows."""
    return documents.checksums(_state(spark, sf_dir), "source")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderstatus as source", "o_orderkey as id", "o_custkey % 3 as attempts")


@query("select o_orderstatus as source, count(*) as n from orders where o_orderstatus = 'O' group by o_orderstatus")
def state_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State as it is loaded: one source's document lost a row since, one holds a negative attempt; both count as empty."""
    state = _state(spark, sf_dir)
    damaged = state.withColumn("attempts", F.when((F.col("source") == "P") & (F.col("id") % 5 == 0), F.lit(-1)).otherwise(F.col("attempts")))
    sums = documents.checksums(damaged, "source")
    return documents.loaded(damaged.filter("source <> 'F' or id % 10 <> 3"), sums, "source").groupBy("source").agg(F.count("*").alias("n"))


@query(
    """select source_id, '{"files":' || count(*) || ',"new":' || count(*) filter (where d = 'new') || ',"unchanged":' || count(*) filter (where d = 'unchanged') || ',"parked":' || count(*) filter (where d = 'parked')
         || ',"shipped_bytes":' || coalesce(sum(n_chars) filter (where d in ('new', 'changed')), 0) || '}' as document
       from (select source as source_id, n_chars, ['new', 'unchanged', 'parked', 'changed'][doc_id % 4 + 1] as d from documents) group by source_id"""
)
def heartbeat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report document for each source."""
    rows = read(spark, sf_dir, "documents").selectExpr("source as source_id", "n_chars as size", "element_at(array('new', 'unchanged', 'parked', 'changed'), int(doc_id % 4) + 1) as decision")
    return documents.heartbeat(rows, "source_id")


@query("select source, round(avg(case when n_chars > 0 then length(source) * 1.0 / n_chars end), 9) as density from documents group by source")
def density_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean share of redacted bytes of each source's files that had any."""
    files = read(spark, sf_dir, "documents").selectExpr("source", "length(source) as bytes_redacted", "if(n_chars > 0, n_chars, null) as bytes_total")
    return redaction.density(files, "source").select("source", F.round("density", 9).alias("density"))


@query("select source, first(doc_id order by n_chars % 50 desc, n_chars desc, doc_id) as id from documents group by source")
def slowest_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slowest file of each source."""
    runs = read(spark, sf_dir, "documents").selectExpr("source", "doc_id as id", "n_chars % 50 as seconds", "n_chars as bytes")
    return redaction.slowest(runs, "source").select("source", F.col("slowest.id").alias("id"))


@query(
    """select doc_id, case when k = 0 then 'skipped' when k in (1, 2) then 'read' when k = 3 then 'unchanged' when k = 4 then 'read' when k = 5 then 'read' when k = 6 then 'read' else 'skipped' end as verdict from (select doc_id, doc_id % 8 as k from documents)"""
)
def stat_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known before a file is read: parked ones wait unless a new snapshot is there; unchanged by size, time, path and policy need no reading."""
    k = "doc_id % 8"
    rows = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{k} in (0, 1, 2, 7) as parked", f"if({k} = 1, 50, 150) as backoff_until", "100 as now", f"{k} = 2 as new_snapshot", "n_chars as size", f"if({k} = 4, n_chars + 1, n_chars) as was_size", "10 as mtime",
        f"if({k} = 5, 9, 10) as was_mtime", "'h' as was_hash", "'p' as path", f"if({k} = 6, 'q', 'p') as was_path", "true as policy_met",
    )
    return rows.select("doc_id", cdc.before_reading().alias("verdict"))
