"""Redaction, key names, paths and text joins over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import detect
from lodestream.functions.rules import BY_NAME, TEXT_RULES, Rule, parts_around
from lodestream.operators import align, documents, jsonl, redaction
from lodestream.plans.examples import EXAMPLES
from lodestream.plans.registry import query, read, relational
from lodestream.sources import archive
from lodestream.sources.spread import spread


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EXAMPLES = [EXAMPLES[r.name].replace("\n", " ") for r in TEXT_RULES]
_PLANTED = f"select doc_id, source, text || ' ' || [{', '.join(map(_literal, _EXAMPLES))}][doc_id % {len(_EXAMPLES)} + 1] || ' user' || doc_id || '@mail.example.org' as t from documents"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda k: case when (len({_DIGITS}) - k) % 2 = 0 then cast(substr({_DIGITS}, k, 1) as int)
    else 2 * cast(substr({_DIGITS}, k, 1) as int) - case when cast(substr({_DIGITS}, k, 1) as int) > 4 then 9 else 0 end end)) % 10 = 0"""
_CARD = f"""len({_DIGITS}) in (13, 14, 15, 16, 19) and regexp_matches({_DIGITS}, '^(3[04678]|[456]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)')
    and regexp_matches(m, '^([0-9]+|[0-9]{{4}} [0-9]{{4}} [0-9]{{4}} [0-9]{{4}}( [0-9]{{3}})?|[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}(-[0-9]{{3}})?|[0-9]{{4}} [0-9]{{6}} [0-9]{{5}}|[0-9]{{4}}-[0-9]{{6}}-[0-9]{{5}})$') and {_LUHN}"""
_ACCOUNT = """len(m) between 15 and 34 and list_reduce(list_transform(string_split(substr(m, 5) || left(m, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end),
    lambda a, c: (a * (case when c > 9 then 100 else 10 end) + c) % 97) = 1"""
_PESEL = "list_sum(list_transform(range(1, 12), lambda k: cast(substr(m, k, 1) as int) * [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1][k])) % 10 = 0 and cast(substr(m, 3, 2) as int) % 20 between 1 and 12"
_CHECKS = {"": "true", "pan": _CARD, "iban": _ACCOUNT, "pesel": _PESEL}
_GUARDS = {"": "true", "has-digit": "regexp_matches(m, '[0-9]')", "no-decimal-neighbor": "before <> '.' and not regexp_matches(rest, '^\\.[0-9]')"}


def _sql_gate(rule: Rule) -> str:
    return " or ".join(f"contains(lower(t), '{k.lower()}')" for k in rule.keywords) or "true"


def _sql_spans(name: str) -> str:
    """DuckDB: the spans of one rule, by marks around what stands before the captured group, the group, and what follows."""
    rule = BY_NAME[name]
    flags, head, group, tail = (x.replace("'", "''") for x in parts_around(rule))
    pattern, marks = f"{flags}({group})", "chr(1) || chr(3) || '\\1' || chr(4) || chr(2)"
    if rule.capture:
        pattern, marks = f"{flags}({head})({group})({tail})", "chr(1) || '\\1' || chr(3) || '\\2' || chr(4) || '\\3' || chr(2)"
    cut = f"select doc_id, string_split(regexp_replace(t, '{pattern}', {marks}, 'g'), chr(1)) as parts from planted where {_sql_gate(rule)}"
    bare = "regexp_replace(array_to_string(parts[1:i], ''), '[\x02\x03\x04]', '', 'g')"
    each = f"select doc_id, parts[i + 1] as x, {bare} as past from (select doc_id, parts, unnest(range(1, len(parts))) as i from ({cut}))"
    spans = f"""select doc_id, right(past, 1) as before, string_split(x, chr(2))[2] as rest, string_split(string_split(x, chr(3))[2], chr(4))[1] as m,
        strlen(past) + strlen(string_split(x, chr(3))[1]) as s from ({each})"""
    return f"select doc_id, s, s + strlen(m) as e, 0 as p, '{name}' as r from ({spans}) where {_CHECKS[rule.checksum]} and {_GUARDS[rule.guard]}"


_REGIONS = f"""with planted as ({_PLANTED}),
  sp as ({" union all ".join(_sql_spans(r.name) for r in TEXT_RULES)}),
  o as (select *, max(e) over w as pe, row_number() over (partition by doc_id order by s, p, e desc, r) as rn from sp
        window w as (partition by doc_id order by s, p, e desc, r rows between unbounded preceding and 1 preceding)),
  i as (select *, sum(case when pe is null or s >= pe then 1 else 0 end) over (partition by doc_id order by rn) as isl from o),
  m as (select doc_id, min(s) as s, max(e) as e, arg_min(r, rn) as rule from i group by doc_id, isl)"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an example of some rule and an address at their ends."""
    examples = F.array(*map(F.lit, _EXAMPLES))
    planted = F.concat(F.col("text"), F.lit(" "), F.get(examples, (F.col("doc_id") % len(_EXAMPLES)).cast("int")), F.lit(" user"), F.col("doc_id").cast("string"), F.lit("@mail.example.org"))
    return spread(read(spark, sf_dir, "documents")).select("doc_id", "source", planted.alias("t"))


@query(
    _REGIONS
    + """ select d.source, m.rule, count(*) as hits, cast(sum(m.e - m.s) as bigint) as bytes_redacted, any_value(b.bytes_total) as bytes_total
  from m join planted d using (doc_id) join (select source, cast(sum(strlen(t)) as bigint) as bytes_total from planted group by source) b on b.source = d.source group by d.source, m.rule"""
)
def scrub_ledger_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and redacted bytes by source and rule, of all rules."""
    return redaction.ledger(_planted(spark, sf_dir), "t", "source")


@query(_REGIONS + " select rule, count(*) as hits, count(distinct doc_id) as files from m group by rule")
def scrub_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and documents by rule: spans are found in tasks, and united by Spark's windows."""
    regions = redaction.merged(redaction.spans(_planted(spark, sf_dir), "doc_id", "t"), "doc_id")
    return regions.groupBy(F.col("r").alias("rule")).agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("files"))


@query(f"with planted as ({_PLANTED}) " + " union all ".join(f"select doc_id, '{r.name}' as rule from planted where t is not null and ({_sql_gate(r)})" for r in TEXT_RULES))
def keyword_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules whose keywords each document holds, for all rules."""
    return redaction.gates(_planted(spark, sf_dir), "doc_id", "t")


@query()
def scrubbed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with the regions of all rules replaced by sentinels; tested on a fixture with a case for each rule."""
    return redaction.scrubbed(_planted(spark, sf_dir), "doc_id", "t")


@query(f"with planted as (select doc_id, text as t from documents) select doc_id, s, e from ({_sql_spans('email')})")
def detect_email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with their byte offsets."""
    return redaction.spans(spread(read(spark, sf_dir, "documents")), "doc_id", "text", (BY_NAME["email"],)).select("doc_id", "s", "e")


@query(
    f"""with planted as ({_PLANTED}), m as ({_sql_spans('email')}), f as (select doc_id, sum(e - s) as redacted from m group by doc_id)
        select source, round(avg(redacted / strlen(t)), 9) as density from planted join f using (doc_id) group by source"""
)
def redaction_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean share of each document's bytes that are addresses, by source, over documents that have any."""
    rows = _planted(spark, sf_dir)
    found = redaction.spans(rows, "doc_id", "t", (BY_NAME["email"],)).groupBy("doc_id").agg(F.sum(F.col("e") - F.col("s")).alias("bytes_redacted"))
    files = rows.select("doc_id", "source", F.octet_length("t").alias("bytes_total")).join(found, "doc_id")
    return redaction.density(files, "source").select("source", F.round("density", 9).alias("density"))


@query(f"with planted as ({_PLANTED}) select doc_id, s, e from ({_sql_spans('key-name')})")
def detect_named_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand after the name of a secret in plain text, with their byte offsets."""
    return redaction.spans(_planted(spark, sf_dir), "doc_id", "t", (BY_NAME["key-name"],)).select("doc_id", "s", "e")


@query(f"with planted as (select page_id as doc_id, html as t from pages) select doc_id, s, e from ({_sql_spans('card-pan')})")
def pan_luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers in pages that pass the structural rules and the Luhn check."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return redaction.spans(pages, "doc_id", "html", (BY_NAME["card-pan"],)).select("doc_id", "s", "e")


@query(
    """select c_custkey, (list_sum(list_transform(range(1, 12), lambda k: cast(substr(n, k, 1) as int) * [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1][k])) % 10 = 0
         and cast(substr(n, 3, 2) as int) % 20 between 1 and 12) as valid
       from (select c_custkey, lpad(cast(44051401000 + c_custkey as varchar), 11, '0') as n from customer)"""
)
def pesel_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of national numbers made from customer keys."""
    n = F.lpad((F.lit(44051401000) + F.col("c_custkey")).cast("string"), 11, "0")
    return read(spark, sf_dir, "customer").select("c_custkey", detect.pesel_valid(n).alias("valid"))


@query(
    """select c_custkey, cast(lpad(cast(c_custkey as varchar), 16, '0') || '1314' || lpad(cast(c_custkey % 97 + 2 as varchar), 2, '0') as hugeint) % 97 = 1 as valid from customer"""
)
def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of account numbers made from customer keys (country DE)."""
    number = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 16, "0"))
    return read(spark, sf_dir, "customer").select("c_custkey", detect.iban_valid(number).alias("valid"))




@query(
    """select s_suppkey, word, word not in ('key', 'id', 'name', 'passphrase') or (word = 'key' and q in ('api', 'access', 'private', 'secret', 'signing', 'encryption', 'auth')) as secret from (
         select s_suppkey, ['api', 'access', 'private', 'secret', 'signing', 'encryption', 'auth', 'row', 'session', 'ssh', 'account'][s_suppkey % 11 + 1] as q,
           ['key', 'token', 'secret', 'name', 'password', 'pwd', 'auth', 'authorization', 'cookie', 'passphrase', 'id', 'passwd', 'credential'][s_suppkey % 13 + 1] as word from supplier)"""
)
def secret_key_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key names in camel case: their last word, and whether it marks a secret."""
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (F.col("s_suppkey") % n).cast("int"))
    before = pick("api access private secret signing encryption auth row session ssh account".split(), 11)
    word = pick("Key Token Secret Name Password Pwd Auth Authorization Cookie Passphrase Id Passwd Credential".split(), 13)
    name = F.concat(before, word)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(detect.key_words(name), -1).alias("word"), detect.secret_key(name).alias("secret"))


@query(
    """with runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+=_-]{24,}')) as run from documents),
            n as (select doc_id, run, c, count(*) as k from (select doc_id, run, unnest(string_split(run, '')) as c from (select distinct doc_id, run from runs)) group by all)
       select doc_id, run, round(-sum(k * 1.0 / length(run) * log2(k * 1.0 / length(run))), 6) >= case when regexp_matches(run, '^[0-9a-fA-F]+$') then 3.8 else 4.2 end as clears from n group by doc_id, run"""
)
def entropy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long runs of key characters, and whether they look random."""
    runs = spread(read(spark, sf_dir, "documents")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+=_-]{24,}"), F.lit(0))).alias("run")).distinct()
    return runs.select("doc_id", "run", detect.clears_entropy(F.col("run")).alias("clears"))


@query(
    """with sp as (select l_orderkey as d, l_partkey % 60 as s, l_partkey % 60 + cast(l_quantity as int) as e, l_linenumber % 4 as p, 'r' || (l_suppkey % 5) as r from lineitem),
  o as (select *, max(e) over w as pe, row_number() over (partition by d order by s, p, e desc, r) as rn from sp
        window w as (partition by d order by s, p, e desc, r rows between unbounded preceding and 1 preceding)),
  i as (select *, sum(case when pe is null or s >= pe then 1 else 0 end) over (partition by d order by rn) as isl from o)
  select d, min(s) as s, max(e) as e, arg_min(r, rn) as r from i group by d, isl"""
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made from line items, united where they overlap, with attribution."""
    spans = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as d", "l_partkey % 60 as s", "l_partkey % 60 + cast(l_quantity as int) as e", "l_linenumber % 4 as p", "concat('r', l_suppkey % 5) as r")
    return redaction.merged(spans, "d")


@query(
    """select page_id, replace(case when page_id % 2 = 0 then '/home/jane/' || page_id else '/srv/janet/' || page_id end, '/jane/', '/__USER__/') as path from pages"""
)
def path_user_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's name in paths, where it stands alone."""
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/home/jane/"), "page_id")).otherwise(F.concat(F.lit("/srv/janet/"), "page_id"))
    return read(spark, sf_dir, "pages").select("page_id", detect.placeholder_user(path, "jane").alias("path"))


@query("""select c_custkey, 'a%20b/' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '~x' as path from customer""")
def canonical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without dot segments, percent-encoded."""
    raw = F.concat(F.lit("./a b/../a b//"), "c_name", F.lit("~x/."))
    return read(spark, sf_dir, "customer").select("c_custkey", detect.percent_encoded(detect.clean_path(raw)).alias("path"))


@query()
def mirror_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed names of paths (HMAC-SHA256); tested against the standard library."""
    return read(spark, sf_dir, "pages").select("page_id", detect.hmac_sha256(bytes(range(32)), F.concat(F.lit("mirror:"), "url")).alias("name"))


@query(
    """select doc_id, ['zstd', 'gzip', 'sqlite', 'none'][doc_id % 4 + 1] as kind from documents"""
)
def opaque_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads told by their first bytes; three prefixes are planted."""
    planted = F.get(F.array(*(F.unhex(F.lit(h)) for h in ("28B52FFD", "1F8B", "53514C69746520666F726D6174203300", ""))), (F.col("doc_id") % 4).cast("int"))
    payload = F.concat(planted, F.encode("text", "UTF-8"))
    head = F.hex(F.substr(payload, F.lit(1), F.lit(16)))
    kinds = {"28B52FFD": "zstd", "1F8B": "gzip", "504B0304": "zip", "504B0506": "zip", "504B0708": "zip", "425A68": "bzip2", "FD377A585A00": "xz", "53514C69746520666F726D6174203300": "sqlite"}
    kind = F.lit("none")
    for magic, name in kinds.items():
        kind = F.when(F.startswith(head, F.lit(magic)), name).otherwise(kind)
    return read(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


relational(
    "drop_long_fields",
    """select doc_id, case when octet_length(encode(text, 'utf-8')) >= 2000 and source <> 'src0' then '__REDACTED:dropped__' else md5(text) end as text from {documents}""",
    """select doc_id, case when strlen(text) >= 2000 and source <> 'src0' then '__REDACTED:dropped__' else md5(text) end as text from {documents}""",
)
relational(
    "jsonl_parse_mode",
    """select conv_id, count(*) as lines, count(case when turn % 3 = 0 then 1 end) as lines_raw, case when count(case when turn % 3 = 0 then 1 end) = 0 then 'decoded' when count(case when turn % 3 <> 0 then 1 end) = 0 then 'raw' else 'mixed' end as scan_mode
       from {conversations} where text is not null group by conv_id""",
)


_ITEMS = "select item_id, case when item_id % 3 = 0 then '<timestamp>now</timestamp> ' || text || ' ' when item_id % 3 = 1 then '<user_query>' || left(text, 80) || '</user_query>' else substr(text, 5, 20) end as text from {benchmark} union all select 100000 + item_id, text from {benchmark}"
_TURNS = "select conv_id, turn, case when turn % 4 = 0 then text when turn % 4 = 1 then substr(text, 3, 25) else left(text, 70) || ' and more' end as text from {conversations} union all select conv_id, 1000 + turn, text from {conversations}"
_BARE = "trim(replace(replace(replace(text, '<timestamp>now</timestamp>', ''), '<user_query>', ''), '</user_query>', ''), ' ' || chr(9) || chr(10) || chr(13))"


@query(
    f"""with i as (select item_id, {_BARE} as a from ({_ITEMS.format(benchmark="benchmark")}) union all select 1000 + conv_id as item_id, {_BARE} as a from conversations where turn = 0),
            t as (select conv_id, turn, {_BARE} as b from ({_TURNS.format(conversations="conversations")}))
       select distinct item_id, conv_id, turn from i join t on contains(a, b) or contains(b, a) or (length(a) >= 64 and length(b) >= 64 and left(a, 64) = left(b, 64)) where a <> '' and b <> ''"""
)
def text_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and first turns, whole and cut, against all turns, whole and cut: one holds the other, or both begin alike."""
    turns = read(spark, sf_dir, "conversations")
    items = spark.sql(_ITEMS, benchmark=read(spark, sf_dir, "benchmark")).unionByName(turns.filter("turn = 0").select((F.col("conv_id") + 1000).alias("item_id"), "text"))
    return align.holding(items, spark.sql(_TURNS, conversations=turns)).distinct()


@query(
    """with t as (select conv_id, turn, turn % 5 <> 3 as kept, max(case when turn % 5 <> 3 then turn end) over (partition by conv_id) as last from conversations)
       select conv_id, turn, case when kept then 'matched' when last is not null and turn > last then 'tail' else 'mismatch' end as status from t"""
)
def align_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts aligned with a store from which turns were dropped and to which some were added twice; harder cases are tested on a case table."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat_ws(" ", F.concat_ws("-", "conv_id", "turn", F.lit(".")), "text").alias("text"))
    kept = turns.filter("turn % 5 <> 3")
    store = kept.unionByName(kept.filter("turn % 4 = 2")).select("conv_id", F.col("turn").alias("pos"), "role", "text")
    return align.align(turns, store).select("conv_id", "turn", "status")


@query(
    """select conv_id, turn, 'decoded' as mode, cast(2 as bigint) as hits, '{"role":"' || role || '","mail":"__REDACTED:email__","apiKey":"__REDACTED:key-name__"}' as line from conversations"""
)
def jsonl_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of a role, a planted address and a key: only those two strings change. ``jsonl_scrub_conversations`` has the turns' text."""
    mail = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("@mail.example.org"))
    line = F.concat(F.lit('{"role":"'), "role", F.lit('","mail":"'), mail, F.lit('","apiKey":"k'), F.col("turn").cast("string"), F.lit('"}'))
    lines = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), line.alias("line"))
    return jsonl.scrub(lines, "id", "line").select("id.conv_id", "id.turn", "mode", "hits", "line")


@query(
    """select conv_id, turn, case when role = 'assistant' then 'bypassed' else 'decoded' end as mode, case when role = 'assistant' then 0 else 1 end::bigint as hits,
         '{"n":' || conv_id || ',"mail":"' || case when role = 'assistant' then 'u' || conv_id || '@mail.example.org' else '__REDACTED:email__' end || '"}' as line from conversations"""
)
def scrub_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a planted address, by role: one role is declared not to be scrubbed, another has no declaration."""
    line = F.format_string('{"n":%d,"mail":"u%d@mail.example.org"}', "conv_id", "conv_id")
    lines = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.coalesce("role", F.lit("")).alias("role"), line.alias("line"))
    catalog = read(spark, sf_dir, "conversations").select(F.col("role").alias("source"), F.when(F.col("role") == "assistant", F.lit(False)).alias("scrub")).distinct()
    return jsonl.scrub_by_source(lines, "id", "line", "role", catalog).select("id.conv_id", "id.turn", "mode", "hits", "line")


@query()
def jsonl_scrub_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their whole text as JSON lines, scrubbed by all rules; tested on a fixture. Repeated rows stay apart."""
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line"))
    return jsonl.scrub(turns, "id", "line").select("id.conv_id", "id.turn", "mode", "hits", "line")


@query("select doc_id, cast(strlen(text) as bigint) as payload_size, sha256(text) as payload_sha256, true as whole from documents")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sealed into containers and opened again, with the manifest's hash checked."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.sha2("text", 256).alias("shipped_hash"))).alias("manifest"), F.col("text").alias("payload"))
    opened = archive.opened(archive.sealed(docs, "doc_id"), "doc_id")
    return opened.select("doc_id", "payload_size", "payload_sha256", (F.get_json_object("manifest", "$.shipped_hash") == F.col("payload_sha256")).alias("whole"))


@query(
    """select page_id, '{"manifest-version":"1","source-id":"pages","shipped-hash":"' || sha256(html) || '"' || case when page_id % 2 = 0 then ',"shape-sniff":"text"' else '' end || '}' as metadata from pages"""
)
def object_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest fields that may be seen beside a sealed object, as JSON; fields without a value are left out, and the path never is one."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.lit(1).alias("manifest_version"), F.lit("pages").alias("source_id"), F.sha2("html", 256).alias("shipped_hash"), F.when(F.col("page_id") % 2 == 0, "text").alias("shape_sniff"), F.col("url").alias("native_path"))
    return pages.select("page_id", documents.object_metadata(pages.columns).alias("metadata"))


@query(
    """with named as (select page_id, sha256(url) as tag, 'p' || (page_id % 120) as name from pages),
            first as (select *, row_number() over (partition by name order by page_id) as rn from named),
            beside as (select *, name || '~' || left(tag, 8) as alt from first)
       select page_id, case when rn = 1 then name when count(*) over (partition by rn > 1, alt) = 1 or page_id = min(page_id) over (partition by rn > 1, alt) then alt end as output,
         rn > 1 and page_id <> min(page_id) over (partition by rn > 1, alt) as failed from beside"""
)
def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names that a file system without case would merge: each later one is written beside the first under its own tag."""
    number = (F.col("page_id") % 120).cast("string")
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("P"), number)).otherwise(F.concat(F.lit("p"), number))
    rows = read(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("tag"), F.lower(name).alias("name"))
    return documents.claimed(rows, "page_id", "name", "tag")
