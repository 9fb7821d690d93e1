"""Transcripts enriched by a side store: which units get a derived object, and its lines.

A unit is a transcript, a file of JSON lines named after its conversation. Its blocks
are aligned with the store's rows (``operators/align.py``); what the store knows goes
beside the native line, which is kept as it is. A unit has one of four routes:

* ``skipped``: its name is no conversation's, there is no store, or the store has no
  rows of it (a draft);
* ``error``: the store is there and can't be read;
* ``mismatch``: blocks before the last match have no row, so no object is made;
* ``ok``: an object is made. Blocks past the store's end, repeats and ambiguous ones
  are carried without enrichment and counted.

A line that isn't JSON is carried as text; the last one may be torn, others count as
decode errors. Blank lines are left out. Hashes are taken over lines and their places,
line by line, so that no unit is put together to be hashed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators import align

_BLOCK = "struct<type:string,text:string,name:string,input:string>"
_LINE = f"role string, message struct<content:array<{_BLOCK}>>, _bad string"
_WHITE = r"^[\x20\t\n\r\x0b\f]+|[\x20\t\n\r\x0b\f]+$"
#: A block's number in its unit holds its line and, in so many bits, its place in the line.
_PLACE_BITS = 24

#: What a store row may have beside conversation, place, role, text, tool and args.
KNOWN = ("row_id", "tool_call_id", "tool_name", "tool_kind", "status", "result", "created", "request_id", "checkpoint_id", "duration_ms", "model", "model_nested")


def conversation(path: Column) -> Column:
    """The conversation that a transcript is named after; null if it isn't a file of JSON lines."""
    name = F.regexp_extract(path, r"([^/\\]+)\.jsonl$", 1)
    return F.when(name != "", name)


def known(row: dict[str, Column] | None = None) -> Column:
    """What a store row adds to a block, as JSON: empty fields are left out, an older model field goes before the nested one, a tool's name before its kind."""
    c = row or {k: F.col(k) for k in KNOWN}
    text = lambda x: F.nullif(x.cast("string"), F.lit(""))
    fields = {
        "bubbleId": text(c["row_id"]),
        "tool_call_id": text(c["tool_call_id"]),
        "tool_name": F.coalesce(text(c["tool_name"]), text(c["tool_kind"])),
        "status": text(c["status"]),
        "result": text(c["result"]),
        "createdAt": text(c["created"]),
        "requestId": text(c["request_id"]),
        "checkpointId": text(c["checkpoint_id"]),
        "turnDurationMs": F.nullif(c["duration_ms"].cast("bigint"), F.lit(0).cast("bigint")),
        "modelName": F.coalesce(text(c["model"]), text(c["model_nested"])),
    }
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    """(path, line_no, line) of ``lines`` (path, line, and what orders them in a file), without blank ones."""
    bare = lines.withColumn("line", F.regexp_replace("line", _WHITE, "")).filter("line <> ''")
    return bare.select("path", F.row_number().over(Window.partitionBy("path").orderBy(*order)).cast("bigint").alias("line_no"), "line")


def hash_of(place: str, line: str) -> Column:
    """An aggregate: a hash of a set of lines with their places."""
    whole = [F.sum(F.xxhash64(F.lit(k), place, line).cast("decimal(20,0)")).cast("string") for k in (1, 2)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *whole), 256)


def blocks_of(lines: DataFrame) -> DataFrame:
    """(path, line_no, line, bad, place, role, text, name, input): a row for each content block, and one without place for each line that has none."""
    read = lines.withColumn("j", F.from_json("line", _LINE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull()
    content = F.when(~bad & (F.coalesce("j.role", F.lit("")) != ""), F.col("j.message.content"))
    out = read.select("path", "line_no", "line", bad.alias("bad"), F.col("j.role").alias("role"), F.posexplode_outer(content).alias("place", "b"))
    tool = F.col("b.type") == "tool_use"
    return out.select("path", "line_no", "line", "bad", "place", "role", F.col("b.text").alias("text"), *(F.when(tool, F.col(f"b.{c}")).alias(c) for c in ("name", "input")))


def _block_id() -> Column:
    return F.shiftleft("line_no", _PLACE_BITS).bitwiseOR(F.col("place").cast("bigint"))


def enrich(lines: DataFrame, store: DataFrame | None, unreadable: str | None = None, cut: Callable[[DataFrame], DataFrame] = lambda found: found) -> tuple[DataFrame, DataFrame]:
    """Outcomes of units, and the lines of the objects made.

    Both come from one alignment; ``cut`` may write that and read it again, so that it isn't made twice.

    ``lines`` has (path, line_no, line), ``store`` (conv_id, pos, role, text, tool, args,
    row_id, and more of ``KNOWN``) in order and without scaffolding, or is None where
    there is none; ``unreadable`` says why it can't be read. Outcomes are (path, conv_id,
    status, mismatches, repeats, tail, ambiguous, decode_errors, source_hash,
    output_hash, note), object lines (path, line_no, line).
    """
    units = lines.groupBy("path").agg(hash_of("line_no", "line").alias("source_hash"), F.max("line_no").alias("last")).withColumn("conv_id", conversation(F.col("path")))
    if store is None or unreadable is not None:
        named = F.col("conv_id").isNotNull()
        route, note = ("skipped", "no store: raw transcripts only") if unreadable is None else ("error", f"store unreadable: {unreadable}")
        none = units.select("path", "conv_id", F.when(named, route).otherwise("skipped").alias("status"), *(F.lit(0).cast("bigint").alias(c) for c in ("mismatches", "repeats", "tail", "ambiguous", "decode_errors")), "source_hash", F.lit(None).cast("string").alias("output_hash"), F.when(named, F.lit(note)).alias("note"))
        return none, lines.filter(F.lit(False)).select("path", "line_no", "line")

    empty = [F.lit(None).cast("string").alias(c) for c in ("tool", "args", *KNOWN) if c not in store.columns]
    rows = store.select("*", *empty)
    rows = rows.select(F.col("conv_id").cast("string").alias("of"), F.row_number().over(Window.partitionBy("conv_id").orderBy("pos", "role", "text")).cast("bigint").alias("pos"), "role", "text", "tool", "args", known().alias("known"))
    wanted = units.select("path", F.col("conv_id").alias("of")).join(rows, "of")

    blocks = blocks_of(lines)
    asked = blocks.filter("place is not null").select(F.col("path").alias("conv_id"), _block_id().alias("turn"), "role", "text", "name", "input")
    side = wanted.select(F.col("path").alias("conv_id"), "pos", "role", "text", "tool", "args")
    drafts = units.join(wanted.select("path").distinct(), "path", "left_anti").select(F.col("path").alias("conv_id"))
    found = cut(align.align(asked.join(drafts, "conv_id", "left_anti"), side))

    count = lambda s: F.count_if(F.col("status") == s)
    counts = found.groupBy(F.col("conv_id").alias("path")).agg(count("mismatch").alias("mismatches"), count("repeat").alias("repeats"), count("tail").alias("tail"), count("ambiguous").alias("ambiguous"))
    # The aligner counts a conversation's rows from 0.
    taken = found.filter("store_row is not null").select(F.col("conv_id").alias("path"), "turn", (F.col("store_row") + 1).alias("pos"))
    held = taken.join(wanted.select("path", "pos", "known"), ["path", "pos"]).select("path", F.shiftright("turn", _PLACE_BITS).alias("line_no"), F.col("turn").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"), "known")
    by_line = held.groupBy("path", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("place", "known"))).alias("known"))
    width = blocks.groupBy("path", "line_no").agg(F.count("place").alias("width"), F.any_value("line").alias("line"), F.any_value("bad").alias("bad"))
    rendered = width.join(by_line, ["path", "line_no"], "left")
    beside = F.concat_ws(",", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1), lambda i: F.coalesce(F.element_at("known", i), F.lit("null"))))
    out = F.when(F.col("bad"), F.to_json(F.struct(F.col("line").alias("native_invalid")))).when(F.col("known").isNull(), F.concat(F.lit('{"native":'), "line", F.lit("}"))).otherwise(F.concat(F.lit('{"native":'), "line", F.lit(',"_enrich":['), beside, F.lit("]}")))
    rendered = rendered.select("path", "line_no", "bad", out.alias("line"))

    bad = rendered.join(units.select("path", "last"), "path").groupBy("path").agg(F.count_if(F.col("bad") & (F.col("line_no") < F.col("last"))).alias("decode_errors"), hash_of("line_no", "line").alias("output_hash"))
    whole = units.join(wanted.select("path", F.lit(True).alias("stored")).distinct(), "path", "left").join(counts, "path", "left").join(bad, "path", "left").na.fill(0, ["mismatches", "repeats", "tail", "ambiguous", "decode_errors"])
    status = F.when(F.col("conv_id").isNull() | F.col("stored").isNull(), "skipped").when(F.col("mismatches") > 0, "mismatch").otherwise("ok")
    outcomes = whole.withColumn("status", status)
    ok = F.col("status") == "ok"
    said = [
        F.when(~ok, F.concat("mismatches", F.lit(" transcript events did not align with the store; no derived object"))),
        F.when(ok & (F.col("tail") > 0), F.concat("tail", F.lit(" transcript events extend past the store's last row"))),
        F.when(ok & (F.col("repeats") > 0), F.concat("repeats", F.lit(" transcript events repeat calls whose row an equal earlier event took"))),
        F.when(ok & (F.col("ambiguous") > 0), F.concat("ambiguous", F.lit(" transcript events could be a repeat or a call that wasn't recorded"))),
        F.when(F.col("decode_errors") > 0, F.concat("decode_errors", F.lit(" lines before the last did not decode"))),
    ]
    note = F.when(F.col("status") != "skipped", F.nullif(F.concat_ws("; ", *said), F.lit("")))
    zero = lambda c: F.when(F.col("status") == "skipped", F.lit(0).cast("bigint")).otherwise(F.col(c)).alias(c)
    outcomes = outcomes.select("path", "conv_id", "status", *(zero(c) for c in ("mismatches", "repeats", "tail", "ambiguous", "decode_errors")), "source_hash", F.when(ok, F.col("output_hash")).alias("output_hash"), note.alias("note"))
    made = rendered.join(outcomes.filter("status = 'ok'").select("path"), "path", "left_semi").select("path", "line_no", "line")
    return outcomes, made


def derived_path(path: Column) -> Column:
    return F.concat(path, F.lit(".enriched.jsonl"))


def decided(outcomes: DataFrame, state: DataFrame, policy: str) -> DataFrame:
    """``outcomes`` with ``decision``: an object whose output hash and policy are those of ``state`` (path, source_hash, output_hash, policy: one row each) is ``unchanged``, another one ``shipped``; null where none was made."""
    seen = state.filter("coalesce(source_hash, '') <> ''").select(F.col("path").alias("_path"), F.col("output_hash").alias("_hash"), F.col("policy").alias("_policy"))
    both = outcomes.join(seen, F.col("path") == F.col("_path"), "left")
    same = (F.col("_hash") == F.col("output_hash")) & (F.col("_policy") == F.lit(policy))
    return both.select(*outcomes.columns, F.when(F.col("status") == "ok", F.when(same, "unchanged").otherwise("shipped")).alias("decision"))


def tallied(outcomes: DataFrame) -> DataFrame:
    """(status, units) and how many objects were shipped."""
    counts = [F.count("*").alias("units"), F.count_if(F.col("decision") == "shipped").alias("shipped"), F.count_if(F.col("decision") == "unchanged").alias("unchanged")]
    return outcomes.groupBy("status").agg(*counts)
