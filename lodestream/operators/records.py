"""Records of JSON lines: shape, producer, references, canonical forms."""

from __future__ import annotations

import datetime as dt
import json
import sys
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines at whose heads a producer's version is looked for.
VERSION_LINES = 16
# Fields that carry key material, fields that change with every read, and ids that a record's key leaves out.
KEY_MATERIAL = ("blobEncryptionKey", "speculativeSummarizationEncryptionKey")
READ_NOISE = ("as_of", "reset_after_seconds")
OWN_IDS = ("id", "sessionID", "messageID", "parentID")
# Beginnings of store keys that hold credentials, and the four keys among them that don't.
DENIED_PREFIXES = ("cursorauth/", "cursorauth.")
ALLOWED_KEYS = ("cursorauth/stripemembershiptype", "cursorauth/cachedemail", "cursorauth/cachedsignuptype", "cursorauth/cachedteam")

_STAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)")


def sniff(head: Column, kind: str, magic: str = "", truncated: Column | None = None) -> Column:
    """``ok``, ``empty``, ``unexpected_shape`` or, without a head, ``unreadable``, for the head (binary) of a file of a ``kind``: jsonl, json, magic (hex), text or none.

    Of JSON lines the first must be an object; one that a ``truncated`` head cuts off can't be judged, and is ok.
    """
    text = F.make_valid_utf8(head.cast("string"))
    first = F.substring_index(text, "\n", 1)
    whole = F.contains(text, F.lit("\n")) | ~F.coalesce(truncated if truncated is not None else F.lit(False), F.lit(False))
    good = {
        "jsonl": F.when(F.trim(F.translate(first, "\t\r", "  ")) == "", F.when(whole, "empty").otherwise("ok")).otherwise(
            F.when(~whole | (F.startswith(F.ltrim(first), F.lit("{")) & F.call_function("try_parse_json", first).isNotNull()), "ok").otherwise("unexpected_shape")
        ),
        "json": F.when(F.regexp_replace(text, r"^[ \t\r\n]+", "").rlike(r"^[\[{]"), "ok").otherwise("unexpected_shape"),
        "magic": F.when(F.startswith(F.hex(head), F.lit(magic.upper())), "ok").otherwise("unexpected_shape"),
        "text": F.lit("ok"),
    }
    if kind not in good:
        return F.lit("ok")
    nul = F.contains(text, F.lit("\0")) if kind in ("jsonl", "text") else F.lit(False)
    return F.when(head.isNull(), "unreadable").when(F.octet_length(head) == 0, "empty").when(nul, "unexpected_shape").otherwise(good[kind])


def source_sniff(samples: DataFrame, by: str) -> DataFrame:
    """(by, shape, failures): a source is condemned only if every sample of it fails, by the first one's reason; ``samples`` has (by, place, shape)."""
    bad = F.col("shape").isin("unreadable", "unexpected_shape")
    good = F.max_by("shape", F.when(~bad, F.col("place")))
    return samples.groupBy(by).agg(F.coalesce(good, F.min_by("shape", "place")).alias("shape"), F.count_if(bad).alias("failures"))


def version(line: Column) -> Column:
    """The producer's version that a record names: ``version`` or ``cli_version``, at the top or in ``payload``, or ``data.copilotVersion``."""
    paths = ("$.version", "$.cli_version", "$.payload.version", "$.payload.cli_version", "$.data.copilotVersion")
    return F.coalesce(*(F.nullif(F.get_json_object(line, p), F.lit("")) for p in paths))


def producer_version(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, version): of the first of a file's ``VERSION_LINES`` lines with something in them that names one."""
    full = lines.filter(F.trim(line) != "")
    head = full.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= VERSION_LINES)
    named = head.select(key, "_n", version(F.col(line)).alias("version"))
    return named.groupBy(key).agg(F.min_by("version", F.when(F.col("version").isNotNull(), F.col("_n"))).alias("version"))


_TOOL = "type string, state struct<metadata: struct<truncated: boolean, outputPath: string>>"
_RECORD = f"type string, message_type string, data struct<{_TOOL.replace(' string', ': string', 1).replace('state struct', 'state: struct')}, content: array<struct<type: string, state: struct<metadata: struct<truncated: boolean, outputPath: string>>>>>"


def output_paths(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, path): files that cut-off tool outputs were written to, as parts or assistant messages name them."""
    r = lines.select(key, F.from_json(line, _RECORD).alias("r"))
    part = F.array(F.struct(F.col("r.data.type").alias("type"), F.col("r.data.state").alias("state")))
    tools = F.when(F.col("r.type") == "part", part).when((F.col("r.type") == "session_message") & (F.col("r.message_type") == "assistant"), F.col("r.data.content"))
    t = r.select(key, F.explode(tools).alias("t"))
    meta = "t.state.metadata"
    return t.filter((F.col("t.type") == "tool") & F.col(f"{meta}.truncated") & (F.col(f"{meta}.outputPath") != "")).select(key, F.col(f"{meta}.outputPath").alias("path"))


def _rewritten(values: DataFrame, key: str, value: str, change: Callable[[object], tuple[object, int]], always: bool) -> DataFrame:
    """(key, value, changed): JSON values rewritten with sorted keys and no blanks; unless ``always``, one that doesn't change stays as it was, as does what isn't JSON."""
    kind = values.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)  # numbers may have any number of digits
        for b in batches:
            out, changed = [], []
            for text in b.column("v").to_pylist():
                try:
                    new, n = change(json.loads(text)) if text is not None else (None, 0)
                    rewrite = text is not None and (n or always)
                except (ValueError, RecursionError):
                    n, rewrite = 0, False
                out.append(json.dumps(new, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if rewrite else text)
                changed.append(n)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.string()), pa.array(changed, pa.int64())], names=["k", "v", "n"])

    found = values.select(F.col(key).alias("k"), F.col(value).alias("v")).mapInArrow(run, f"k {kind}, v string, n bigint")
    return found.select(F.col("k").alias(key), F.col("v").alias(value), F.col("n").alias("changed"))


def _walked(value: object, drop: tuple[str, ...], text: Callable[[str], str]) -> tuple[object, int]:
    if isinstance(value, dict):
        kept = {k: _walked(v, drop, text) for k, v in value.items() if k not in drop}
        return {k: v for k, (v, _) in kept.items()}, len(value) - len(kept) + sum(n for _, n in kept.values())
    if isinstance(value, list):
        items = [_walked(v, drop, text) for v in value]
        return [v for v, _ in items], sum(n for _, n in items)
    if isinstance(value, str):
        new = text(value)
        return new, int(new != value)
    return value, 0


def stripped(values: DataFrame, key: str, value: str, fields: tuple[str, ...] = KEY_MATERIAL) -> DataFrame:
    """(key, value, changed): JSON values without ``fields`` at any depth; values that hold none stay letter by letter."""
    return _rewritten(values, key, value, lambda v: _walked(v, fields, str), always=False)


def _to_minute(text: str) -> str:
    """An RFC 3339 time rounded to its minute, half a minute up; any other text as it is."""
    if not _STAMP.fullmatch(text):
        return text
    try:
        at = dt.datetime.fromisoformat(text[:19] + (text[-6:] if text[-1] != "Z" else "+00:00"))
    except ValueError:
        return text
    at = at.replace(second=0) + dt.timedelta(minutes=at.second >= 30)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + ("Z" if text[-1] == "Z" or text.endswith("+00:00") else text[-6:])


def noise_free(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, changed): the form of observations that is compared: without fields that change with every read, times to the minute."""
    return _rewritten(values, key, value, lambda v: _walked(v, READ_NOISE, _to_minute), always=True)


def execution_keys(records: DataFrame, key: str, scope: Column, created: Column, data: str) -> DataFrame:
    """(key, execution_key): a key of a record's time and content, without its own ids; the same work under other ids has the same key."""

    def bare(value: object) -> tuple[object, int]:
        return ({k: v for k, v in value.items() if k not in OWN_IDS}, 1) if isinstance(value, dict) else (value, 0)

    held = records.select(F.struct(F.col(key).alias("key"), scope.alias("scope"), created.cast("string").alias("created")).alias("id"), F.col(data).alias("data"))
    canonical = _rewritten(held, "id", "data", bare, always=True)
    h = F.sha2(F.concat(F.col("id.scope"), F.lit("\0"), F.col("id.created"), F.lit(":"), F.col("data")), 256)
    return canonical.select(F.col("id.key").alias(key), _uuid(h).alias("execution_key"))


def _uuid(h: Column) -> Column:
    return F.concat_ws("-", *(F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def key_denied(key: Column) -> Column:
    """Whether a store's key holds credentials, in whatever case it is written."""
    low = F.lower(key)
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in DENIED_PREFIXES]) & ~low.isin(*ALLOWED_KEYS), F.lit(False))


def path_user(state_dir: Column) -> Column:
    """The user that a state folder belongs to: the segment after the first ``Users`` or ``home``."""
    return F.nullif(F.regexp_extract(F.replace(state_dir, F.lit("\\"), F.lit("/")), r"(?:^|/)(?:Users|home)/([^/]*)", 1), F.lit(""))


def repository_name(cwd: Column) -> Column:
    """The last segment of a working folder; none for the root or an empty one."""
    return F.try_element_at(F.filter(F.split(F.trim(F.replace(cwd, F.lit("\\"), F.lit("/"))), "/"), lambda x: (x != "") & (x != ".")), F.lit(-1))


def project_dir(rel: Column) -> Column:
    """The segment after the first ``projects``."""
    return F.nullif(F.regexp_extract(rel, r"(?:^|/)projects/([^/]*)", 1), F.lit(""))

