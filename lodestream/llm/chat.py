"""Chat formatting by Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one
role are merged by array functions into one marked turn:

    <|im_start|>role
    first text<|im_next|>second text<|im_end|>

Inside roles and texts a backslash is doubled and ``<|`` is written ``<\\|``, so no
text holds a mark and every text comes back as it was; a line break in a role is
written ``<|nl|>``. ``loss`` lists the spans of
assistant texts in the formatted string, one for each text, in characters and in
UTF-8 bytes. Work grows as n log n of a conversation's turns.

Cases: a null text or role counts as empty; turns are in the order of (turn, role,
text), nulls first, so ties and repeated rows have one result; rows with a null
conversation id form one conversation. An empty table gives no rows. Other columns,
whatever their names, are left out. A conversation is one row of the result, so its
turns meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END, BREAK, ROLE_BREAK = "<|im_start|>", "<|im_next|>", "<|im_end|>", "\n", "<|nl|>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(BREAK), F.lit(ROLE_BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ROLE_BREAK), F.lit(BREAK)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(sizes: Column) -> Column:
    """Of an array of structs (chars, bytes): the sums up to and with each element.

    By doubling: pass k adds the sum that ends 2**k places earlier, so n elements take
    log2(n) passes, and no array grows element by element.
    """
    add = lambda a, b: F.struct((a["chars"] + F.coalesce(b["chars"], F.lit(0))).alias("chars"), (a["bytes"] + F.coalesce(b["bytes"], F.lit(0))).alias("bytes"))

    def doubled(sums: Column, k: Column) -> Column:
        back = F.power(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: add(x, F.when(i >= back, F.get(sums, i - back))))

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(2)))).cast("int") - 1)
    return F.aggregate(passes, sizes, doubled)


def _merged(t: Column) -> Column:
    """Sorted turns as runs (role, texts) of neighbours of one role; each run is a slice, found from where roles change."""
    begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

    def runs(starts: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(starts, k + 1), F.size(t))
        return F.transform(
            starts,
            lambda s, k: F.struct(F.get(t, s)["role"].alias("role"), F.transform(F.slice(t, s + 1, upto(k) - s), lambda x: escape(x["text"])).alias("texts")),
        )

    return bound(begins, runs)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of ``turns`` (conv_id, turn, role, text)."""
    one = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    sorted_turns = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return _laid_out(sorted_turns.select("conv_id", bound(F.col("t"), _merged).alias("m")))


def _pieces(run: Column) -> Column:
    """What each text of a run adds to the formatted string: before it, itself, after it; and whether it is learnt."""
    last = F.size(run["texts"]) - 1
    return F.transform(
        run["texts"],
        lambda text, j: F.struct(
            F.when(j == 0, F.concat(F.lit(START), escape_role(run["role"]), F.lit(BREAK))).otherwise(NEXT).alias("before"),
            text.alias("text"),
            F.when(j == last, END + BREAK).otherwise("").alias("after"),
            (run["role"] == LEARNT).alias("learnt"),
        ),
    )


def _loss(pieces: Column) -> Column:
    """The places of learnt texts, in characters and in bytes."""
    whole = lambda p: F.concat(p["before"], p["text"], p["after"])
    sizes = F.transform(pieces, lambda p: F.struct(F.length(whole(p)).cast("bigint").alias("chars"), F.octet_length(whole(p)).cast("bigint").alias("bytes")))

    def placed(ends: Column) -> Column:
        start = lambda p, i, unit, size: F.get(ends, i)[unit] - size(F.concat(p["text"], p["after"]))
        spans = F.transform(
            pieces,
            lambda p, i: F.when(
                p["learnt"],
                F.struct(
                    start(p, i, "chars", F.length).alias("start"),
                    F.length(p["text"]).cast("bigint").alias("length"),
                    start(p, i, "bytes", F.octet_length).alias("byte_start"),
                    F.octet_length(p["text"]).cast("bigint").alias("bytes"),
                ),
            ),
        )
        return F.filter(spans, lambda s: s.isNotNull())

    return bound(running_sums(sizes), placed)


def _laid_out(merged: DataFrame) -> DataFrame:
    """Concatenate merged turns, and place the spans of learnt texts."""
    pieces = merged.select("conv_id", F.flatten(F.transform("m", _pieces)).alias("p"))
    whole = F.array_join(F.transform("p", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return pieces.select("conv_id", whole.alias("formatted"), bound(F.col("p"), _loss).alias("loss"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped, each text its own turn again."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate(BREAK, b) + 1), r"<\|im_next\|>"),
                lambda text: F.struct(unescape_role(F.substr(b, F.lit(len(START) + 1), F.locate(BREAK, b) - len(START) - 1)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``formatted`` (conv_id, formatted, loss) holds, from the string and its loss spans alone."""
    turns = parsed(F.col("formatted"))
    # Cut by bytes: characters would be counted from the start again for each span.
    learnt = bound(
        F.encode("formatted", "UTF-8"),
        lambda raw: F.array_join(F.transform("loss", lambda s: unescape(F.decode(F.substr(raw, (s["byte_start"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))), ""),
    )
    both = formatted.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return both.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )
