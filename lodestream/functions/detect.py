"""Checks, entropy, key names, globs and paths as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.rules import SECRET_NAMES
from lodestream.functions.scan import BITS, HEX_BITS, KEY_QUALIFIERS, SECRET_WORDS


def iban_valid(match: Column) -> Column:
    """15 to 34 characters whose rearranged number leaves 1 when divided by 97."""
    turned = F.concat(F.substr(match, F.lit(5)), F.left(match, F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.when(value(c) > 9, r * 100 + value(c)).otherwise(r * 10 + value(c)) % 97))
    return F.length(match).between(15, 34) & (rest == 1)


def pesel_valid(match: Column) -> Column:
    """11 digits: a month of one of five centuries, and the weighted check digit."""
    weights = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)
    digit = lambda k: F.substr(match, F.lit(k + 1), F.lit(1)).cast("int")
    total = reduce(lambda a, b: a + b, [digit(k) * w for k, w in enumerate(weights)])
    return match.rlike("^[0-9]{11}$") & (total % 10 == 0) & (F.substr(match, F.lit(3), F.lit(2)).cast("int") % 20).between(1, 12)


def entropy_bits(run: Column) -> Column:
    """Shannon entropy of a string's characters in bits."""
    n = F.length(run)
    share = lambda c: (n - F.length(F.replace(run, c, F.lit("")))) / n
    shares = F.transform(F.filter(F.array_distinct(F.split(run, "")), lambda c: c != ""), share)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def clears_entropy(run: Column) -> Column:
    """Whether a run looks random: 4.2 bits a character, or 3.8 where all are hexadecimal."""
    return entropy_bits(run) >= F.when(run.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(BITS)


def key_words(name: Column) -> Column:
    """The lower-case words of a key name, cut at humps and separators."""
    humps = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.filter(F.split(F.lower(humps), "[_. :/-]+"), lambda w: w != "")


def secret_key(name: Column) -> Column:
    """Whether a key's last word is a secret word, or "key" after a qualifier, or the key is a known environment variable."""
    words, upper = key_words(name), F.upper(name)
    last, before = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
    known = reduce(lambda a, b: a | b, [F.endswith(upper, F.lit(n[1:])) if n[0] == "*" else upper == n for n in SECRET_NAMES])
    return F.coalesce(last.isin(*SECRET_WORDS) | ((last == "key") & before.isin(*KEY_QUALIFIERS)) | known, F.lit(False))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob with ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, k, depth = [], 0, 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out.append("(?:[^/]+/)*")
            k += 3
        elif glob.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            c = glob[k]
            depth += (c == "{") - (c == "}")
            out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c)))
            k += 1
    return "^" + "".join(out) + "$"


def percent_encoded(text: Column) -> Column:
    """Everything but letters, digits and ``-._~`` as %XX of its bytes; slashes stay."""
    safe = F.url_encode(text)
    for was, now in (("+", "%20"), ("%7E", "~"), ("*", "%2A"), ("%2F", "/")):
        safe = F.replace(safe, F.lit(was), F.lit(now))
    return safe


def placeholder_user(path: Column, user: str) -> Column:
    """The user's name, where no letter or digit touches it, as ``__USER__``; a name of one letter stays."""
    return path if len(user) < 2 else F.regexp_replace(path, f"(?<![0-9A-Za-z]){re.escape(user)}(?![0-9A-Za-z])", "__USER__")


def clean_path(path: Column) -> Column:
    """Slashes only, without empty, ``.`` and ``..`` segments."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when((x == "") | (x == "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    return F.array_join(kept, "/")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.sha2(F.concat(F.unhex(F.lit(inner.hex())), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(digest)), 256)


def session_key(namespace: str, value: Column) -> Column:
    """A UUID-shaped key from SHA-256 of namespace, NUL and value."""
    h = F.sha2(F.concat(F.lit(namespace), F.lit("\0"), value), 256)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substr(h, F.lit(a), F.lit(n)) for a, n in cut))
