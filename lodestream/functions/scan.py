"""Detectors over one text, for use inside Arrow tasks: spans of rules, of secret-looking runs and of user names.

A span is (start, end, class, rule) in characters; class 0 is a rule, 1 a heuristic.
All work is linear in the text, but for expressions that a text is built to slow down.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import ahocorasick

from lodestream.functions.rules import SECRET_NAMES, TEXT_RULES, Rule, python

Span = tuple[int, int, int, str]

USER_MARK, SENTINEL_HEAD = "__USER__", "__REDACTED"
ENTROPY, NAMED, DROPPED, PATH_USER = "generic-entropy", "key-name", "dropped", "path-user"
#: Characters of a run that is scored, bits a character needs, bits where it is hexadecimal, and of a base64 value.
RUN, BITS, HEX_BITS, BASE64_FROM = 24, 4.2, 3.8, 32

# Words that make a field's name a secret's, and what may stand before "key".
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "credential", "credentials", "auth", "authorization", "cookie")
KEY_QUALIFIERS = ("api", "secret", "private", "access", "signing", "encryption", "auth")
# How the digits of a card are grouped, and how many there may be.
CARD_GROUPS, CARD_SIZES = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3)), (13, 14, 15, 16, 19)

_ISSUER = re.compile(r"3[04678]|[456]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
_SENTINEL = re.compile(SENTINEL_HEAD + r":[a-z0-9-]+__")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\-. :/]")
_RUN = re.compile(rf"(?<![A-Za-z0-9+=_-])[A-Za-z0-9+=_-]{{{RUN},}}")
_WORD = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9]{{{RUN},}}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_ESCAPE = re.compile(r'\\(?:[ntr"/\\]|u[0-9a-fA-F]{4})')
_BASE64 = re.compile(r"[A-Za-z0-9+/=_\r-]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){10}")
_ACCOUNT = re.compile(r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11}")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.ASCII)
_SCHEME = "abcdefghijklmnopqrstuvwxyz0123456789+.-"
_SCHEME_START = re.compile(r"\b[a-z]", re.ASCII)
_LOGIN = re.compile(python(r"[^/\s:@]+:([^/\s@]{3,})@"), re.ASCII)


def card_valid(found: str) -> bool:
    """A card number: grouped as cards are or not at all, of a card's length and issuer, and with a right check digit."""
    digits = found.replace(" ", "").replace("-", "")
    groups = tuple(map(len, re.split("[ -]", found)))
    if (len(groups) > 1 and (groups not in CARD_GROUPS or (" " in found and "-" in found))) or len(digits) not in CARD_SIZES or not _ISSUER.match(digits):
        return False
    return sum(map(int, digits[-1::-2])) % 10 == -sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]) % 10


def account_valid(found: str) -> bool:
    """15 to 34 characters whose rearranged number leaves 1 when divided by 97."""
    return 15 <= len(found) <= 34 and int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1


def pesel_valid(found: str) -> bool:
    """A month of one of five centuries, and the weighted check digit."""
    total = sum(w * int(d) for w, d in zip((1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), found, strict=True))
    return total % 10 == 0 and 1 <= int(found[2:4]) % 20 <= 12


CHECKS: dict[str, Callable[[str], bool]] = {"pan": card_valid, "iban": account_valid, "pesel": pesel_valid}
GUARDS: dict[str, Callable[[str, int, int], bool]] = {
    "has-digit": lambda text, s, e: any("0" <= c <= "9" for c in text[s:e]),
    "no-decimal-neighbor": lambda text, s, e: text[s - 1 : s] != "." and not re.match(r"\.[0-9]", text[e : e + 2]),
}


def emails(text: str) -> list[tuple[int, int]]:
    """As the rule ``email`` finds them. From each @ the name is read backwards, so that long runs without one cost nothing."""
    out, done, parts = [], 0, text.split("@")
    at = len(parts[0])
    for before, after in zip(parts, parts[1:], strict=False):
        left = max(done, at - len(before) + len(before.rstrip(_LOCAL)))
        start = left + len(text[left:at]) - len(text[left:at].lstrip(".%+-"))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at += len(after) + 1
    return out


def logins(text: str) -> list[tuple[int, int]]:
    """As the rule ``url-userinfo-credentials`` finds passwords, from each ``://``."""
    out, left, at = [], 0, text.find("://")
    while at >= 0:
        scheme = at - len(text[left:at]) + len(text[left:at].rstrip(_SCHEME))
        left = at + 3
        if _SCHEME_START.search(text, scheme, at) and (m := _LOGIN.match(text, left)):
            out.append(m.span(1))
            left = m.end()
        at = text.find("://", left)
    return out


def entropy_clears(run: str) -> bool:
    """Whether a run's characters look random: 4.2 bits each, or 3.8 where all are hexadecimal."""
    n = len(run)
    counts = Counter(run)
    return -sum(counts[c] / n * math.log2(counts[c] / n) for c in sorted(counts)) >= (HEX_BITS if _HEX.fullmatch(run) else BITS)


def key_words(name: str) -> list[str]:
    """The lower-case words of a field's name, cut at humps and separators."""
    return [w.lower() for w in _HUMP.split(name) if w]


def names_secret(name: str, names: tuple[str, ...] = SECRET_NAMES) -> bool:
    """Whether a field's name says that its value is a secret: by its last words, or as an environment variable's."""
    words, upper = key_words(name), name.upper()
    if words and (words[-1] in SECRET_WORDS or (words[-1] == "key" and words[-2:-1] and words[-2] in KEY_QUALIFIERS)):
        return True
    return any(upper.endswith(n[1:]) if n[0] == "*" else upper == n for n in names)


def is_sentinel(value: str) -> bool:
    return _SENTINEL.fullmatch(value) is not None


def sentinel(rule: str) -> str:
    return f"{SENTINEL_HEAD}:{rule}__"


def shadow(value: str) -> tuple[str, list[tuple[int, int]]]:
    """A value whose backslash escapes are blanked at the same length, and the places of the escapes, adjoining ones as one.

    The character that an escape stands for is its last one; those that this makes are blanked as well.
    """

    def blanked(m: re.Match) -> str:
        code = m[0][1:]
        last = {"n": "\n", "t": "\t", "r": "\r"}.get(code, code)
        if code[0] == "u" and len(code) == 5:
            last = chr(int(code[1:], 16))
            last = last if " " < last < "\x80" and not last.isalnum() and last not in "_\\" else " "
        return " " * (len(m[0]) - 1) + last

    places: list[tuple[int, int]] = []
    while found := [m.span() for m in _ESCAPE.finditer(value)]:
        places += found
        value = _ESCAPE.sub(blanked, value)
    joined: list[tuple[int, int]] = []
    for s, e in sorted(places):
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return value, joined


def snapped(span: Span, places: list[tuple[int, int]]) -> Span:
    """A span whose ends do not cut an escape."""
    s, e, *rest = span
    k = bisect_right(places, (s, math.inf)) - 1
    if k >= 0 and places[k][0] < s < places[k][1]:
        s = places[k][0]
    k = bisect_left(places, (e,)) - 1
    if k >= 0 and places[k][0] < e < places[k][1]:
        e = places[k][1]
    return (s, e, *rest)


def resolved(spans: list[Span]) -> list[Span]:
    """Overlapping spans as one, named for the first by (start, class, longest, rule). Spans that only touch stay apart."""
    out: list[Span] = []
    for s, e, p, r in sorted(spans, key=lambda x: (x[0], x[2], -x[1], x[3])):
        if out and s < out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, *out[-1][2:])
        else:
            out.append((s, e, p, r))
    return out


def base64_text(value: str) -> str | None:
    """What a value of base64 letters alone holds, in the standard or the URL alphabet, with padding or without."""
    bare = value.strip()
    if len(value) < BASE64_FROM or not _BASE64.fullmatch(bare):
        return None
    letters = bare.replace("\r", "")
    padded = letters if "=" in letters else letters + "=" * (-len(letters) % 4)
    for other in (b"+/", b"-_"):
        try:
            return base64.b64decode(padded, altchars=other, validate=True).decode("utf-8", "replace") or None
        except (binascii.Error, ValueError):
            continue
    return None


_KEY_BEGIN = re.compile(r"-----BEGIN[A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"(?=(-----END[A-Z ]*PRIVATE KEY(?: BLOCK)?-----))")


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from a begin mark to the first end mark after it. End marks are looked for once, so that begin marks without one cost no more than their own length."""
    begin = _KEY_BEGIN.search(text)
    if not begin:
        return []
    ends = [m.span(1) for m in _KEY_END.finditer(text, begin.end())]
    starts = [s for s, _ in ends]
    out = []
    while begin:
        k = bisect_left(starts, begin.end())
        if k == len(ends):
            break
        out.append((begin.start(), ends[k][1]))
        begin = _KEY_BEGIN.search(text, ends[k][1])
    return out



class Scanner:
    """A set of rules, and a user's name that is hidden in paths; texts are scanned by the rules whose keywords they hold."""

    def __init__(self, rules: tuple[Rule, ...] = TEXT_RULES, user: str = "", names: tuple[str, ...] = SECRET_NAMES):
        self.rules, self.names, self.user = rules, names, user if len(user) >= 2 else ""
        for r in rules:
            if r.checksum and r.checksum not in CHECKS or r.guard and r.guard not in GUARDS:
                raise ValueError(f"rule {r.name} names an unknown checksum or guard")
        self.always = sum(1 << k for k, r in enumerate(rules) if not r.keywords)
        masks: dict[str, int] = {}
        for k, r in enumerate(rules):
            for word in r.keywords:
                masks[word.lower()] = masks.get(word.lower(), 0) | 1 << k
        self.gates = ahocorasick.Automaton()
        for word, mask in masks.items():
            self.gates.add_word(word, mask)
        self.gates.make_automaton()
        self.finders = [self._finder(r) for r in rules]
        self.pairs = tuple(r for r in rules if r.name in ("aws-secret-key", "secret-access-key"))
        self.user_at = re.compile(rf"(?<![0-9A-Za-z]){re.escape(self.user)}(?![0-9A-Za-z])") if self.user else None
        kept = [re.escape(x) for x in (USER_MARK, SENTINEL_HEAD, self.user) if x]
        self.kept = re.compile(rf"(?<![0-9A-Za-z])(?:{'|'.join(kept)})(?![0-9A-Za-z])")

    @staticmethod
    def _finder(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
        check, guard = CHECKS.get(rule.checksum), GUARDS.get(rule.guard)
        if rule.name == "email":
            return emails
        if rule.name == "url-userinfo-credentials":
            return logins
        if rule.name == "private-key-block":
            return key_blocks
        at = re.compile(python(rule.pattern), re.ASCII)
        needs = {"pan": _DIGITS, "pesel": _DIGITS, "iban": _ACCOUNT}.get(rule.checksum)

        def find(text: str) -> list[tuple[int, int]]:
            if needs and not needs.search(text):
                return []
            spans = [m.span(rule.capture) for m in at.finditer(text)]
            if rule.name == NAMED:  # what an earlier scrub put there keeps its rule
                spans = [x for x in spans if not is_sentinel(text[x[0] : x[1]])]
            if check:
                spans = [x for x in spans if check(text[x[0] : x[1]])]
            return [x for x in spans if guard(text, *x)] if guard else spans

        return find

    def seen(self, text: str) -> int:
        """Which rules' keywords a text holds, as bits; letters count in either case."""
        mask = self.always
        if self.gates:
            for _, m in self.gates.iter(text.lower()):
                mask |= m
        return mask

    def by_rules(self, text: str) -> list[Span]:
        """What the rules find, rule by rule."""
        mask = self.seen(text)
        return [(s, e, 0, r.name) for k, r in enumerate(self.rules) if mask >> k & 1 for s, e in self.finders[k](text)]

    def random_runs(self, text: str) -> list[Span]:
        """Long runs that look random. Of a run that holds a sentinel, a user mark or the user's name only such words count."""
        out = []
        for m in _RUN.finditer(text):
            if entropy_clears(m[0]):
                words = [m] if not self.kept.search(m[0]) else [w for w in _WORD.finditer(text, m.start(), m.end()) if entropy_clears(w[0])]
                out += [(*w.span(), 1, ENTROPY) for w in words]
        return out

    def spans(self, text: str, heuristics: bool = False) -> list[Span]:
        """All spans of a text before overlaps are united."""
        found = self.by_rules(text)
        runs = self.random_runs(text) if heuristics else []
        places: list[tuple[int, int]] = []
        if "\\" in text:
            blank, places = shadow(text)
            if places:
                found = [snapped(x, places) for x in found if text[x[0] : x[1]].strip("\\")]
                found += [snapped(x, places) for x in self.by_rules(blank)]
                runs = [snapped(x, places) for x in runs]
        if not found and not runs and (inner := base64_text(text)):
            hit = next(iter(self.by_rules(inner)), None)
            return [(0, len(text), 0, hit[3])] if hit else []
        if found and runs:
            runs = self._trimmed(text, runs, sorted(found), places)
        return found + runs

    def _trimmed(self, text: str, runs: list[Span], found: list[Span], places: list[tuple[int, int]]) -> list[Span]:
        """Runs that begin with the first rule's span in them; what stood before it in the run is scored on its own."""
        out, k = [], 0
        for s, e, p, r in runs:
            while k < len(found) and found[k][1] <= s:
                k += 1
            if k < len(found) and s < found[k][0] < e:
                first = found[k][0]
                out += [snapped((s + a, s + b, c, n), places) for a, b, c, n in self.random_runs(text[s:first])]
                s = first
            out.append((s, e, p, r))
        return out

    def applied(self, text: str, spans: list[Span]) -> tuple[str, Counter, int]:
        """The text with united spans as sentinels and the user's name between them as its mark; hits by rule; bytes redacted."""
        if not spans and not (self.user and self.user in text):
            return text, Counter(), 0
        out, at, users = [], 0, 0
        for s, e, _, r in [*resolved(spans), (len(text), len(text), 0, "")]:
            between = text[at:s]
            if self.user_at and self.user in between:
                between, n = self.user_at.subn(USER_MARK, between)
                users += n
            out += [between, sentinel(r) if r else ""]
            at = e
        tally = self.tally(text, spans, users)
        return "".join(out), Counter({r: n for r, n, _ in tally}), sum(size for *_, size in tally)

    def tally(self, text: str, spans: list[Span], users: int | None = None) -> list[tuple[str, int, int]]:
        """(rule, hits, bytes) of united spans; the user's name in a text counts once, with the bytes of all its places."""
        hits, size, at = Counter(), Counter(), 0
        count = users is None and bool(self.user_at)
        users = users or 0
        for s, e, _, r in resolved(spans):
            hits[r] += 1
            size[r] += len(text[s:e].encode())
            users += len(self.user_at.findall(text[at:s])) if count else 0
            at = e
        users += len(self.user_at.findall(text[at:])) if count else 0
        if users:
            hits[PATH_USER], size[PATH_USER] = 1, users * len(self.user.encode())
        return [(r, n, size[r]) for r, n in hits.items()]

    def names_secret(self, name: str) -> bool:
        return names_secret(name, self.names)

    def key_and_value(self, text: str) -> bool:
        """Whether a rule that needs a key and its value together hits a document's text."""
        low = text.lower()
        return any(any(k.lower() in low for k in r.keywords) and self.finders[self.rules.index(r)](text) for r in self.pairs)


@lru_cache(maxsize=16)
def scanner(rules: tuple[Rule, ...] = TEXT_RULES, user: str = "") -> Scanner:
    """This worker's scanner for a set of rules."""
    return Scanner(rules, user)
