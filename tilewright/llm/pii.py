"""Personal data: patterns, and disguised forms found in normalised text and mapped back to the source."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base's patterns. The lookbehind only saves starting again inside a run of digits.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like ASCII ones, in pairs.
LOOKALIKES = "аaеeоoрpсcхxуyіiјjѕsԁdɡgһhӏlԛqԝwАAВBЕEКKМMНHОOРPСCТTХXУYІIЅSαaοoνvρpιiκkΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX＠@．.。.․.﹒.﹫@＋+－-–-‐-‑-−-—-"
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
DETERMINERS = "a an the this that these those my your his her its our their each every some any no one all both".split()
#: Last labels that end a spoken address after a written dot in any case; in lower case, or after "dot", any label does.
TOP_LABELS = "com org net edu gov mil int info biz io co dev app me tv ai uk us de fr es it nl eu ch at be pl ru jp cn in br au ca example test invalid".split()

HOMOGLYPH = {a: b for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2])}
HOMOGLYPH |= {chr(0xFF10 + i): str(i) for i in range(10)} | {chr(0x660 + i): str(i) for i in range(10)}
HOMOGLYPH |= {chr(f + i): chr(a + i) for f, a in ((0xFF21, 65), (0xFF41, 97)) for i in range(26)}
HOMOGLYPH |= {chr(0x1D7CE + i): str(i % 10) for i in range(50)}
HOMOGLYPH |= {c: "" for c in "​‌‍⁠﻿­"}
ODD = re.compile("[" + re.escape("".join(HOMOGLYPH)) + "]")

_open, _close = r"[\[({<]", r"[\])}>]"
_label = r"[A-Za-z0-9-]+"
#: at and dot in brackets, as words or signs, which need no context, ...
MARKED = re.compile(rf"(?<!\s)\s*{_open}\s*(at|dot|@|\.)\s*{_close}\s*", re.I)
_local = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: (?:dot|underscore|dash) [A-Za-z0-9_%+-]+)*(?: at |@| @ )"
_domain = rf"{_label}(?:(?: dot |\.){_label})*"
#: ... and as bare words, in a whole address: with a last label that is known, ...
SPOKEN = re.compile(rf"{_local}{_domain}(?: dot |\.)(?:{'|'.join(TOP_LABELS)})(?![A-Za-z0-9])", re.I)
#: ... or with any, unless what follows at is a word that begins a phrase.
SPOKEN_ANY = re.compile(rf"{_local}(?!(?:{'|'.join(DETERMINERS)})\b){_domain}(?: dot [A-Za-z]{{2,24}}|\.(?-i:[a-z]{{2,24}}))(?![A-Za-z0-9])", re.I)
#: Four numbers with dots between them, some of them words.
SPOKEN_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9]+(?:(?: dot |\.)[0-9]+){3}(?![A-Za-z0-9])", re.I)
SPOKEN_WORD = re.compile(r" (at|dot|underscore|dash) | @ ", re.I)
_digit = "|".join(DIGIT_WORDS)
DIGITS = re.compile(rf"\b(?:{_digit}|oh)\b", re.I)
#: Digits, some of them words, with any number of separators between them.
DIGIT_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:plus\s+)?(?:(?:{_digit})\b|[0-9]+)(?:[\s,.()–—-]+(?:(?:{_digit}|oh)\b|[0-9]+)){{3,}}(?![A-Za-z0-9])", re.I)
SEPARATOR = re.compile(r"(?<=[A-Za-z0-9])[\s,.()–—-]+(?=[A-Za-z0-9])")
SYMBOL = {"at": "@", "@": "@", "dot": ".", ".": ".", "underscore": "_", "dash": "-"}


def _luhn(d: str) -> bool:
    odd = sum(map(int, d[-1::-2]))
    even = sum(x - 9 if x > 9 else x for x in (2 * int(c) for c in d[-2::-2]))
    return (odd + even) % 10 == 0


def base_spans(t: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail their test dropped; by kind, then start."""
    out: list[Span] = []
    last = 0
    if "@" in t:
        for m in EMAIL_DOMAIN.finditer(t):
            at = i = m.start()
            while i > last and t[i - 1] in LOCAL:
                i -= 1
            if i < at:
                out.append(("email", i, m.end()))
                last = m.end()
    for m in IP.finditer(t):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 16:
            d = NOT_DIGIT.sub("", m[0])
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Normalised:
    """A text with some spans replaced, and the way back: pieces in order, each (start in the new text, start
    and end in the source); a piece that is not changed maps character by character."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.starts, self.pieces, at, pos = [], [], [], 0, 0
        for s, e, new in [*edits, (len(source), len(source), "")]:
            if s > at:
                self._add(pos, at, s, False)
                parts.append(source[at:s])
                pos += s - at
            if new:
                self._add(pos, s, e, True)
            parts.append(new)
            pos += len(new)
            at = e
        self.text = "".join(parts)

    def _add(self, pos: int, s: int, e: int, changed: bool) -> None:
        self.starts.append(pos)
        self.pieces.append((s, e, changed))

    def source_span(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source characters that a span of the new text comes from, and whether any was changed."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (s, _, ci), (s2, e2, cj) = self.pieces[i], self.pieces[j]
        left = s if ci else s + start - self.starts[i]
        right = e2 if cj else s2 + end - self.starts[j]
        dropped = any(a[1] != b[0] for a, b in zip(self.pieces[i:j], self.pieces[i + 1 : j + 1]))
        return left, right, dropped or any(p[2] for p in self.pieces[i : j + 1])


def homoglyphs(t: str) -> list[tuple[int, int, str]]:
    """The edits that turn letters, digits and signs of other scripts into ASCII ones."""
    return [(m.start(), m.end(), HOMOGLYPH[m[0]]) for m in ODD.finditer(t)] if not t.isascii() else []


def words(t: str) -> list[tuple[int, int, str]]:
    """The edits of signs and digits written as words: (start, end, new text), in order, not overlapping. Cheap
    substring tests, each implied by its pattern, tell which patterns a text needs at all."""
    low = t.lower()
    words: list[tuple[int, int, str]] = []
    if any(c in low for c in "[({<"):
        words += [(m.start(), m.end(), SYMBOL[m[1].lower()]) for m in MARKED.finditer(t)]
    if " at " in low or "@" in t:
        for a in (*SPOKEN.finditer(t), *SPOKEN_ANY.finditer(t)):
            words += [(a.start() + m.start(), a.start() + m.end(), SYMBOL.get((m[1] or "at").lower(), "@")) for m in SPOKEN_WORD.finditer(a[0])]
    if " dot " in low:
        for a in SPOKEN_IP.finditer(t):
            words += [(a.start() + m.start(), a.start() + m.end(), ".") for m in SPOKEN_WORD.finditer(a[0])]
    if any(w in low for w in DIGIT_WORDS):
        for run in DIGIT_RUN.finditer(t):
            s, r = run.start(), run[0]
            if not DIGITS.search(r):
                continue
            plus = re.match(r"plus\s+", r, re.I)
            if plus:
                words.append((s, s + plus.end(), "+"))
            for m in SEPARATOR.finditer(r, plus.end() if plus else 0):
                new = "." if "." in m[0] and not re.search(r"\s", m[0]) else " "
                if m[0] not in (new, "-"):
                    words.append((s + m.start(), s + m.end(), new))
            for m in DIGITS.finditer(r):
                w = m[0].lower()
                words.append((s + m.start(), s + m.end(), "0" if w == "oh" else str(DIGIT_WORDS.index(w))))
    return _merge(words)


def _merge(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def find(t: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and the disguised ones. A disguised one holds at least one changed
    character and overlaps no base span but such of its kind as it extends. Both by kind, then start; code points, end exclusive."""
    base = base_spans(t)
    extra: list[Span] = []
    odd = homoglyphs(t)
    plain = Normalised(t, odd) if odd else None
    text = plain.text if plain else t
    edits = words(text)
    if odd or edits:
        n = Normalised(text, edits)
        for kind, s, e in base_spans(n.text):
            a, b, changed = n.source_span(s, e)
            if plain:
                a, b, odd_too = plain.source_span(a, b)
                changed = changed or odd_too
            met = [x for x in base if x[1] < b and a < x[2]]
            if changed and all(x[0] == kind and a <= x[1] and x[2] <= b and (a, b) != x[1:] for x in met):
                extra.append((kind, a, b))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *extra}, key=lambda x: (order[x[0]], x[1], x[2])) if extra else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row of docs: arrays of (kind, s, e). Null texts are empty; repeated rows stay;
    an empty table gives an empty one. Texts are handled one at a time, whole."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [find(t.as_py()) for t in b.column("text")]
            rows = [[[{"kind": k, "s": s, "e": e} for k, s, e in x[i]] for x in got] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows[0], span), pa.array(rows[1], span)], ["id", "base", "spans"])

    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    a = "array<struct<kind:string,s:int,e:int>>"
    return slim.mapInArrow(run, f"id {kind}, base {a}, spans {a}")


def redact(t: str) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(find(t)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [t[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join(out) + t[at:]


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
