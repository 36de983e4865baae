"""Secret scanning. DataFrame functions only: every text is handled within its row, without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The patterns of the base, with the least length of what they must match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "entropy")

#: What the entropy scan looks at: runs of these characters of at least WINDOW.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Least entropy of a window, in bits a character, by the narrowest class that holds the whole run. A window
#: of 20 random characters has about 3.3 (hex digits) or 4.1 (the others); prose without spaces has under 3.7.
CLASSES = (
    ("^[0-9]+$", math.inf),
    ("^[0-9a-fA-F]+$", 2.9),
    ("^[a-z]+$|^[A-Z]+$", 4.2),
    ("^[A-Za-z]+$", 4.0),
    ("", 3.75),
)
#: A part of a name: a word in one case or with a capital.
_PART = "(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})"
#: Runs that match one of these are no secrets, however random: UUIDs, dates, paths, names in snake or kebab
#: case, data URIs' media types, digests that say what they are, and one or two characters repeated.
ALLOWED = (
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T-]*$",
    f"^/?{_PART}(?:/{_PART})++/?$",
    f"^_*{_PART}(?:[_-]+{_PART})++$",
    "^(md5|sha1|sha256|sha384|sha512)-",
    "^(.)(.)(?!.*?(?!\\1|\\2).)",
)

_SPAN = "array<struct<s:int,e:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(t: Column, pattern: str) -> Column:
    """Start and end, in code points, of the leftmost non-overlapping matches: the lengths of what lies
    between matches and of the matches, summed up. All matches, in order."""
    gaps, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        e = s + F.coalesce(x["h"], F.lit(0))
        more = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["h"].isNull(), a["out"]).otherwise(F.concat(a["out"], more)).alias("out"))

    found = F.aggregate(sizes, start, step, lambda a: a["out"])
    return F.when(F.rlike(t, F.lit(pattern)), found).otherwise(_none())


def max_window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of the windows of a run of ALPHABET characters.

    Counts are incremental: a step adds the character that comes in and takes out the one that
    leaves, and changes the sum of c * log2(c) only by these two.
    """
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.array().cast("array<int>").alias("last")
    )

    def step(a: Column, c: Column) -> Column:
        full = F.size(a["last"]) >= window
        out = F.when(full, F.get(a["last"], F.lit(0))).otherwise(F.lit(-1))
        c_in, c_out = F.get(a["n"], c), F.get(a["n"], out)
        unchanged = out == c
        gain = F.get(table, c_in + 1) - F.get(table, c_in)
        loss = F.when(full, F.get(table, c_out) - F.get(table, c_out - 1)).otherwise(F.lit(0.0))
        total = F.when(unchanged, a["sum"]).otherwise(a["sum"] + gain - loss)
        n = F.transform(
            a["n"], lambda x, i: x + F.when(i == c, F.lit(1)).otherwise(F.lit(0)) - F.when(i == out, F.lit(1)).otherwise(F.lit(0))
        )
        last = F.concat(F.when(full, F.slice(a["last"], 2, window)).otherwise(a["last"]), F.array(c))
        entropy = F.lit(math.log2(window)) - total / F.lit(float(window))
        best = F.when(F.size(last) >= window, F.greatest(a["best"], entropy)).otherwise(a["best"])
        return F.struct(n.alias("n"), total.alias("sum"), best.alias("best"), last.alias("last"))

    return F.aggregate(codes, zero, step, lambda a: a["best"])


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """(id, row, base, spans) for each row of docs: row is a struct of the kept columns (null if none are kept), base and
    spans are arrays of (s, k, e): start, number in KINDS and end of each secret, by start, then kind; code points, end
    exclusive.

    base has the pattern matches. spans adds candidate runs in which some window's entropy reaches its class's
    threshold, unless the run is allow-listed. Base matches are cut out of the runs first, and what is left
    of WINDOW characters or more is a candidate of its own. Null texts are empty; repeated rows stay; an
    empty table gives an empty one; kept columns may have any name.
    """
    t, row = F.col("t"), F.struct(*[F.col(f"`{k}`") for k in keep]) if keep else F.lit(None).cast("int")
    d = docs.select(F.col(id_col).alias("id"), row.alias("row"), text_or_empty(text_col).alias("t"))
    d = d.select(
        "id", "row", "t",
        _spans(t, ASSIGN).alias("assign"),
        F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)).alias("values"),
        _spans(t, ACCESS).alias("access"), _spans(t, HEX).alias("hex"), _spans(t, CANDIDATE).alias("runs"),
    )
    tag = lambda name, k: F.transform(name, lambda x: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e")))
    long_enough = F.filter("assign", lambda x, i: F.length(F.get("values", i)) >= ASSIGN_MIN)
    d = d.select(
        "id", "row", "t", "runs",
        F.sort_array(F.concat(tag(long_enough, 0), tag("access", 1), tag("hex", 2))).alias("base"),
    )
    free = F.flatten(F.transform("runs", lambda r: _without(r, F.col("base"))))
    d = d.select("id", "row", "base", F.transform(free, lambda r: F.struct(r.s.alias("s"), r.e.alias("e"), F.substring(t, r.s + 1, r.e - r.s).alias("v"))).alias("runs"))

    def random_looking(v: Column) -> Column:
        least = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES):
            least = F.when(F.rlike(v, F.lit(pattern)), F.lit(bits)).otherwise(least)
        return max_window_entropy(v) >= least

    passed = F.filter("runs", lambda r: ~_any(r.v, allowed))
    added = F.filter(passed, lambda r: random_looking(r.v))
    return d.select(
        "id", "row", "base",
        F.when(F.size("runs") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", tag(added, 3)))).alias("spans"),
    )


def _without(run: Column, base: Column) -> Column:
    """What base spans, ordered by start, leave of a run: its pieces of at least WINDOW characters."""
    piece = lambda s, e: F.when(e - s >= WINDOW, F.array(F.struct(s.alias("s"), e.alias("e")))).otherwise(_none())

    def step(a: Column, b: Column) -> Column:
        out = F.concat(a["out"], piece(a["at"], F.least(b.s, run.e)))
        return F.struct(F.greatest(a["at"], b.e).alias("at"), out.alias("out"))

    start = F.struct(run.s.alias("at"), _none().alias("out"))
    met = F.filter(base, lambda b: (b.s < run.e) & (run.s < b.e))
    cut = F.aggregate(met, start, step, lambda a: F.concat(a["out"], piece(a["at"], run.e)))
    return F.when(F.exists(base, lambda b: (b.s < run.e) & (run.s < b.e)), cut).otherwise(F.array(run))


def _any(v: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.rlike(v, F.lit(p))
    return hit


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s, x.e)), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x.k == KINDS.index(kind))).cast("long")
