"""Line dedup by an exact set-similarity join. DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, Table, freed_shuffles, text_or_empty

#: Words are counted in so many hash buckets; a level of rarity for each is all that the driver sees of them.
BUCKETS = 1 << 17
#: Levels of rarity for each doubling of a count. They stay below 128, one byte each.
LEVELS = 4
#: Of a token's 63 sort bits the high ones are its level of rarity and so many are its hash.
HASH_BITS = 56
#: A row of the join packs the line's number, done, its number of tokens and the token's place into one long of
#: these bits. Longer lines count as of LONG tokens and are excluded by nothing that needs more.
DONE_AT, SIZE_AT, PLACE_BITS = 22, 10, 10
LONG, FAR = (1 << DONE_AT - SIZE_AT) - 1, (1 << PLACE_BITS) - 1
#: Numbers of lines stay below this, so that a row of the join holds them; doubles do too.
MOST_LINES = 1 << 63 - DONE_AT - 1
#: Of the lines under one token so many first ones, by a hash of their numbers, are compared with all others.
HUBS = 16
#: Lines of so many tokens have a sketch of 128 and of 256 bits beside that of 64, which lets one in thousands of
#: unlike pairs of 70 tokens through and tells nothing of lines of 150.
WIDE, WIDER = 56, 120
#: The tokens of the prefixes are joined in so many passes, by hash, each of which frees its shuffle before the next.
PASSES = 2
SKETCHES = ("sketch", "s1", "s2", "s3")
#: Bytes of the map, 7 bits each, that says which lines may be among some others. It only spares shuffles.
MAP_BYTES = 1 << 17


def _byte_at(table: bytes, at: Column) -> Column:
    """The byte, below 128, at a place of a table that is part of the plan."""
    return F.ascii(F.substring(F.lit(table), at + 1, 1).cast("string"))


def rarity_levels(lines: DataFrame) -> bytes:
    """For each bucket the logarithm of how many words of all lines fall in it. Tokens are put in this order, so it
    decides how many pairs are compared, not which are found."""
    parts = F.explode(F.split("line", " "))  # with empty ones, which count for nothing here
    at = lines.select(parts.alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("at"))
    rows = BUCKETS >> 2  # of four counts each: a table of fewer rows stays in the processor's cache
    counts = [F.count(F.when(F.shiftright("at", rows.bit_length() - 1) == k, 1)).alias(f"c{k}") for k in range(4)]
    four = at.groupBy(F.col("at").bitwiseAND(F.lit(rows - 1)).alias("row")).agg(*counts)
    each = F.inline(F.array(*[F.struct((F.col("row") + k * rows).cast("int").alias("b"), F.col(f"c{k}").alias("count")) for k in range(4)]))
    level = F.least(F.floor(F.log2(F.col("count") + 1) * LEVELS), F.lit(127)).cast("int")
    packed = four.select(each).groupBy(F.shiftright("b", 8).alias("block")).agg(F.collect_list(F.shiftleft(F.col("b").bitwiseAND(F.lit(255)), 7).bitwiseOR(level)).alias("of"))
    levels = bytearray(BUCKETS)
    with freed_shuffles(lines.sparkSession):
        for r in packed.collect():
            for x in r.of:
                levels[r.block << 8 | x >> 7] = x & 127
    return bytes(levels)


def _spaced(text: Column) -> Column:
    """text with a space for each other white space but newlines. Its lines have the same words, and splitting at one
    plain character takes half the time of splitting at a class of them."""
    return F.when(F.rlike(text, F.lit(r"[\x09\x0B-\x0D]")), F.translate(text, "\t\v\f\r", "    ")).otherwise(text)


def _words(line: Column) -> Column:
    """words() of a line of a _spaced() text."""
    return F.array_remove(F.split(line, " "), "")


def _tokens(line: Column, levels: bytes) -> Column:
    """The set of a line's words as longs, sorted by rarity: level, then hash."""

    def one(h: Column) -> Column:
        level = _byte_at(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long")
        return F.shiftleft(level, HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    hashes = F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, one))


def _sketch(tokens: Column, *bits: int) -> Column:
    """64 bits, one flipped by each token whose bits at these places are all set: sets that differ in few tokens
    differ in few bits."""

    def flipped(a: Column, x: Column) -> Column:
        one = reduce(Column.bitwiseAND, [F.shiftright(x, b) for b in bits]).bitwiseAND(F.lit(1)) if bits else F.lit(1)
        return a.bitwiseXOR(F.call_function("shiftleft", one.cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(tokens, F.lit(0).cast("long"), flipped)


def _parts(tokens: Column) -> list[Column]:
    """Sketches of the tokens with one bit, another one, and both: with that of all they give a sketch of 128 bits
    (the first of them) or of 256. 0 for lines that have none."""
    parts = ((WIDE, (6,)), (WIDER, (7,)), (WIDER, (6, 7)))
    return [F.when(F.size(tokens) >= least, _sketch(tokens, *bits)).otherwise(0).alias(f"s{k + 1}") for k, (least, bits) in enumerate(parts)]


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often use has it in a lambda."""
    return F.transform(F.array(value), use)[0]


def _ceil(n: Column, share: Fraction) -> Column:
    return F.floor((n * share.numerator + (share.denominator - 1)) / share.denominator).cast("int")


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a document: its id, for null ids the largest long, and a hash of id and text. Rows with the same id
    and text are one document: the same lines go in each."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return d.alias("d"), F.xxhash64(F.lit("doc"), F.col(id_col).cast("string"), text_or_empty(text_col)).alias("key")


class _ById:
    """Lines are numbered by their texts' ids, each of which has room for the longest text's lines."""

    uses = ("d",)

    def __init__(self, least: int, width: int):
        self.least, self.width = least, width

    def of(self, texts: DataFrame) -> tuple[DataFrame, Column]:
        """texts with what numbers need, and the number of line l."""
        return texts, (F.col("d") - self.least) * self.width + F.col("l")

    def places(self, ords: DataFrame) -> DataFrame:
        """(d, l) of the lines with these numbers."""
        d = F.floor(F.col("ord") / self.width)  # exact: numbers stay below MOST_LINES
        return ords.select((d + self.least).alias("d"), (F.col("ord") - d * self.width).cast("int").alias("l"))


class _ByRank:
    """Lines are numbered densely, but where texts share an id: these take turns, and each has room for the longest."""

    uses = ("base", "m", "r")

    def __init__(self, docs: DataFrame, parts: int):
        self.parts = parts
        docs = self._in_order(docs, "d", "key")
        docs = docs.join(self._before(docs, F.count("*")), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")
        ids = docs.groupBy("d").agg(F.min("rank").alias("first"), F.count("*").alias("m"), F.max("n").alias("width"))
        ids = self._in_order(ids.withColumn("span", F.col("m") * F.col("width")).drop("width"), "d")
        within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        base = F.col("before") + F.coalesce(F.sum("span").over(within), F.lit(0))
        ids = ids.join(self._before(ids, F.sum("span")), "part").select("d", "first", "m", base.alias("base"))
        self.docs = Table(docs.join(ids, "d").select("d", "key", "n", "base", "m", (F.col("rank") - F.col("first")).alias("r")), "lines-docs").df

    def _in_order(self, rows: DataFrame, *by: str) -> DataFrame:
        """rows with the part of the order of these columns that they lie in and the place there."""
        at = Table(rows.repartitionByRange(self.parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "lines-order").df
        return at.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")

    def _before(self, rows: DataFrame, what: Column) -> DataFrame:
        """(part, before): what all earlier parts have."""
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        counted = rows.groupBy("part").agg(what.alias("has")).select("part", F.coalesce(F.sum("has").over(earlier), F.lit(0)).alias("before"))
        return F.broadcast(Table(counted, "lines-parts").df)

    def of(self, texts: DataFrame) -> tuple[DataFrame, Column]:
        return texts.join(self.docs.drop("n"), ["d", "key"]), F.col("base") + F.col("l") * F.col("m") + F.col("r")

    def places(self, ords: DataFrame) -> DataFrame:
        """(d, key, l) of the lines with these numbers."""
        every = self.docs.select("d", "key", "base", "m", "r", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("l"))
        return every.select("d", "key", "l", (F.col("base") + F.col("l") * F.col("m") + F.col("r")).alias("ord")).join(ords, "ord").select("d", "key", "l")


class _Join:
    """The lines of docs by which each line that has words is represented, and the pairs of them that are similar."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, similarity: str):
        self.t = Fraction(similarity)
        self.lo, self.hi = self.t.numerator, self.t.denominator
        self.texts = docs.select(*_named(docs, id_col, text_col), text_or_empty(text_col).alias("text"))
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.numbers = self._numbers()
        self.lines = self._lines()

    def _numbers(self) -> _ById | _ByRank:
        """How lines are numbered in the order of (id, line): ids that name one text each and lie close together give
        the numbers by themselves, others are ranked."""
        docs = self.texts.select("d", "key", F.size(F.split("text", "\n")).cast("long").alias("n"))
        ids = docs.groupBy("d").agg(F.max("n").alias("n"), (F.min("key") < F.max("key")).alias("shared"))
        with freed_shuffles(docs.sparkSession):
            r = ids.agg(F.min("d").alias("least"), F.max("d").alias("most"), F.max("n").alias("width"), F.bool_or("shared").alias("shared")).first()
        if r.least is None or not r.shared and (r.most - r.least + 1) * r.width < MOST_LINES:
            return _ById(r.least or 0, r.width or 1)
        return _ByRank(docs.groupBy("d", "key").agg(F.max("n").alias("n")), self.parts)

    def _lines(self) -> Table:
        """(line, ord): each line that has words once, with the number of its first place."""
        placed, ord_ = self.numbers.of(self.texts)
        every = placed.select(*self.numbers.uses, F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("l", "line"))
        return Table(every.where(F.trim("line") != "").select("line", ord_.alias("ord")).groupBy("line").agg(F.min("ord").alias("ord")), "lines-first")

    def prefixes(self) -> Table:
        """(ord, n, sketch, s1, s2, s3, prefix): the lines' numbers of tokens, sketches and rarest tokens."""
        levels = rarity_levels(self.lines.df)
        sets = self.lines.df.select("ord", _tokens(F.col("line"), levels).alias("toks"))
        n = F.size("toks")
        return Table(sets.select("ord", n.alias("n"), _sketch(F.col("toks")).alias("sketch"), *_parts(F.col("toks")), F.slice("toks", 1, n - _ceil(n, self.t) + 1).alias("prefix")), "lines-prefixes")

    def _sketches_allow(self, na: Column, nb: Column, a: list[Column], b: list[Column]) -> Column:
        """What sketches allow: similar sets differ in at most (1 - t) / (1 + t) of n1 + n2."""
        d, d1, d2, d3 = (x.bitwiseXOR(y) for x, y in zip(a, b))
        wide = F.bit_count(d.bitwiseXOR(d1)) + F.bit_count(d1)
        wider = F.bit_count(d.bitwiseXOR(d1).bitwiseXOR(d2).bitwiseXOR(d3)) + F.bit_count(d1.bitwiseXOR(d3)) + F.bit_count(d2.bitwiseXOR(d3)) + F.bit_count(d3)
        by, most = self.hi + self.lo, (na + nb) * (self.hi - self.lo)
        return (F.bit_count(d) * by <= most) & ((na < WIDE) | (nb < WIDE) | (wide * by <= most)) & ((na < WIDER) | (nb < WIDER) | (wider * by <= most))

    def first_by_hubs(self, prefixes: DataFrame) -> DataFrame:
        """(ord): lines that are similar to one of up to HUBS early lines with one of the same two last tokens of the
        prefix. Each line has so few partners that one with thousands of variants never becomes their pairs, and
        the join puts out similar ones only."""
        own, theirs = ["n", *SKETCHES], ["bn", *(f"b{k}" for k in SKETCHES)]
        ends = F.slice("prefix", F.greatest(F.size("prefix") - 1, F.lit(1)), 2)
        sig = prefixes.select("ord", *own, F.explode(ends).alias("tok"))
        first = [F.min("ord").alias("by"), *[F.min_by(k, "ord").alias(b) for k, b in zip(own, theirs)]]
        hubs = sig.groupBy("tok", F.pmod(F.xxhash64("ord"), F.lit(HUBS)).alias("k")).agg(*first).drop("k")
        (n, *s), (bn, *bs) = map(F.col, own), map(F.col, theirs)
        near = (F.col("by") < F.col("ord")) & (n * self.hi >= bn * self.lo) & (bn * self.hi >= n * self.lo) & self._sketches_allow(n, bn, s, bs)
        return self._verified(sig.join(hubs, "tok").where(near).select("ord", "by").distinct())

    def by_prefixes(self, prefixes: Table, done: DataFrame) -> DataFrame:
        """(ord): lines not in done that are similar to an earlier line. prefixes are dropped.

        The prefixes of both share a token. The places of the token in both lines bound what they can share, so
        that of the shorter one is among its first n - ceil(2t / (1 + t) * n) + 1. Both sides of the join are the
        same rows, which are shuffled once.
        """
        lo, hi = self.lo, self.hi
        flagged = _marked(prefixes.df, done)
        n = F.col("n").cast("long")
        line = F.shiftleft("ord", DONE_AT + 1).bitwiseOR(F.shiftleft(F.col("gone").cast("long"), DONE_AT)).bitwiseOR(F.shiftleft(F.least(n, F.lit(LONG)), SIZE_AT))
        lines = flagged.select("prefix", *SKETCHES, line.alias("line"))

        def rows(k: int) -> DataFrame:
            placed = lines.select(*SKETCHES, "line", F.posexplode("prefix").alias("pos", "tok"))
            return placed.where(F.pmod("tok", F.lit(PASSES)) == k).select("tok", *SKETCHES, F.col("line").bitwiseOR(F.least(F.col("pos").cast("long"), F.lit(FAR))).alias("at"))

        def read(s: str) -> tuple[Column, Column, Column, Column]:
            at = F.col(f"{s}.at")
            return F.shiftright(at, DONE_AT + 1), F.shiftright(at, SIZE_AT).bitwiseAND(F.lit(LONG)), at.bitwiseAND(F.lit(FAR)), F.shiftright(at, DONE_AT).bitwiseAND(F.lit(1))

        (x, nx, px, gx), (y, ny, py, gy) = read("x"), read("y")
        alike = (
            ((ny < nx) | ((ny == nx) & ((y < x) | ((nx == LONG) & (y != x)))))
            & (nx * lo <= ny * hi)
            & ((nx == LONG) | (F.least(nx - px, ny - py) * (hi + lo) >= (nx + ny) * lo))
            & self._sketches_allow(nx, ny, *[[F.col(f"{side}.{k}") for k in SKETCHES] for side in "xy"])
            & (F.when(x > y, gx).otherwise(gy) == 0)
        )
        found = []
        for k in range(PASSES):
            near = rows(k).alias("x").join(rows(k).alias("y"), F.col("x.tok") == F.col("y.tok")).where(alike)
            found.append(Table(near.select(F.greatest(x, y).alias("ord"), F.least(x, y).alias("by")).distinct(), "lines-near"))
        out = self._verified(reduce(DataFrame.union, [t.df for t in found]).distinct())
        for t in (prefixes, *found):
            t.drop()
        return out

    def _verified(self, found: DataFrame) -> DataFrame:
        """(ord): the lines whose words are similar enough to those of their partner."""
        pairs = Table(found, "lines-pairs")
        either = Table(pairs.df.select("ord").union(pairs.df.select("by")).distinct(), "lines-needed")
        maybe = _in_map(_map_of(either.df, F.xxhash64("ord")), F.xxhash64("ord"))
        known = Table(self.lines.df.where(maybe).join(either.df, "ord"), "lines-texts")
        both = pairs.df.join(known.df, "ord").join(known.df.select(F.col("ord").alias("by"), F.col("line").alias("other")), "by")
        sets = F.struct(F.array_distinct(_words(F.col("line"))).alias("a"), F.array_distinct(_words(F.col("other"))).alias("b"))
        similar = _once(sets, lambda s: F.size(F.array_intersect(s.a, s.b)) * (self.hi + self.lo) >= (F.size(s.a) + F.size(s.b)) * self.lo)
        out = Table(both.where(similar).select("ord").distinct(), "lines-similar").df
        for spent in (pairs, either, known):
            spent.drop()
        return out


def _map_of(rows: DataFrame, h: Column) -> bytes:
    """A map with a bit for each hash."""
    bit = F.call_function("shiftleft", F.lit(1), F.pmod(F.shiftright(h, 32), F.lit(7)).cast("int"))
    found = rows.groupBy(F.pmod(h, F.lit(MAP_BYTES)).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits"))
    packed = found.groupBy(F.shiftright("at", 8).alias("block")).agg(F.collect_list(F.shiftleft(F.col("at").bitwiseAND(F.lit(255)), 7).bitwiseOR(F.col("bits"))).alias("of"))
    table = bytearray(MAP_BYTES)
    with freed_shuffles(rows.sparkSession):
        for r in packed.collect():
            for x in r.of:
                table[r.block << 8 | x >> 7] = x & 127
    return bytes(table)


def _in_map(table: bytes, h: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1), F.pmod(F.shiftright(h, 32), F.lit(7)).cast("int"))
    return _byte_at(table, F.pmod(h, F.lit(MAP_BYTES)).cast("int")).bitwiseAND(bit) != 0


def _marked(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows with gone, 1 if their ord is in some, whose ords are distinct, else 0. Only rows that the map can't tell
    are shuffled."""
    maybe = _in_map(_map_of(some, F.xxhash64("ord")), F.xxhash64("ord"))
    told = rows.where(maybe).join(some.select("ord", F.lit(1).alias("gone")), "ord", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    return told.unionByName(rows.where(~maybe).withColumn("gone", F.lit(0)))


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: str = "0.8") -> DataFrame:
    """(d, key, kept): for each document, as _named() names them, the sorted numbers (from 0) of its lines with words
    that stay. Documents without any have no row. Where d names one text each there is no key.

    A line goes if an earlier one, by (id, line), is the same or has a set of words with a Jaccard
    similarity of at least ``similarity``. Lines without words stay and are compared with none.

    Equal lines are one class, represented by the earliest. Its tokens are put in rarity order and
    classes are joined on the tokens of their prefixes; lengths, positions and sketches exclude nearly
    all other pairs within the join; what is left is verified on the words. To remove a line one
    earlier match is enough, so those that match the first line of a group need no further partner.
    Lines are shuffled once and kept; after that only those that are candidates are joined.
    """
    join = _Join(docs, id_col, text_col, similarity)
    prefixes = join.prefixes()
    done = join.first_by_hubs(prefixes.df)
    gone = done.union(join.by_prefixes(prefixes, done))  # lines in done are in no other pair
    stay = _marked(join.lines.df.select("ord"), gone).where("gone = 0").select("ord")
    places = join.numbers.places(stay)
    by = [c for c in places.columns if c != "l"]
    kept = Table(places.groupBy(*by).agg(F.sort_array(F.collect_list("l")).alias("kept")), "lines-kept").df
    join.lines.drop()
    return kept


def _flags(kept: Column) -> Column:
    """From sorted numbers an array that is true at their places. It ends at the last."""
    gaps = F.transform(kept, lambda k, i: k - F.when(i == 0, -1).otherwise(F.get(kept, i - 1)) - 1)
    return F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))


def _stays(line: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | ~F.rlike(line, F.lit(WORD))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: str = "0.8") -> DataFrame:
    """(id, n_lines, removed): removed is the sorted array of the numbers of the lines to remove, one row per row
    of docs. n_lines counts the parts between newlines; null and empty texts are one empty line.
    Null ids come last in the order; an empty table gives an empty one."""
    kept = kept_lines(docs, id_col, text_col, similarity)
    parts = F.split(text_or_empty(text_col), "\n")
    worded = F.filter(F.transform(parts, lambda x, i: F.when(F.rlike(x, F.lit(WORD)), i)), lambda i: i.isNotNull())
    slim = docs.select(F.col(id_col).alias("id"), *_named(docs, id_col, text_col), F.size(parts).cast("long").alias("n_lines"), worded.alias("worded"))
    removed = F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>")))
    return slim.join(kept, kept.columns[:-1], "left").select("id", "n_lines", removed.alias("removed"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: str = "0.8") -> DataFrame:
    """docs with the repeated lines taken out of the texts; all rows and columns stay, whatever their names.
    Texts without a line to remove, null ones too, are as they were."""
    kept = kept_lines(docs, id_col, text_col, similarity)
    keyed = docs.select(F.struct("*").alias("row"), *_named(docs, id_col, text_col)).join(kept, kept.columns[:-1], "left")
    parts = F.split(F.col(f"row.`{text_col}`"), "\n")
    flags = _flags(F.coalesce("kept", F.array().cast("array<int>")))
    left = F.array_join(_once(flags, lambda f: F.filter(parts, lambda x, i: _stays(x, F.get(f, i)))), "\n")
    return keyed.select(F.col("row").withField(f"`{text_col}`", left).alias("row")).select("row.*")
