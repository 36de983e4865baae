"""SimHash fingerprints and their groups by the generalised pigeonhole principle."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, text_or_empty
from .components import connected_components

BITS = 64
#: Fingerprints farther apart than this aren't worth a first comparison.
FAR = 14
#: Nodes under one key from which it is hot, and the hubs and rounds at most that then bring its groups together.
HOT, HUBS, TURNS = 1024, 8, 4
#: Shingles hashed before their bits are counted, so that very long texts need bounded memory.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, XXH64 (seed
    42) of each run of ``shingle`` words joined by spaces (repeats count; fewer words: all of them).
    A bit is 1 if it is set in over half of the hashes; no words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(w) - shingle + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        part = w[at : to + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
        hashes = np.fromiter((h64(s, 42) for s in joined), dtype="<u8", count=to - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()) if b.num_rows else []
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them. Each task
    adds up its own; the driver gets 2,080 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(BITS)
        cell = np.concatenate([i * BITS + j, [-1]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(np.concatenate([total[i, j], [n]]).astype(np.int64))], ["cell", "n"]
        )

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.cell < 0:
            n = r.n
        else:
            both[divmod(r.cell, BITS)] = both[divmod(r.cell, BITS)[::-1]] = r.n
    return n, both


def plan_partitions(n: int, both: np.ndarray, distance: int, key_cost: float = 1.0, pair_cost: float = 0.01) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds: [(bits, threshold)], sum(threshold + 1) = distance + 1.

    Two fingerprints at most ``distance`` bits apart are, in some partition, at most its threshold
    apart (generalised pigeonhole); a threshold of -1 leaves a partition out. Correlated bits go to
    the same partition: each partition starts with the bit that is least correlated with those
    taken, and takes in turn the bit most correlated with its own. For each number of partitions a
    dynamic program spreads the thresholds at least cost: keys emitted, and candidate pairs
    estimated from how often two fingerprints differ in each bit. The cheapest plan wins.
    """
    n = max(n, 1)  # without any, all plans would cost nothing and the first be taken, whatever its keys
    p = np.diag(both) / n
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, distance + 2):
        parts = _group_bits(corr, m)
        costs = []
        for bits in parts:
            near = np.zeros(len(bits) + 1)  # distribution of the number of differing bits
            near[0] = 1
            for b in bits:
                near[1:] = near[1:] * (1 - differ[b]) + near[:-1] * differ[b]
                near[0] *= 1 - differ[b]
            keys = np.cumsum([float(math.comb(len(bits), r)) for r in range(distance + 1)])
            pairs = np.cumsum(near[: distance + 1]) * n * n / 2
            costs.append([0.0] + [n * keys[t] * key_cost + pairs[t] * pair_cost for t in range(len(pairs))])
        need = distance + 1  # sum of (threshold + 1)
        table = [(0.0, [])] + [(math.inf, [])] * need
        for c in costs:
            table = [
                min(((table[s - t][0] + c[t], table[s - t][1] + [t - 1]) for t in range(min(s + 1, len(c)))), key=lambda x: x[0])
                for s in range(need + 1)
            ]
        cost, thresholds = table[need]
        if cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(parts, thresholds) if t >= 0])
    return best[1]


def _group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    left, parts, taken = set(range(BITS)), [], []
    for k in range(m):
        size = (len(left) + (m - k) - 1) // (m - k)
        first = min(left, key=lambda b: (corr[b, taken].sum() if taken else 0.0, b))
        part = [first]
        left.discard(first)
        while len(part) < size:
            nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.discard(nxt)
        parts.append(sorted(part))
        taken += part
    return parts


def _masks(bits: list[int], threshold: int) -> list[int]:
    """The values to XOR a key with to reach all keys at most threshold bits away, 0 first."""
    from itertools import combinations

    return [sum(1 << b for b in c) for r in range(threshold + 1) for c in combinations(bits, r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fps: DataFrame, plan: list[tuple[list[int], int]], probe: bool, keep: list[str]) -> DataFrame:
    """One row per fingerprint and key. part: the partition's number; key: the fingerprint's bits there,
    for probes also all values up to the threshold away."""
    parts, owns, masks = [], [], []
    for i, (bits, t) in enumerate(plan):
        flips = _masks(bits, t) if probe else [0]
        parts += [i] * len(flips)
        owns += [_signed(sum(1 << b for b in bits))] * len(flips)
        masks += map(_signed, flips)

    def listed(values: list[int]) -> Column:  # one literal, however many keys
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    every = F.transform(
        listed(masks),
        lambda m, i: F.struct(F.get(listed(parts), i).alias("part"), F.col("fp").bitwiseAND(F.get(listed(owns), i)).bitwiseXOR(m).alias("key")),
    )
    return fps.select("*", F.explode(every).alias("k")).select(*keep, "k.part", "k.key")


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def group(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fps(id, fp) -> (fp, component): component is the smallest id among all rows whose fingerprints are
    reachable by steps of at most ``distance`` bits. One row per distinct fingerprint; exact.

    Equal fingerprints are one node. First every node is compared with the smallest and the largest
    node that share a partition's bits with it, and joined with them when near; groups of near
    copies come together there with two comparisons a node. Then all nodes that share a key are
    compared, but only links between different groups leave the join, so a group of thousands of
    near copies never becomes its pairs. Keys of more than HOT nodes take more hubs and rounds before
    that, and are split by their other bits, so that no task compares all nodes of such a key.
    """
    nodes = Table(fps.groupBy("fp").agg(F.min("id").alias("id")), "sim-nodes").df
    n, both = bit_statistics(nodes)
    plan = plan_partitions(n, both, distance)
    tagged, node = nodes.select("fp", "id", F.col("fp").alias("grp")), F.struct("fp", "grp")
    own = _keys(tagged, plan, False, ["fp", "grp"])
    hot = Table(own.groupBy("part", "key").count().where(F.col("count") > HOT).select("part", "key"), "sim-hot").df
    crowded = not hot.isEmpty()

    tagged = _merged(tagged, _hub_links(own, [F.min(node), F.max(node)], distance))
    for turn in range(TURNS if crowded else 0):
        own = _keys(tagged, plan, False, ["fp", "grp"]).join(hot, ["part", "key"], "left_semi")
        hubs = [F.min_by(node, F.xxhash64("fp", F.lit(turn * HUBS + k))) for k in range(HUBS)]
        links = Table(_hub_links(own, hubs, distance).distinct(), "sim-links").df
        if links.isEmpty():
            break
        tagged = _merged(tagged, links)

    index = _keys(tagged, plan, False, ["fp", "grp"])
    probe = _keys(tagged, plan, True, [F.col("fp").alias("fp2"), F.col("grp").alias("grp2")])
    if crowded:
        key = ["part", "key"]
        met = index.join(probe.join(hot, key, "left_anti"), key)
        links = _between(met, distance).unionByName(_hot_links(*(d.join(hot, key, "left_semi") for d in (index, probe)), plan, distance))
    else:
        links = _between(index.join(probe, ["part", "key"]), distance)
    merged = _merged(tagged, links)
    smallest = merged.groupBy("grp").agg(F.min("id").alias("component"))
    return merged.join(smallest, "grp").select("fp", "component")


def _between(met: DataFrame, distance: int) -> DataFrame:
    """(grp, grp2): links between groups among pairs of nodes that met."""
    return met.where((F.col("grp") != F.col("grp2")) & (_apart("fp", "fp2") <= distance)).select("grp", "grp2")


def _hub_links(own: DataFrame, hubs: list[Column], distance: int) -> DataFrame:
    """Links between each of own(fp, grp, part, key) and its key's hubs, which are aggregates; for keys with more groups
    than one."""
    several = own.groupBy("part", "key").agg(F.array(*hubs).alias("hubs"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi")
    met = own.join(several.select("part", "key", "hubs"), ["part", "key"]).select("fp", "grp", F.explode("hubs").alias("hub"))
    return _between(met.select("fp", "grp", F.col("hub.fp").alias("fp2"), F.col("hub.grp").alias("grp2")), distance)


def _merged(tagged: DataFrame, links: DataFrame) -> DataFrame:
    """tagged(fp, id, grp) with linked groups as one, named by the smallest of them."""
    found = connected_components(links.select(F.col("grp").alias("src"), F.col("grp2").alias("dst"))).withColumnRenamed("node", "grp")
    return Table(tagged.join(found, "grp", "left").select("fp", "id", F.coalesce("component", "grp").alias("grp")), "sim-tagged").df


def _hot_links(index: DataFrame, probe: DataFrame, plan: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Links between the groups under hot keys. The bits outside a key's partition are dealt to ``distance`` + 1 parts, in
    one of which two near fingerprints are equal, so nodes meet where a part is. Probes leave out nodes
    that are all in their own group; what is still large under one such key is dealt to several tasks."""
    parts = distance + 1
    others = [[b for b in range(BITS) if b not in bits] for bits, _ in plan]
    masks = [_signed(sum(1 << b for b in rest[j::parts])) for rest in others for j in range(parts)]
    listed = F.array(*map(F.lit, masks))

    def finer(d: DataFrame, fp: str) -> DataFrame:
        every = F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda j: F.struct(j.alias("sub"), F.col(fp).bitwiseAND(F.get(listed, F.col("part") * parts + j)).alias("subkey")))
        return d.select("*", F.explode(every).alias("s")).select(*d.columns, "s.*")

    by = ["part", "key", "sub", "subkey"]
    index, probe = finer(index, "fp"), finer(probe, "fp2")
    heads = index.groupBy(by).agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    asked = probe.join(heads, by).where("lo < hi or grp2 != lo").select(*probe.columns, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = index.join(heads.select(*by, "salts"), by).select(*index.columns, F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt"))
    return _between(dealt.join(asked, [*by, "salt"]), distance)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """(id, fp, component) for each row of docs, component the smallest id of its group.

    Null and blank texts have fingerprint 0 and link like any other; repeated rows and ids are
    rows of their own with the same component; rows with a null id get a component too (the
    smallest non-null id of the group, null if there is none); an empty table gives an empty one.
    """
    fps = Table(with_fingerprints(docs, id_col, text_col, shingle), "sim-fp").df
    return fps.join(group(fps, distance), "fp").select("id", "fp", "component")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    distance: int = 6,
    similarity: float = 0.8,
) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest id.

    Documents link if the sets of their ``shingle``-word shingles have a Jaccard similarity of at
    least ``similarity``; all such pairs are found. Of rows that share the smallest id (or have
    none: null ids come last) one stays. Columns are those of docs, whatever their names; null and
    blank texts count as copies of each other; an empty table gives an empty one.

    Equal sets are one node. Nodes whose fingerprints are at most ``distance`` bits apart are found by
    generalised pigeonhole: each node probes for the smallest node under every key within the partitions'
    thresholds. Fingerprints of similar sets can be farther apart, so there is an exact way for the rest: two
    sets that are similar enough share a shingle among the rarest of each (its prefix). Every node is also
    compared with the smallest under each of its prefix keys, unless their fingerprints differ in more than FAR
    bits. All these links are verified, and groups of near copies come together; then all nodes under a
    prefix key that are still in different groups are compared, whatever their fingerprints.
    """

    @F.arrow_udf("long")
    def fp_of(texts: pa.Array) -> pa.Array:
        fps = [fingerprint(t.as_py(), shingle) for t in texts.cast(pa.binary())]
        return pa.array(np.array(fps, dtype=np.uint64).view(np.int64))

    @F.arrow_udf("struct<digest:binary,n:long,sketch:binary>")
    def set_of(texts: pa.Array) -> pa.Array:
        digests, sizes, sketches = [], [], []
        for t in texts.cast(pa.binary()):
            x = shingle_set(t.as_py(), shingle)
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            sizes.append(len(x))
            sketches.append(parity_sketch(x).tobytes())
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["digest", "n", "sketch"])

    text = text_or_empty(f"row.`{text_col}`")
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.`{id_col}`").cast("long").alias("id"), fp_of(text).alias("fp"), set_of(text).alias("set"), F.monotonically_increasing_id().alias("uid")
    )
    rows = Table(rows, "sim-rows").df
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    heads = rows.groupBy("set.digest").agg(F.min(order).alias("id")).select(F.col("id.uid").alias("uid"))
    nodes = rows.join(heads, "uid", "left_semi").select(F.col("uid").alias("node"), order.alias("id"), "fp", "set.n", "set.sketch")
    nodes = Table(nodes, "sim-nodes").df
    texts = rows.select(F.col("uid").alias("node"), text.alias("text"))
    keys = prefix_keys(texts.join(nodes, "node", "left_semi"), shingle, similarity)
    ends = keys.select("node", "key", F.min("node").over(Window.partitionBy("key")).alias("lo"), F.max("node").over(Window.partitionBy("key")).alias("hi"))
    shared = Table(ends.where("lo < hi").select("node", "key", "lo"), "sim-keys").df

    hubs = shared.where("node != lo").select("node", F.col("lo").alias("node2"))
    hubs = plausible(hubs.unionByName(probed(nodes, distance)).distinct(), nodes, similarity, FAR)
    hub_links = similar(Table(hubs, "sim-hubs").df, texts, shingle, similarity)
    first = connected_components(hub_links.select(F.col("node").alias("src"), F.col("node2").alias("dst")))
    tagged = nodes.join(first, "node", "left").select("node", "id", F.coalesce("component", "node").alias("grp"))
    tagged = Table(tagged, "sim-tagged").df

    own = shared.join(tagged.select("node", "grp"), "node").select("key", "node", "grp")
    other = own.select("key", F.col("node").alias("node2"), F.col("grp").alias("grp2"))
    pairs = own.join(other, "key").where("node < node2 and grp != grp2").select("node", "node2", "grp", "grp2").distinct()
    links = similar(Table(plausible(pairs, nodes, similarity), "sim-pairs").df, texts, shingle, similarity)
    second = connected_components(links.select(F.col("grp").alias("src"), F.col("grp2").alias("dst")))
    merged = tagged.join(second.withColumnRenamed("node", "grp"), "grp", "left").select("id", F.coalesce("component", "grp").alias("root"))
    heads = merged.groupBy("root").agg(F.min("id").alias("id")).select(F.col("id.uid").alias("uid"))
    return rows.join(heads, "uid", "left_semi").select("row.*")


def probed(nodes: DataFrame, distance: int) -> DataFrame:
    """(node, node2): for each row of nodes(node, fp) the smallest node with each key that it probes for, of those at most
    ``distance`` bits away."""
    n, both = bit_statistics(nodes)
    plan = plan_partitions(n, both, distance)
    least = _keys(nodes, plan, False, ["node", "fp"]).groupBy("part", "key").agg(F.min("node").alias("node2"), F.min_by("fp", "node").alias("fp2"))
    met = _keys(nodes, plan, True, ["node", "fp"]).join(least, ["part", "key"])
    return met.where((F.col("node") != F.col("node2")) & (_apart("fp", "fp2") <= distance)).select("node", "node2")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of the distinct word shingles, sorted; of all words if they are fewer."""
    w = text.lower().split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    return np.array(sorted({xxhash.xxh64_intdigest(g, 42) for g in grams}), dtype=np.uint64)


def frequent_shingles(texts: DataFrame, shingle: int, one_in: int = 16, least: int = 8, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, sorted, and their counts, from one text in ``one_in``. They only decide
    which shingles come last in a set's order, so no pair depends on what the sample has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column("text").cast(pa.binary())]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["sh"])

    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).select("text")
    got = sample.mapInArrow(run, "sh long").groupBy("sh").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    got = got.orderBy(F.desc("n"), "sh").limit(most).toArrow()
    sh, n = got.column("sh").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64)
    by = np.argsort(sh)
    return sh[by], n[by]


def prefix_length(size: int, similarity: float) -> int:
    """So many shingles of a set, first in any order that all sets share, hold one of each set this similar."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def prefix_keys(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, text) -> (node, key): the prefix of each set, rare shingles first."""
    known, times = frequent_shingles(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").cast(pa.binary()):
                sh = shingle_set(t.as_py(), shingle)
                n = prefix_length(len(sh), similarity)
                if len(known):
                    at = np.minimum(np.searchsorted(known, sh), len(known) - 1)
                    sh = sh[np.lexsort((sh, np.where(known[at] == sh, times[at], 0)))]
                out.append(sh[:n])
            if out:
                node = np.repeat(b.column("node").to_numpy(), [len(x) for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(out).view(np.int64))], ["node", "key"])

    return texts.select("node", "text").mapInArrow(run, "node long, key long")


def parity_sketch(sh: np.ndarray) -> np.ndarray:
    """A bit for each residue of the hashes modulo a power of two, about one for each shingle: whether their number
    is odd. Two sets differ in at least as many shingles as their sketches in bits. Bytes, to be folded in half."""
    m = 1 << max(6, (len(sh) - 1).bit_length())
    return np.packbits(np.bincount((sh & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little")


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles in one set only, at least, by the sets' sketches."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float, distance: int = BITS) -> DataFrame:
    """The rows of pairs(node, node2, ..) that sizes, sketches and the fingerprints' distance don't exclude. No pair that
    is similar enough is excluded by its sizes or sketches: a similarity of s allows (1 - s) / (1 + s) of
    all shingles to differ."""
    names = pairs.columns
    slim = nodes.select("node", "n", "fp")
    second = lambda d: d.select(*[F.col(c).alias(c + "2") for c in d.columns])
    sized = pairs.join(slim, "node").join(second(slim), "node2")
    sized = sized.where((F.least("n", "n2") + 1e-9 >= similarity * F.greatest("n", "n2")) & (_apart("fp", "fp2") <= distance))
    known = nodes.select("node", "sketch")
    both = Table(sized.select(*names, (F.col("n") + F.col("n2")).alias("all")), "sim-sized").df.join(known, "node").join(second(known), "node2")
    part = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("all").to_pylist(), b.column("sketch"), b.column("sketch2"))
            keep = [least_difference(*(np.frombuffer(x.as_py(), np.uint8) for x in (s, s2))) <= n * part + 1e-6 for n, s, s2 in rows]
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return both.select(*names, "all", "sketch", "sketch2").mapInArrow(run, pairs.schema)


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows of pairs(node, node2, ..) whose texts' sets are similar enough. Only texts of pairs are moved."""
    names = pairs.columns
    needed = pairs.select("node").union(pairs.select("node2")).distinct()
    known = texts.join(needed, "node", "left_semi")
    both = pairs.join(known, "node").join(known.select(F.col("node").alias("node2"), F.col("text").alias("text2")), "node2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(256)(lambda t: shingle_set(t, shingle))
        for b in batches:
            keep = []
            for t, t2 in zip(b.column("text").cast(pa.binary()), b.column("text2").cast(pa.binary())):
                x, y = sets(t.as_py()), sets(t2.as_py())
                short = min(len(x), len(y)) + 1e-9 < similarity * max(len(x), len(y))
                same = 0 if short else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same + 1e-9 >= similarity * (len(x) + len(y) - same))
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return both.select(*names, "text", "text2").mapInArrow(run, pairs.schema)
