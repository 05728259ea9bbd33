"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into segments so few that, within the distance asked for,
one segment of two linked fingerprints differs by at most one bit. Each
segment is indexed under its one-wildcard variants (one bit deleted), equal
variants join, and the whole fingerprints are then compared.

The pipeline's stage links what fingerprints link, if the shingles agree. It asks
for a similarity that lies far beyond such distances, so texts also meet in
bands of smallest hashes; the shingles of all that meet are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, release
from .components import components
from .groups import links_within

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Variant groups up to this size are joined with themselves; larger ones are linked in linear size.
PAIRS_UP_TO = 32


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words of the lower-cased text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1))
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())), np.uint64, n - shingle + 1)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """Hash ``i`` of a family; hash 0 is ``h`` itself."""
    if not i:
        return h
    x = h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; without hashes zero. Signed, as Spark holds it."""
    if not len(h):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(h).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8").astype(np.uint64).view(np.int64)[0])


def fingerprints(docs: DataFrame, key: list[Column], text: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """One row per row of ``docs``: the columns ``key`` and f0, f1, ... (64 bits of the fingerprint each)."""
    names = [f"f{i}" for i in range(words)]
    narrow = docs.select(*key, F.col(text).alias("_text"))
    keys = narrow.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((words, batch.num_rows), np.int64)
            for row, one in enumerate(batch.column(len(keys))):
                hashes = shingle_hashes(one.as_py(), shingle)
                for i in range(words):
                    out[i, row] = majority(_mixed(hashes, i))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=[*keys, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + [f"{n} long" for n in names])
    return narrow.mapInArrow(run, schema)


def _distance(a: str, b: str, names: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{n}").bitwiseXOR(F.col(f"{b}.{n}"))) for n in names[1:]), F.bit_count(F.col(f"{a}.{names[0]}").bitwiseXOR(F.col(f"{b}.{names[0]}"))))


def _variants(prints: DataFrame, names: list[str], width: int) -> DataFrame:
    """(key, node): every segment of ``width`` bits with each of its bits deleted in turn; a key holds its segment and bit."""
    per_word = 64 // width
    segments = F.expr("array(" + ", ".join(f"shiftrightunsigned({n}, {i * width}) & {2**width - 1}L" for n in names for i in range(per_word)) + ")")
    return (
        prints.select("node", F.posexplode(segments).alias("seg", "bits"))
        .select("node", "seg", "bits", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit"))
        .select(F.expr(f"shiftleft(cast(seg * {width} + bit as long), {width}) | (bits & ~shiftleft(1L, bit))").alias("key"), "node")
    )


def _near(asked: DataFrame, prints: DataFrame, names: list[str], max_bits: int) -> DataFrame:
    if len(names) == 1:  # the node is the fingerprint
        return asked.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return (
        asked.join(prints.alias("a"), F.col("u") == F.col("a.node")).join(prints.alias("b"), F.col("v") == F.col("b.node"))
        .filter(_distance("a", "b", names) <= max_bits).select("u", "v")
    )


def links(prints: DataFrame, max_bits: int, width: int, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(u, v): links that join all fingerprints within ``max_bits`` that meet in a variant.

    ``prints``: node (long) and f0, f1, ..., one row per fingerprint. With
    2 * segments > max_bits every such pair meets; otherwise wide distances are
    met with a probability. Variants held by one fingerprint alone are counted
    out before anything is joined. At distance 2 a small group is joined with
    itself; in a large one, fingerprints within two bits share a neighbour one
    bit away and those that share one are within two bits, so each is linked
    with the smallest of its neighbour: exact, and linear in the group. At wider
    distances every pair of a group is compared or joined through others.
    """
    names = [c for c in prints.columns if c != "node"]
    variants = _variants(prints, names, width)
    held = variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut_lineage(variants.join(held, "key"))
    if max_bits == 2 and len(names) == 1:
        small, large = met.filter(F.col("n") <= pairs_up_to), met.filter(F.col("n") > pairs_up_to)
        pairs = small.alias("x").join(small.alias("y"), "key").filter("x.node < y.node").select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
        near = large.select("key", "node", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("flip")).select(
            "key", "node", F.expr("if(flip < 0, node, node ^ shiftleft(1L, flip))").alias("near"))
        lows = near.groupBy("key", "near").agg(F.min("node").alias("v"))
        asked = pairs.unionByName(near.join(lows, ["key", "near"]).filter("node > v").select(F.col("node").alias("u"), "v")).distinct()
    else:
        return links_within(met.select("key", "node"), lambda pairs: _near(pairs, prints, names, max_bits))
    return _near(asked, prints, names, max_bits)


def near_duplicates(
    docs: DataFrame, key: list[Column], first: Column, text: str = "text", shingle: int = 3, words: int = 1, max_bits: int = 2, width: int = 32,
) -> DataFrame:
    """Every row's key columns, its fingerprint f0, ..., ``group`` and ``least``.

    ``group`` is equal for rows linked directly or through others, ``least`` the
    smallest ``first`` (an expression of the key) in the group. Null and empty
    texts have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, so exact copies of any number cost no pairs.
    """
    prints = cut_lineage(fingerprints(docs, key, text, shingle, words))
    names = [f"f{i}" for i in range(words)]
    node = F.col("f0") if words == 1 else F.xxhash64(*names)
    nodes = prints.groupBy(*names).agg(F.min(first).alias("least")).withColumn("node", node)
    # a fingerprint becomes many variants: dealt out, so that no task makes those of very many
    nodes = cut_lineage(nodes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"))
    groups = components(links(nodes.drop("least"), max_bits, width))
    named = nodes.join(groups, "node", "left").select(*names, F.coalesce("component", "node").alias("group"), "least")
    leasts = named.groupBy("group").agg(F.min("least").alias("least"))
    # cut, so that the join deals out both sides itself and can split a fingerprint with very many rows
    return prints.join(cut_lineage(named.drop("least").join(leasts, "group")), names)


#: The pipeline's shingles: five words.
SHINGLE = 5
#: Bands and hashes a band: two texts meet in a band if the smallest of each of its hashes is the same for both. Of sets of
#: similarity s a share of 1 - (1 - s ** 6) ** 20 meets: 99.8 % at 0.8, 99.98 % at 0.85.
BANDS, PER_BAND = 20, 6
_random = np.random.default_rng(SEED)
_FACTORS, _TERMS = (_random.integers(0, 2**64, BANDS * PER_BAND, np.uint64)[:, None] for _ in range(2))
_FACTORS |= np.uint64(1)


def _meeting_keys(h: np.ndarray) -> np.ndarray:
    """One key per band: the digest of the smallest values of the band's hashes over all shingles."""
    least = np.full(BANDS * PER_BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 512):  # small enough for the processor's cache
        np.minimum(least, (h[at:at + 512] * _FACTORS + _TERMS).min(axis=1), out=least)
    bands = least.reshape(BANDS, PER_BAND)
    return np.array([xxhash.xxh64_intdigest(one.tobytes(), i) for i, one in enumerate(bands)], np.uint64).view(np.int64)


def _digest(h: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(h.tobytes(), SEED), np.uint64).view(np.int64))


#: 64-bit words of a set's bitmap, in which every element sets one bit.
BITS = 8


def _bitmap(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITS, np.uint8)
    bits[(h >> np.uint64(7)) % np.uint64(64 * BITS)] = 1
    return np.packbits(bits).view(">i8").astype(np.int64)


def shingle_sets(docs: DataFrame, key: list[Column], text: str, shingle: int, whole: bool) -> DataFrame:
    """The columns ``key``, the digest ``node`` of the text's distinct shingles, and these with their bitmap (``whole``) or the keys under which it meets others and the fingerprint f0."""
    narrow = docs.select(*key, F.col(text).alias("_text"))
    keys = narrow.columns[:-1]
    last = "shingles" if whole else "meets"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):  # lists of few texts at a time
                batch = big.slice(at, 256)
                nodes, lists, maps, prints = [], [], [], []
                for one in batch.column(len(keys)):
                    h = np.unique(shingle_hashes(one.as_py(), shingle))
                    nodes.append(_digest(h))
                    if whole:
                        maps.append(_bitmap(h).tolist())
                    else:
                        prints.append(majority(h))
                    lists.append(h.view(np.int64) if whole else _meeting_keys(h) if len(h) else np.empty(0, np.int64))
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(nodes, pa.int64()), column, pa.array(maps, pa.list_(pa.int64())) if whole else pa.array(prints, pa.int64())],
                    names=[*keys, "node", last, "bits" if whole else "f0"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + ["node long", f"{last} array<long>", "bits array<long>" if whole else "f0 long"])
    return narrow.mapInArrow(run, schema)


def _alike(x: str, y: str) -> Column:
    """Whether two sets, by the prefixes of their columns elements and bits, can have a similarity of 0.8.

    A bit that only one side has stands for an element that the other lacks.
    """
    def lacking(a: str, b: str) -> Column:
        only = [F.bit_count(F.col(f"{a}bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{b}bits")[i]))) for i in range(BITS)]
        return sum(only[1:], only[0])

    n, m = F.col(f"{x}elements"), F.col(f"{y}elements")
    return 9 * F.least(n - lacking(x, y), m - lacking(y, x)) >= 4 * (n + m)


def _facts(sets: DataFrame) -> DataFrame:
    return sets.select("node", F.size("shingles").alias("elements"), "bits")


#: Pairs sent to all executors at most: 10 MB, as Spark does by itself where it knows a size.
SENT = 10 * 2**20 // 16


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) whose sets (node, shingles, bits) have a similarity of 0.8 at least: common elements over all elements, exactly.

    Sizes and bitmaps rule out most others before a set moves. Few pairs go to
    the sets instead, of which then only the pairs' own move.
    """
    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"_{n}")) for n in "uv")
    sides = [_facts(sets).select(F.col("node").alias(e), F.col("elements").alias(f"_{e}elements"), F.col("bits").alias(f"_{e}bits")) for e in "uv"]
    fit = cut_lineage(pairs.join(sides[0], "u").join(sides[1], "v").filter(_alike("_u", "_v")).select("u", "v"))
    both = F.size(F.array_intersect("_u", "_v"))
    if fit.count() <= SENT:
        a, b = a.join(F.broadcast(fit), "u"), b.join(F.broadcast(fit.select("v").distinct()), "v", "left_semi")
        return a.join(b, "v").filter(9 * both >= 4 * (F.size("_u") + F.size("_v"))).select("u", "v")
    return fit.join(a, "u").join(b, "v").filter(9 * both >= 4 * (F.size("_u") + F.size("_v"))).select("u", "v")


def rarest_first(own: DataFrame) -> DataFrame:
    """(key, node): the shingles under which sets (node, shingles) of a similarity of 0.8 meet, exactly: the rarest fifth of each set.

    Sets that share 0.8 of their elements share one of the first
    n - ceil(0.8 n) + 1 in any common order. Rare ones come first, as counted
    over ``own``; those that one set alone has are first of all and meet nobody.
    """
    spots = cut_lineage(own.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key")))
    shared = spots.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    ordered = spots.join(cut_lineage(shared), "key").groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("s"))
    # n - ceil(0.8 n) + 1 = n div 5 + 1, of which the n - size(s) that nobody shares come first
    take = F.expr("cast(greatest(n div 5 + 1 - (n - size(s)), 0) as int)")
    return ordered.select("node", F.explode(F.slice("s", F.lit(1), take)).alias("e")).select("e.key", "node")


def similar_links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links of all similar pairs that share a band, or enough for the same components.

    Families are joined through one member each. Where many members of a band
    stay apart, as texts on one template do, the members of that band meet again
    under their rarest shingles, which unlike ones do not share, so no large
    band's pairs are all compared.
    """
    def possible(x: str, y: str) -> Column:
        return _alike(f"{x}.", f"{y}.")

    def again(open_: DataFrame) -> DataFrame:
        own = cut_lineage(sets.join(open_.select("node").distinct(), "node"))
        return links_within(cut_lineage(rarest_first(own)), lambda pairs: similar(pairs, own), facts=_facts(own), possible=possible)

    return links_within(met, lambda pairs: similar(pairs, sets), rest=again, facts=_facts(sets), possible=possible)


def fingerprint_pairs(nodes: DataFrame, max_bits: int = 2, width: int = 32) -> DataFrame:
    """(u, v): nodes (node, f0) whose fingerprints ``links`` links, by the smallest node of each; other nodes of a fingerprint with that one."""
    prints = cut_lineage(nodes.groupBy("f0").agg(F.min("node").alias("low")))
    # a fingerprint becomes many variants: dealt out, as in near_duplicates
    dealt = cut_lineage(prints.select(F.col("f0").alias("node"), "f0").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"))
    ends = [prints.select(F.col("f0").alias(e), F.col("low").alias(f"_{e}")) for e in "uv"]
    apart = links(dealt, max_bits, width).join(ends[0], "u").join(ends[1], "v").select("_u", "_v")
    equal = nodes.join(prints, "f0").filter("node <> low").select(F.col("node").alias("_u"), F.col("low").alias("_v"))
    return apart.unionByName(equal).select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, in all their columns, whatever their names: of each group of near-duplicates the row with the smallest doc_id.

    Texts meet by their SimHash fingerprints and, as these reach only the closest,
    in bands. They are linked if at least 0.8 of their distinct shingles are common
    to both, which is verified for every link; groups are what links join. Of rows
    with that id the one with the smallest text hash stays, and those equal to it
    in both; a null id is larger than any. Texts without a word are one group.
    """
    key = [F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text_hash")]
    first = F.struct(F.col("_doc").isNull().alias("_none"), "_doc", "_text_hash")
    rows = cut_lineage(shingle_sets(docs, key, text, shingle, whole=False))
    # texts with equal sets are one node, so exact copies of any number cost no pairs
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(first).alias("least"), F.first("meets").alias("meets"), F.first("f0").alias("f0")))
    close = cut_lineage(fingerprint_pairs(nodes.select("node", "f0")))
    met = nodes.select("node", F.explode("meets").alias("key"))
    held = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met = cut_lineage(met.join(held, "key").select("key", "node"))
    # one text of each node that meets another gives its set
    meeting = met.select("node").unionByName(close.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    asked = meeting.join(nodes.select("node", "least"), "node").select(
        F.col("least._doc").alias("_id"), F.col("least._text_hash").alias("_own"))
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_body"))
    own = own.join(asked, own["_doc"].eqNullSafe(F.col("_id")) & (F.xxhash64("_body") == F.col("_own")), "left_semi")
    sets = cut_lineage(shingle_sets(own, [], "_body", shingle, whole=True).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits")))
    groups = components(similar(close, sets).unionByName(similar_links(met, sets)))
    named = nodes.join(groups, "node", "left").select("least", F.coalesce("component", "node").alias("group"))
    stay = cut_lineage(named.groupBy("group").agg(F.min("least").alias("least")).select(F.col("least._doc").alias("_id"), F.col("least._text_hash").alias("_own")))
    # what led to it goes before the texts move
    del rows, nodes, close, met, held, meeting, asked, own, sets, groups, named
    release(docs.sparkSession)
    whole = docs.select(F.struct("*").alias("row"))
    at = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"row.`{text}`")) == F.col("_own"))
    return whole.join(stay, at, "left_semi").select("row.*")
