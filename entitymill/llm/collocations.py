"""Phrase collocations out of a weighted de Bruijn graph.

Nodes are phrases one word shorter than the longest, edges the longest phrases
with their counts; an edge leads from its first words to its last. Paths whose
inner nodes have one edge in, one edge out and nothing that starts or ends
there are compacted to one row. A node's count is the flow that leaves it plus
the pieces that end in it, and so on for ever shorter phrases, so no phrase but
the longest is counted from the text.

Before the graph, counts of phrases in a fixed number of hashed cells tell which
are certainly rarer than what is asked for: pieces end before them. A phrase that
is asked for holds no such phrase, so its count stays exact.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: Cells of the counts of phrases of each size, and cells a row of them holds. One bit a cell is broadcast: 2 MB a size, whatever the input.
CELLS, BLOCK = 1 << 24, 1 << 14
#: Bytes of text whose words one task holds at a time, and different phrases it counts before it hands them on.
TEXT_BYTES, PHRASES = 1 << 22, 1 << 18

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GAP = 1


class _Words:
    """Numbers and hashes of the words met in a task; forgotten when they become many."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0, b"\n": _GAP}
        self.names, self.hashes = [b"", b"\n"], np.zeros(2, np.uint64)

    def number(self, text: bytes) -> np.ndarray:
        """The text's words as numbers, _GAP between pieces."""
        known = self.known
        tokens = text.translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
        for t in set(tokens):
            if t not in known:
                known[t] = len(known)
                self.names.append(t)
        ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids > 0]

    def hashed(self) -> np.ndarray:
        n = len(self.hashes)
        if n < len(self.names):
            digest = xxhash.xxh3_64_intdigest
            more = np.fromiter((digest(w) for w in self.names[n:]), np.uint64, len(self.names) - n)
            self.hashes = np.concatenate((self.hashes, more))
        return self.hashes


def _parts(batches: Iterator[pa.RecordBatch], words: _Words) -> Iterator[tuple[str, np.ndarray]]:
    """(language, word numbers of its texts with gaps between them), for some texts at a time."""
    held, size, gap = defaultdict(list), 0, np.array([_GAP])
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            body = (text.as_py() or "").encode("utf-8", "surrogatepass")
            held[lang.as_py()] += [words.number(body), gap]
            size += len(body)
            if size >= TEXT_BYTES:
                for own, ids in held.items():
                    yield own, np.concatenate(ids)
                held, size = defaultdict(list), 0
                if len(words.known) > 4 * PHRASES:
                    words.forget()
    for own, ids in held.items():
        yield own, np.concatenate(ids)


def _cells(words: _Words, lang: str, ids: np.ndarray, longest: int, n_cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` words: where as many follow each other in a piece, and two cells of each phrase, one in either half."""
    h = words.hashed()[ids]
    at = np.flatnonzero(ids != _GAP)
    own = np.full(len(at), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), 1), np.uint64)
    for size in range(longest):
        if size:
            keep = np.flatnonzero(at + size < len(ids))
            keep = keep[ids[at[keep] + size] != _GAP]
            at, own = at[keep], own[keep]
        own = (own ^ h[at + size]) * _A
        own = (own ^ (own >> np.uint64(29))) * _B
        half = np.uint64(n_cells // 2)
        again = (own ^ (own >> np.uint64(32))) * _A
        yield at, np.stack(((own >> np.uint64(20)) % half, (again >> np.uint64(20)) % half + half)).astype(np.int32)


def frequent_cells(docs: DataFrame, least: int, longest: int, n_cells: int = CELLS) -> np.ndarray:
    """A row of bits for phrases of 1 to ``longest`` words: a cell's bit is unset only if all its phrases occur less than ``least`` times.

    A phrase that occurs as often has both its bits set; few others have.

    ``docs``: lang, text. Counts stop at 255 or at ``least`` and travel in
    compressed blocks; every task adds those of its own blocks up as they come.
    """
    n_blocks, most = -(-n_cells // BLOCK), min(max(least, 1), 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = _Words(), np.zeros((longest, n_blocks * BLOCK), np.uint8)
        for lang, ids in _parts(batches, words):
            for row, (_, cells) in zip(held, _cells(words, lang, ids, longest, n_cells)):
                cell, n = np.unique(cells, return_counts=True)
                row[cell] = np.minimum(row[cell] + n, most)
        blocks = held.reshape(longest * n_blocks, BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        for i in range(0, len(full), 256):
            part = full[i:i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in part], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(BLOCK, np.uint8))
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
                held[block] = np.minimum(held[block].astype(np.int64) + more, most).astype(np.uint8)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([zlib.compress(np.packbits(x >= most).tobytes(), 1) for x in held.values()], pa.binary())], names=["block", "bits"])

    summed = docs.select("lang", "text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, bits binary")
    bits = np.zeros((longest * n_blocks, BLOCK // 8), np.uint8)
    for row in summed.collect():  # one bit a cell, whatever the input
        bits[row["block"]] = np.frombuffer(zlib.decompress(bytes(row["bits"])), np.uint8)
    return bits.reshape(longest, -1)


def readings(docs: DataFrame, bits: np.ndarray, n_cells: int = CELLS) -> DataFrame:
    """(lang, size, text, n): how far the text can be read from every word on before a phrase is certainly rare.

    Neighbouring words from which the longest phrase can be read give one row
    together, all their words (size: the longest). Any other word gives the
    phrase that can be read from it, its piece's end so to speak; size 0 counts
    words that are rare themselves. Counted in every task, then over all.
    """
    sent, longest = docs.sparkSession.sparkContext.broadcast(bits.tobytes()), len(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, table = _Words(), Counter(), np.frombuffer(sent.value, np.uint8).reshape(longest, -1)

        def handed_on() -> pa.RecordBatch:
            keys = list(held)
            out = pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2].decode("utf-8", "surrogatepass") for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "size", "text", "n"])
            held.clear()
            return out

        for lang, ids in _parts(batches, words):
            far = np.zeros(len(ids), np.int8)
            for size, (at, cell) in enumerate(_cells(words, lang, ids, longest, n_cells)):
                can = ((table[size][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).all(axis=0)
                at = at[can & (far[at] == size)]
                far[at] = size + 1
            names = words.names
            held[lang, 0, b""] += int(((far == 0) & (ids != _GAP)).sum())
            number, n = np.unique(ids[far == 1], return_counts=True)
            for i, k in zip(number.tolist(), n.tolist()):
                held[lang, 1, names[i]] += k
            two = np.flatnonzero(far == 2)
            pairs, n = np.unique(ids[two] << 32 | ids[np.minimum(two + 1, len(ids) - 1)], return_counts=True)
            for p, k in zip(pairs.tolist(), n.tolist()):
                held[lang, 2, names[p >> 32] + b" " + names[p & 0xFFFFFFFF]] += k
            kept = [names[i] for i in ids.tolist()]
            for size in range(3, longest):
                for i in np.flatnonzero(far == size).tolist():
                    held[lang, size, b" ".join(kept[i:i + size])] += 1
            # gaps are read from nowhere, so a run of words ends with its piece at the latest
            whole = np.concatenate(([False], far == longest, [False]))
            for a, b in zip(np.flatnonzero(whole[1:] & ~whole[:-1]).tolist(), np.flatnonzero(~whole[1:] & whole[:-1]).tolist()):
                held[lang, longest, b" ".join(kept[a:b + longest - 1])] += 1
            if len(held) > PHRASES:
                yield handed_on()
        if held:
            yield handed_on()

    parts = docs.select("lang", "text").mapInArrow(read, "lang string, size int, text string, n long")
    return parts.groupBy("lang", "size", "text").agg(F.sum("n").alias("n"))


def _gram(words: Column, at: Column | int, size: int) -> Column:
    """``size`` words from position ``at`` on, joined by a space."""
    return F.concat_ws(" ", *[words[at + i] for i in range(size)])


def _grams(words: Column, size: int) -> Column:
    """All runs of ``size`` words, in order; the words are as many at least."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: _gram(words, i, size))


def _first(gram: Column, size: Column | int) -> Column:
    """The first ``size`` words, the last if it is negative."""
    return F.call_function("substring_index", gram, F.lit(" "), size if isinstance(size, Column) else F.lit(size))


def paths(runs: DataFrame, ends: DataFrame, longest: int) -> DataFrame:
    """(lang, path, n): the compacted graph. ``runs``: id, lang, words, n; ``ends``: lang, node, for pieces that end in a node.

    A node is inner if it has one edge in, one edge out and no run or piece
    starts or ends there; runs are cut at all others. What passes an inner node
    passes the whole path, so equal paths add up and every edge of a path has
    its count.
    """
    node = longest - 1
    spots = runs.select("id", "lang", F.posexplode(_grams(F.col("words"), longest)).alias("at", "edge"))
    edges = spots.select("lang", "edge").distinct()
    once, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = edges.select("lang", F.explode(F.array(
        F.struct(_first(F.col("edge"), node).alias("node"), none.alias("ins"), once.alias("outs"), none.alias("tips")),
        F.struct(_first(F.col("edge"), -node).alias("node"), once.alias("ins"), none.alias("outs"), none.alias("tips")),
    )).alias("s")).select("lang", "s.*")
    tips = runs.select("lang", F.explode(F.array(_gram(F.col("words"), 0, node), _gram(F.col("words"), F.size("words") - node, node))).alias("node"))
    tips = tips.unionByName(ends).select("lang", "node", none.alias("ins"), none.alias("outs"), once.alias("tips"))
    facts = sides.unionByName(tips).groupBy("lang", "node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.sum("tips").alias("tips"))
    inner = facts.filter("ins = 1 and outs = 1 and tips = 0").select("lang", F.col("node").alias("inner"))
    # the node an edge leaves; that of a run's first edge is a tip and never inner
    left = spots.select("id", "lang", "at", _first(F.col("edge"), node).alias("inner")).join(cut_lineage(inner), ["lang", "inner"], "left_anti")
    cuts = left.groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("cuts"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text, n = [], [], []
            for own, words, count, at in zip(*(batch.column(k) for k in range(4))):
                words, at = words.as_py(), at.as_py()
                for a, b in zip(at, [*at[1:], len(words) - node]):
                    lang.append(own.as_py())
                    text.append(" ".join(words[a:b + node]))
                    n.append(count.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64())], names=["lang", "path", "n"])

    joined = runs.join(cuts, "id").select("lang", "words", "n", "cuts").mapInArrow(pieces, "lang string, path string, n long")
    return joined.groupBy("lang", "path").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int, longest: int = 5, n_cells: int = CELLS) -> DataFrame:
    """(lang, gram, size, f): phrases of 1 to ``longest`` words; exact for every phrase that occurs ``least`` times or more.

    ``docs``: lang, text, no nulls. Rarer phrases may be missing; words that are
    rare themselves are counted together, with size 0.
    """
    read = cut_lineage(readings(docs, frequent_cells(docs, least, longest, n_cells), n_cells))
    node = longest - 1

    def ends(size: int) -> DataFrame:
        """Pieces that end with a phrase of this size, by the phrase."""
        return read.filter(F.col("size") == size).select("lang", F.col("text").alias("gram"), "n")

    runs = cut_lineage(read.filter(F.col("size") == longest).select(F.monotonically_increasing_id().alias("id"), "lang", F.split("text", " ").alias("words"), "n"))
    # a path's edges share its count; so do its inner nodes, which only its own edges reach
    compact = cut_lineage(paths(runs, ends(node).select("lang", F.col("gram").alias("node")), longest).select("lang", F.split("path", " ").alias("words"), "n"))
    out = [compact.select("lang", F.explode(_grams(F.col("words"), longest)).alias("gram"), "n")]
    # all nodes of a path but its first and last
    inner = compact.filter(F.size("words") > longest).select("lang", F.explode(F.slice(_grams(F.col("words"), node), F.lit(2), F.size("words") - longest)).alias("gram"), "n")
    flow = compact.select("lang", _gram(F.col("words"), 0, node).alias("gram"), "n").unionByName(ends(node))
    now = flow.groupBy("lang", "gram").agg(F.sum("n").alias("n")).unionByName(inner)
    out.append(now := cut_lineage(now))
    for size in range(node - 1, 0, -1):
        flow = now.select("lang", _first(F.col("gram"), size).alias("gram"), "n").unionByName(ends(size))
        out.append(now := cut_lineage(flow.groupBy("lang", "gram").agg(F.sum("n").alias("n"))))
    found = ends(0).select("lang", "gram", F.lit(0).alias("size"), F.col("n").alias("f"))
    for size, one in zip(range(longest, 0, -1), out):
        found = found.unionByName(one.select("lang", "gram", F.lit(size).alias("size"), F.col("n").alias("f")))
    return found


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, top: int = 2000, n_cells: int = CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words that occur ``least`` times or more.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n
    all words of the language; the score is floor(1000 * a * n / (l * r)). Of
    cuts with equal scores the first counts. Phrases inside a longer one that
    occurs as often are left out. Ranked by score, a, phrase.

    A null language is ``und``, a null or empty text has no words, texts of any
    length are read whole and equal rows count as often as they occur. An empty
    table has no phrases; other columns are not read.
    """
    if longest < 3:
        raise ValueError("longest must be 3 at least")
    narrow = docs.select(F.coalesce(F.col(lang), F.lit("und")).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = phrase_counts(narrow, least, longest, n_cells)
    totals = counts.filter("size < 2").groupBy("lang").agg(F.sum("f").alias("n"))
    often = cut_lineage(counts.filter((F.col("size") > 0) & (F.col("f") >= least)))
    phrases = often.filter("size > 1")
    words = F.split("gram", " ")
    inside = phrases.filter("size > 2").select("lang", F.col("f").alias("longer"), "size", words.alias("w")).select(
        "lang", "longer", F.explode(F.flatten(F.array(*[
            F.when(F.col("size") > k, _grams(F.col("w"), k)).otherwise(F.array().cast("array<string>"))
            for k in range(2, longest)]))).alias("gram"))
    covered = inside.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    left = phrases.join(covered, ["lang", "gram"], "left").filter("longer is null or 100 * cast(longer as decimal(20)) < 100 * cast(f as decimal(20))").drop("longer")
    cuts = left.select("lang", "gram", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size").select(
        "lang", "gram", "a", "k", _first(F.col("gram"), F.col("k")).alias("first"), F.expr("substring_index(gram, ' ', k - size)").alias("rest"))
    parts = often.select("lang", F.col("gram").alias("first"), F.col("f").alias("l"))
    others = often.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r"))
    whole = F.expr("cast(1000 * cast(a as decimal(18)) * cast(n as decimal(18)) div (cast(l as decimal(19)) * cast(r as decimal(19))) as long)")
    scored = cuts.join(parts, ["lang", "first"]).join(others, ["lang", "rest"]).join(totals, "lang").withColumn("score", whole)
    lowest = scored.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = lowest.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "gram")))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
