"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every run of ``span`` words the smallest hash of its ``gram``-word sequences
is kept, so documents and benchmark items that share a run of that length share
a kept hash. Kept hashes join; each hit is extended word by word to both sides
over the words themselves, and counts if the common run is long enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

SPAN, GRAM = 10, 4
#: Words of a document that are winnowed together; longer documents are several parts that overlap by a run.
PART_WORDS = 256
#: Bytes of the benchmark's fingerprints, as counted, up to which they are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(f"{WORD}++"), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def kept_hashes(words: Column, gram: int, width: int) -> Column:
    """The smallest of every ``width`` neighbouring hashes of ``gram`` words, each spot once: array of longs, the spot in the lowest 9 bits.

    For at most 512 words. Hashes are compared by their upper 55 bits and of
    equal ones the leftmost is the smallest, so equal runs keep the same spot.
    """
    def of(h: Column) -> Column:
        spots = F.transform(F.sequence(F.lit(0), F.size(h) - gram), lambda i: F.xxhash64(*[h[i + d] for d in range(gram)]).bitwiseAND(F.lit(-512)).bitwiseOR(i.cast("long")))

        def least(s: Column) -> Column:
            if width == 1:
                return s
            return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(s) - width), lambda i: F.least(*[s[i + d] for d in range(width)])))

        return _let(spots, least)

    kept = _let(F.transform(words, lambda w: F.xxhash64(w)), of)
    return F.when(F.size(words) >= gram + width - 1, kept).otherwise(F.array().cast("array<long>"))


def _sizes(length: int, gram: int) -> tuple[int, int]:
    """How runs of ``length`` words are winnowed: words a hash, hashes a run."""
    return min(gram, length), length - min(gram, length) + 1


def _found(words: Column, length: int, gram: int) -> Column:
    size, width = _sizes(length, gram)
    return F.transform(kept_hashes(words, size, width), lambda x: F.struct(
        F.xxhash64(F.lit(length), F.shiftright(x, 9)).alias("hash"), x.bitwiseAND(F.lit(511)).cast("int").alias("at"), F.lit(length).alias("length")))


def _around(words: Column, at: Column, span: int) -> Column:
    """The words that runs over spot ``at`` can hold: those before it and those from it on."""
    before = F.greatest(at - span + 1, F.lit(0))
    return F.struct(
        F.reverse(F.slice(words, before + 1, at - before)).alias("before"),
        F.slice(words, at + 1, F.lit(span)).alias("after"))


def _common(a: Column, b: Column) -> Column:
    """How many words at the beginning are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def parts(docs: DataFrame, overlap: int) -> DataFrame:
    """(key, start, words): every document in parts of PART_WORDS words and the ``overlap`` words that follow. ``docs``: key, lower."""
    pieces = F.regexp_extract_all("lower", F.lit(f"(?:{WORD}++{_BREAK}*+){{1,{PART_WORDS}}}+"), F.lit(0))
    more = rf"^(?:{WORD}++{_BREAK}*+){{0,{max(overlap, 1)}}}+"
    cut = docs.select("key", pieces.alias("pieces")).select("key", F.explode(F.transform("pieces", lambda p, i: F.struct(
        (i * PART_WORDS).alias("start"), F.concat(p, F.regexp_extract(F.coalesce(F.try_element_at("pieces", i + 2), F.lit("")), more, 0)).alias("piece")))).alias("p"))
    return cut.select("key", "p.start", words(F.col("p.piece")).alias("words"))


def benchmark_runs(items: DataFrame, item_id: str, text: str, span: int, gram: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The benchmark's fingerprints (print, hash, length, before, after), (print, item) and the lengths in use.

    Items of fewer than ``span`` words are one run of that length. Items that
    have the same words around a spot share a fingerprint.
    """
    own = items.select(F.col(item_id).alias("item"), lowered(F.col(text)).alias("lower"))
    # items too are cut into parts, so that one of any length is winnowed like any other
    whole = own.select("item", words(F.col("lower")).alias("all")).select("item", F.least(F.size("all"), F.lit(span)).alias("length"))
    short = {r["length"] for r in whole.select("length").distinct().collect()} - {0}  # at most ``span`` values
    lengths = sorted(short)
    cut = parts(own.select(F.struct("item", F.xxhash64("lower")).alias("key"), "lower"), span - 1).select("key.item", "start", "words")
    found = None
    for length in lengths:
        fits = cut.filter(F.size("words") == length) if length < span else cut.filter(F.size("words") >= span)
        # the last part of a long item may be shorter than a run: its words are in the part before
        fits = fits.filter("start = 0") if length < span else fits
        one = fits.select("item", "words", F.explode(_found(F.col("words"), length, gram)).alias("f"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = cut.select("item", "words", F.explode(_found(F.col("words"), span, gram)).alias("f")).limit(0)
    found = found.select("item", "f.hash", "f.length", _around(F.col("words"), F.col("f.at"), span).alias("around")).select("item", "hash", "length", "around.*")
    prints = cut_lineage(found.select("hash", "length", "before", "after").distinct().withColumn("print", F.monotonically_increasing_id()))
    held = found.join(prints, ["hash", "length", "before", "after"]).select("print", "item").distinct()
    return prints, cut_lineage(held), lengths


def matches(cut: DataFrame, prints: DataFrame, lengths: list[int], span: int, gram: int, broadcast_bytes: int) -> DataFrame:
    """(key, print, start, end): runs of document words that a fingerprint's item holds too, extended to both sides; end exclusive."""
    if not lengths:
        lengths = [span]
    found = F.explode(F.concat(*[_found(F.col("words"), n, gram) for n in lengths]))
    size = prints.agg(F.sum(F.octet_length(F.concat(F.concat_ws(" ", "before"), F.concat_ws(" ", "after"))) + 256)).first()[0] or 0
    if size <= broadcast_bytes:  # hits are looked up where the text is, and only they move
        met = cut.select("key", "start", "words", found.alias("f")).select("key", "start", "words", "f.hash", "f.at", "f.length").join(F.broadcast(prints), ["hash", "length"])
    else:  # kept hashes move without the text, which then joins the hits
        spots = cut.select("key", "start", found.alias("f")).select("key", "start", "f.hash", "f.at", "f.length")
        met = cut_lineage(spots.join(prints.select("hash", "length", "print"), ["hash", "length"])).join(cut, ["key", "start"]).join(prints.drop("hash", "length"), "print")
    own = met.select("key", "start", "at", "length", "print", "before", "after", _around(F.col("words"), F.col("at"), span).alias("own"))
    run = own.select(
        "key", "length", "print", (F.col("start") + F.col("at")).alias("spot"),
        _common(F.col("own.before"), F.col("before")).alias("left"), _common(F.col("own.after"), F.col("after")).alias("right"))
    return run.filter(F.col("left") + F.col("right") >= F.col("length")).select(
        "key", "print", (F.col("spot") - F.col("left")).alias("start"), (F.col("spot") + F.col("right")).alias("end"))


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, n_words, spans, items for every row of ``docs``.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.
    ``spans`` are the runs of words (start, end exclusive) that lie in a run of
    ``span`` words of an item, or in a whole item of fewer words; touching or
    overlapping spans are one. ``items`` are the ids of the items met, sorted.

    Null and empty texts have no words and null lists; items without words meet
    nothing; a null item id counts as an item and is null in the list; repeated
    item ids are one item. Rows equal in doc_id and text have equal results.
    Rows of one doc_id are told apart by 64 bits of their text's hash; words of
    a hit are compared themselves. Texts of any length are read whole.
    """
    if not 1 <= span <= 256 or gram < 1:
        raise ValueError("span must be 1 to 256, gram 1 at least")
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    keyed = own.select(F.struct("doc", F.xxhash64("body").alias("hash")).alias("key"), lowered(F.col("body")).alias("lower"))
    prints, held, lengths = benchmark_runs(items, item_id, item_text, span, gram)
    found = cut_lineage(matches(parts(keyed, span - 1), prints, lengths, span, gram, broadcast_bytes).distinct())
    # a span starts where no earlier run of its document reaches
    order = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.select("key", "start", "end").withColumn("first", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    numbered = opened.withColumn("number", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("key", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    listed = found.select("key", "print").distinct().join(held, "print").select("key", F.struct("item").alias("item")).distinct()
    listed = listed.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    lists = spans.join(listed, "key").select("key", "spans", F.col("items.item").alias("items"))
    counted = keyed.select("key", F.regexp_count("lower", F.lit(f"{WORD}++")).cast("long").alias("n_words"))
    return counted.join(lists, "key", "left").select(F.col("key.doc").alias("doc_id"), "n_words", "spans", "items")
