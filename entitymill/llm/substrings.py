"""Repeated passages by level-wise doubling.

A window of ``length`` words can only repeat if the shorter windows in it
repeat. The first level looks at short windows, and of those only at the
anchors: in every window of ``length`` words its short window of smallest
hash, so equal windows have equal anchors and none is missed. Windows repeated
at one length alone are extended to twice that length, with the wanted length
as the last, until no candidates survive or the length is reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def levels(length: int, first: int) -> list[int]:
    """``first`` doubled until ``length``, which is the last."""
    out = [min(first, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def split_words(text: str | None) -> list[bytes]:
    """Runs of other than space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_M2)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(self.n - 1, self.base, np.uint64))))
                self.down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(self.n - 1, self.inverse, np.uint64))))
        return self.up[:n], self.down[:n]


class Windows:
    """Hashes of all windows of any length over the words of one text."""

    _powers = (Powers(_M1 | 1), Powers(_M2 | 1))

    def __init__(self, words: list[bytes], seeds: tuple[int, ...] = (1,)):
        self.n, self.sums = len(words), []
        for seed in seeds:
            digest = xxhash.xxh3_64_intdigest
            h = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
            up, _ = self._powers[seed - 1].get(len(words) + 1)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64))))

    def hashes(self, length: int, seed: int = 1) -> np.ndarray:
        if self.n < length:
            return np.empty(0, np.uint64)
        s = self.sums[seed - 1]
        _, down = self._powers[seed - 1].get(self.n + 1)
        return _mix((s[length:] - s[:-length]) * down[: self.n - length + 1])


def anchors(short: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the position of its smallest, the leftmost of equals."""
    if len(short) < width:
        return np.empty(0, np.int64)
    at = np.arange(len(short))
    out, span = at, 1
    while span * 2 <= width:  # the smallest of runs of 1, 2, 4, ... hashes
        a, b = out[: len(out) - span], out[span:]
        out, span = np.where(short[b] < short[a], b, a), span * 2
    if span < width:
        a, b = out[: len(short) - width + 1], out[width - span: len(short) - span + 1]
        out = np.where(short[b] < short[a], b, a)
    return out


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """Every different text once: _k1, _k2 (96 bits of hashes), _text, _n (rows that hold it). Copies are combined before the shuffle."""
    return docs.groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"), F.count("*").alias("_n"))


def _started(docs: DataFrame, length: int, first: int) -> DataFrame:
    """The keys of every row with n_words, kept_sha256 of the whole text, and the hashes of its anchors."""
    keys = [c for c in docs.columns if c != "_text"]
    at, width = docs.columns.index("_text"), length - first + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, shas, found = [], [], [np.empty(0, np.int64)]
            for body in batch.column(at):
                words = split_words(body.as_py())
                n_words.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < length:
                    found.append(found[0])
                    continue
                short = Windows(words).hashes(first)
                # what matters is whether a hash is there once or more often, so twice is enough
                values, n = np.unique(_signed(short[np.unique(anchors(short, width))]), return_counts=True)
                found.append(np.repeat(values, np.minimum(n, 2)))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(list(map(len, found))), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(n_words, pa.int64()), pa.array(shas), lists], names=[*keys, "n_words", "kept_sha256", "_anchors"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_text"]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_words long, kept_sha256 string, _anchors array<long>"]))


def _alive(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """(_k1, _k2, name): by text the values of ``key`` that start more than once anywhere, out of rows of (_k1, _k2, key, _n)."""
    again = rows.groupBy(*key).agg(F.sum("_n").alias("_all")).filter("_all > 1").select(*key)
    return rows.join(again, key).groupBy("_k1", "_k2").agg(F.collect_set(name).alias(f"_{name}"))


def _starts(words: list[bytes], alive: list[np.ndarray], sizes: list[int], width: int) -> tuple[Windows, np.ndarray]:
    """Where windows of the last length may start: the shorter windows at their ends repeat on every level so far."""
    own = Windows(words, (1, 2))
    short = own.hashes(sizes[0])
    spot = anchors(short, width)
    start = np.arange(len(spot))
    if alive:
        start = start[_among(_signed(short)[spot], alive[0])]
    for size, held in zip(sizes[1:], alive[1:]):
        mine = _signed(own.hashes(size))
        start = start[_among(mine[start], held) & _among(mine[start + sizes[0] + width - 1 - size], held)]
    return own, start


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), bool)
    held = np.sort(held)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _extended(texts: DataFrame, alive: DataFrame, sizes: list[int], size: int, length: int) -> DataFrame:
    """(_k1, _k2, at, h1, h2, _n): windows of ``size`` in the candidate windows of texts that have any."""
    width, names = length - sizes[0] + 1, [c for c in alive.columns if c not in ("_k1", "_k2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = [batch.column(4 + k)[i].values.to_numpy(zero_copy_only=False) for k in range(len(names))]
                own, start = _starts(split_words(batch.column(2)[i].as_py()), held, sizes, width)
                if size < length:  # every window of this size inside a candidate
                    start = np.unique((start[:, None] + np.arange(length - size + 1)).reshape(-1))
                if not len(start):
                    continue
                h1, h2 = _signed(own.hashes(size, 1))[start], _signed(own.hashes(size, 2))[start].astype(np.int32)
                same = [batch.column(k).take(pa.array(np.full(len(start), i))) for k in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(start.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["_k1", "_k2", "_n", "at", "h1", "h2"])

    return texts.join(alive, ["_k1", "_k2"]).select("_k1", "_k2", "_text", "_n", *names).mapInArrow(run, "_k1 long, _k2 int, _n long, at int, h1 long, h2 int")


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window of ``length`` that starts at ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _rid(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(_k1, _k2, n_removed, kept, sha) of the texts in ``found``, without the words that its windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for body, starts in zip(batch.column(2), batch.column(4)):
                words = split_words(body.as_py())
                gone = covered(len(words), starts.values.to_numpy(zero_copy_only=False), length)
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept)], names=["_k1", "_k2", "n_removed", "kept"])

    return texts.join(found, ["_k1", "_k2"]).select("_k1", "_k2", "_text", "_n", "_at").mapInArrow(run, "_k1 long, _k2 int, n_removed long, kept string")


def without_repeats(docs: DataFrame, key: list[Column], text: str = "text", length: int = 35, first: int = 18) -> DataFrame:
    """One row per row of ``docs``: the columns ``key``, n_words, n_removed, kept_sha256.

    Each word covered by a window of ``length`` words whose sequence also
    starts anywhere else, in the same text or another, is removed; windows are
    judged on the input. kept_sha256 is of the kept words joined by a space. A
    null text has no words; texts shorter than a window lose nothing; equal
    texts of a window or more lose everything.

    Texts move by hash, each different one once; what is known of windows is a
    hash, and a hot window is summed before its shuffle and split in its join.
    """
    narrow = docs.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumns({"_k1": F.xxhash64("_text"), "_k2": F.hash("_text")})
    keys = [c for c in narrow.columns if c not in ("_text", "_k1", "_k2")]
    sizes = levels(length, first)
    rows = cut_lineage(_started(narrow, length, sizes[0]))
    spots = rows.select("_k1", "_k2", F.explode("_anchors").alias("anchor"), F.lit(1).cast("long").alias("_n"))
    alive = cut_lineage(_alive(spots, ["anchor"], "anchor"))
    texts = _texts(narrow.select("_k1", "_k2", "_text"))
    for k, size in enumerate(sizes[1:-1], 1):
        windows = _extended(texts, alive, sizes[:k], size, length)
        more = _alive(windows, ["h1", "h2"], "h1").withColumnRenamed("_h1", f"_level{k}")
        alive = cut_lineage(alive.join(more, ["_k1", "_k2"]))
    found = _alive(_extended(texts, alive, sizes[:-1] or sizes, length, length), ["h1", "h2"], "at")
    rid = _rid(texts, found, length).select("_k1", "_k2", "n_removed", F.sha2("kept", 256).alias("_sha"))
    return rows.join(rid, ["_k1", "_k2"], "left").select(
        *keys, "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_sha", "kept_sha256").alias("kept_sha256"))
