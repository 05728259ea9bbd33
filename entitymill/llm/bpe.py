"""BPE encoding and decoding with a pair occurrence index.

All different words of a part of a partition lie in one array of symbols. An
index maps each mergeable pair to all its positions. Active ranks are applied
in ascending order, each at all its positions at once, and only the lists of
the pairs that a merge touches change. The tokenizer's file is a parameter; it
is read by the driver and sent to the tasks (a vocabulary, not data).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: White space as Unicode defines it; the general \s also has four control characters.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEYOND_LATIN = re.compile("[^\0-\u024f]")
_SIGMA, _SIGMA_LOW = "\u03a3", "\u03c3"
#: Characters of text that are indexed together; bounds a task's memory, results do not depend on it.
PART_CHARS = 4_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next letter from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """A lower-casing word BPE read from a tokenizers file: NFC, white space dropped, byte letters, a word-end mark."""

    def __init__(self, spec: str):
        self.spec = spec

    def __reduce__(self):
        return WordBpe, (self.spec,)

    @classmethod
    def read(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    @cached_property
    def _file(self) -> dict:
        return json.loads(self.spec)

    @cached_property
    def vocab(self) -> dict[str, int]:
        return self._file["model"]["vocab"]

    @cached_property
    def added(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self._file["added_tokens"]}

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}

    @cached_property
    def names(self) -> tuple[np.ndarray, bool]:
        """Tokens by id, and whether an id up to the largest has none."""
        out = np.full(max(self.tokens) + 1, None, object)
        for i, token in self.tokens.items():
            out[i] = token
        return out, len(self.tokens) < len(out)

    @cached_property
    def _symbols(self) -> tuple[list[int], list[int]]:
        """Ids of each byte inside a word and at its end."""
        end = self._file["model"]["end_of_word_suffix"]
        return [self.vocab[c] for c in byte_letters()], [self.vocab[c + end] for c in byte_letters()]

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the mergeable pairs in order, their ranks, and by rank the symbol made."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in self._file["model"]["merges"]]
        code = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code)
        return code[order], order, made

    @cached_property
    def _marks(self) -> regex.Pattern | None:
        return regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    @cached_property
    def _split(self) -> str:
        return self._file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    @cached_property
    def _words(self) -> regex.Pattern:
        return regex.compile(self._split.replace(r"[^\s", "[^" + _SPACE))

    @cached_property
    def _latin_words(self) -> re.Pattern:
        """The same over Latin text, with the letters and numbers below U+0250 spelled out; several times faster."""
        kind = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        latin = self._split.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{kind['L']}{kind['N']}]")
        return re.compile(latin.replace(r"[\p{L}]", f"[{kind['L']}]").replace(r"[\p{N}]", f"[{kind['N']}]"))

    def words(self, text: str | None) -> list[str]:
        """Words in order; an added token found in the raw text is one word, led by a NUL so that no word equals it."""
        out, at, text = [], 0, text or ""
        for mark in self._marks.finditer(text) if self._marks else ():
            out += self._plain(text[at:mark.start()])
            out.append("\0" + mark[0])
            at = mark.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self._latin_words.findall(text.lower())
        # lowered letter by letter, whatever stands around it; white space splits words and is dropped, so it need not be evened out
        text = unicodedata.normalize("NFC", text).replace(_SIGMA, _SIGMA_LOW).lower()
        return (self._words if _BEYOND_LATIN.search(text) else self._latin_words).findall(text)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has."""
        inside, last = self._symbols
        raw = [w.encode() for w in words]
        symbols = np.array(inside, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum([len(w) for w in raw])
        symbols[ends - 1] = np.array(last, np.int32)[np.frombuffer(bytes(w[-1] for w in raw), np.uint8)]
        alive = PairIndex(symbols, ends, *self.merges).apply()
        return symbols[alive], np.add.reduceat(alive.astype(np.int64), np.concatenate(([0], ends[:-1])))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text ends; every different word of ``texts`` is encoded once."""
        # words are packed text by text, so that those of one text at a time are Python strings
        split = [pa.array(self.words(t), pa.string()) for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.concat_arrays(split).dictionary_encode() if split else pa.array([], pa.string()).dictionary_encode()
        del split
        word, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if not distinct:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        special = {k: self.added[w[1:]] for k, w in enumerate(distinct) if w[0] == "\0" and w[1:] in self.added}
        for k in special:
            distinct[k] = "."  # a stand-in of one id
        ids, count = self.encode_words(distinct)
        start = np.cumsum(count) - count
        for k, i in special.items():
            ids[start[k]] = i
        per = count[word]
        ends = np.cumsum(per)
        flat = ids[np.repeat(start[word] - (ends - per), per) + np.arange(per.sum())]
        return flat, np.concatenate(([0], ends))[np.cumsum(n_words)]


class PairIndex:
    """Positions of every mergeable pair over many words; see the module's description."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, codes: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        n = len(symbols)
        self.symbols, self.codes, self.ranks, self.made = symbols, codes, ranks, made
        self.next, self.prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.next[ends - 1] = -1
        self.prev[np.concatenate(([0], ends[:-1]))] = -1
        self.alive = np.ones(n, bool)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.next >= 0).astype(np.int32))

    def _add(self, left: np.ndarray) -> None:
        """Index the pairs that begin at ``left``."""
        if not len(left):
            return
        code = self.symbols[left].astype(np.int64) << 32 | self.symbols[self.next[left]]
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == code
        if not known.any():
            return
        left, rank = left[known], self.ranks[at[known]]
        if len(rank) > 1:
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        firsts = rank[np.concatenate(([0], cuts))].tolist()
        bounds = [0, *cuts.tolist(), len(rank)]
        for r, a, b in zip(firsts, bounds, bounds[1:]):
            if r in self.lists:
                self.lists[r].append(left[a:b])
            else:
                self.lists[r] = [left[a:b]]
                heapq.heappush(self.active, r)

    def apply(self) -> np.ndarray:
        """Merge until no pair is left; which positions still hold a symbol."""
        pair = np.empty(len(self.made), np.int64)
        pair[self.ranks] = self.codes
        while self.active:
            r = heapq.heappop(self.active)
            lists = self.lists.pop(r)
            left = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            code = int(pair[r])
            a, b = code >> 32, code & 0xFFFFFFFF
            right = self.next[left]
            keep = self.alive[left] & (self.symbols[left] == a) & (right >= 0) & (self.symbols[right] == b)
            left, right = left[keep], right[keep]
            if a == b and len(left) > 1:  # in a run of equal symbols every second pair from the left
                head = np.concatenate(([True], right[:-1] != left[1:]))
                at = np.arange(len(left))
                odd = (at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 1
                left, right = left[~odd], right[~odd]
            if not len(left):
                continue
            after = self.next[right]
            self.symbols[left] = self.made[r]
            self.alive[right] = False
            self.next[left] = after
            linked = after >= 0
            self.prev[after[linked]] = left[linked]
            before = self.prev[left]
            self._add(np.unique(np.concatenate((before[before >= 0], left[linked]))))
        return self.alive


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters."""
    start, held = 0, 0
    for i, one in enumerate(texts):
        held += len(one.as_py() or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _ids_of(part: pa.Array, bpe: WordBpe) -> pa.ListArray:
    flat, ends = bpe.encode(part.to_pylist())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.int32()))


def _texts_of(lists: pa.ListArray, bpe: WordBpe) -> pa.Array:
    names, gaps = bpe.names
    texts = []
    for one in lists:
        if not one.is_valid:
            texts.append(None)
            continue
        i = one.values.to_numpy(zero_copy_only=False)
        inside = (i >= 0) & (i < len(names))
        found = names[i if inside.all() else i[inside]].tolist()
        texts.append(" ".join([t for t in found if t is not None] if gaps else found))
    return pa.array(texts, pa.string())


def _coded(docs: DataFrame, bpe: WordBpe, text: str, ids: str, decoded: str | None, part_chars: int) -> DataFrame:
    """``docs`` without columns of the new names, and these: ids of the text, and if asked for the text they decode to."""
    new = [ids] + [decoded] * (decoded is not None)
    kept = docs.drop(*[n for n in new if n != text])
    if text in new:
        kept = kept.withColumnRenamed(text, "_text")
        text = "_text"
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _parts(batch.column(at), part_chars):
                part = batch.slice(a, b - a)
                lists = _ids_of(part.column(at), bpe)
                texts = [_texts_of(lists, bpe)] if decoded is not None else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *texts], names=[*part.schema.names, *new])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    out = kept.mapInArrow(run, ", ".join([*kinds, f"`{ids}` array<int>", *[f"`{decoded}` string"] * (decoded is not None)]))
    return out.drop("_text") if text == "_text" else out


def encode(docs: DataFrame, bpe: WordBpe, text: str = "text", out: str = "ids", part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with the list of token ids of every whole text in ``out`` (which replaces a column of that name); null counts as empty.

    Special tokens written in a text are recognised, none are added. Rows stay
    where they are: no shuffle.
    """
    return _coded(docs, bpe, text, out, None, part_chars)


def round_trip(docs: DataFrame, bpe: WordBpe, text: str = "text", ids: str = "ids", decoded: str = "decoded", part_chars: int = PART_CHARS) -> DataFrame:
    """encode, and decode what it made, in one pass."""
    return _coded(docs, bpe, text, ids, decoded, part_chars)


def decode(docs: DataFrame, bpe: WordBpe, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``out``: the tokens joined by a space, as a file without decoder has it; null for null.

    An id outside the vocabulary stands for nothing.
    """
    kept = docs.drop(out) if out != ids else docs.withColumnRenamed(ids, "_ids")
    at = kept.columns.index(ids if out != ids else "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts_of(batch.column(at), bpe)], names=[*batch.schema.names, out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*kinds, f"`{out}` string"])).drop("_ids")


def digests(docs: DataFrame, bpe: WordBpe, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, then decoded from its ids."""
    both = round_trip(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body")), bpe, "_body")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
