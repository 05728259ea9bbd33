"""Language identification of mixed-language text.

Script ranges narrow a word's candidate languages; letter n-grams score it in
each; Viterbi over the words, with a penalty for every switch, labels spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Where a script's range of letters begins; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS, _KINDS = [s for s, _ in SCRIPTS], sorted({k for _, k in SCRIPTS})
#: Bounds of the model: labelled documents it is fitted on, cells of n-grams, longest n-gram.
SAMPLE, CELLS, LONGEST = 4000, 1 << 16, 3
#: A script is a language's if it has this share of the language's letters.
SCRIPT_SHARE = 0.02
#: Cost of a switch of language, in nats.
SWITCH = 12.0
#: Texts that are labelled together; bounds a task's memory, results do not depend on it.
PART_CHARS = 2_000_000
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1 << 16)
def script_of(letter: str) -> int:
    return _KINDS.index(SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1])


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams of the words between boundaries, up to LONGEST letters, and the word of each."""
    line = "\0".join(words)
    codes = np.frombuffer(("\0" + line + "\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = codes == 0
    word = np.cumsum(edge) - 1
    cells, owner = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(1))
        inner = np.zeros(len(h), bool)  # a boundary may end an n-gram, not lie within it or be all of it
        if n == 1:
            inner |= edge
        for k in range(1, n - 1):
            inner |= edge[k:len(h) + k]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keep = np.flatnonzero(~inner)
        cells.append(((mixed >> np.uint64(33)) % np.uint64(CELLS)).astype(np.int64)[keep])
        owner.append(word[keep])
    return np.concatenate(cells), np.concatenate(owner)


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of n-gram cells by language, and which scripts a language is written in."""

    languages: list[str]
    table: np.ndarray  # CELLS x languages
    scripts: np.ndarray  # scripts x languages, bool

    def score(self, words: list[str]) -> np.ndarray:
        """Log score of each word in each language; languages not written in the word's script score far below."""
        cells, owner = ngrams(words)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        scores = np.add.reduceat(self.table[cells[order]], starts, axis=0)
        kinds = np.array([script_of(w[0]) for w in words])
        allowed = self.scripts[kinds]
        narrowed = allowed.any(axis=1)  # a script that no language is written in says nothing
        return np.where(allowed | ~narrowed[:, None], scores, scores.min(axis=1, keepdims=True) - 50.0).astype(np.float32)


def label_words(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The most likely language of each word of many texts, all texts stepped through together.

    ``scores`` has the words of text i from starts[i] on. Texts are held longest
    first, so those that still have words are always the first.
    """
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    first, left = starts[order], counts[order]
    longest = int(left[0])
    active = len(left) - np.searchsorted(left[::-1], np.arange(longest), side="right")
    best = scores[first].copy()
    came = np.zeros(scores.shape, bool)  # whether the way to (word, language) switched there
    source = np.zeros(len(scores), np.int16)  # from which language a switch came
    for i in range(1, longest):
        n = active[i]
        now, at = best[:n], first[:n] + i
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top][:, None] - switch
        switched = jump > now
        came[at], source[at] = switched, top
        best[:n] = np.where(switched, jump, now) + scores[at]
    last = best.argmax(axis=1)
    for i in range(longest - 1, -1, -1):
        n = active[i]
        at = first[:n] + i
        labels[at] = last[:n]
        moved = came[at, last[:n]]
        last[:n] = np.where(moved, source[at], last[:n])
    return labels


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, sample: int = SAMPLE) -> LanguageModel:
    """A model of the languages of ``docs`` with text and label.

    It is fitted on at most about ``sample`` labelled rows per language, chosen by the hash
    ``order``; each task counts n-grams into CELLS cells per language, so what
    reaches the driver is bounded by CELLS times the languages whatever the input.
    """
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), (order if order is not None else F.xxhash64(text)).alias("_order"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])[F.col("lang")] if counts else F.lit(0.0)
    chosen = known.filter(F.pmod("_order", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        for batch in batches:
            for one, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = _WORD.findall(body.lower())
                if not words:
                    continue
                sums = cells.setdefault(one, np.zeros(CELLS + len(_KINDS), np.int64))
                sums[:CELLS] += np.bincount(ngrams(words)[0], minlength=CELLS)
                for w in words:
                    sums[CELLS + script_of(w[0])] += len(w)
        for one, sums in cells.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["lang", "cell", "n"])

    rows = chosen.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # one row per language: its cells are bounded by CELLS
    sums = rows.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).collect()
    languages = sorted(r["lang"] for r in sums)
    counts_by = np.zeros((CELLS + len(_KINDS), len(languages)))
    for r in sums:
        at = languages.index(r["lang"])
        for cell, n in r["cells"]:
            counts_by[cell, at] = n
    grams, letters = counts_by[:CELLS] + 0.5, counts_by[CELLS:]
    table = np.log(grams / grams.sum(axis=0, keepdims=True)) if languages else grams
    table -= table.mean(axis=1, keepdims=True) if languages else 0.0  # only differences between languages count
    scripts = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(axis=0, keepdims=True))
    return LanguageModel(languages, table.astype(np.float32), scripts)


def identify(docs: DataFrame, model: LanguageModel, key: list[Column], text: str = "text", switch: float = SWITCH, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per row of ``docs``: the columns ``key``, lang_pred, score and spans (start, end, lang; code points, end exclusive).

    ``lang_pred`` is the language with most letters, ``und`` for a text that is
    null or has no letter (and if no language was learned); equal counts go to
    the first language by name. ``score`` is its share of the letters. A span
    runs from the first to the end of the last of neighbouring words of one language.
    """
    narrow = docs.select(*key, F.col(text).alias("_text"))
    keys = narrow.columns[:-1]
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.nan_to_num(pc.utf8_length(batch.column(len(keys))).to_numpy(zero_copy_only=False).astype(float))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), part_chars, side="right")))
                part = batch.slice(at, end - at)
                langs, scores, spans = _identified(part.column(len(keys)).to_pylist(), model, switch)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, spans_type)],
                    names=[*keys, "lang_pred", "score", "spans"])
                at = end

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]]
    return narrow.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double", "spans array<struct<start: int, end: int, lang: string>>"]))


def _identified(texts: list[str | None], model: LanguageModel, switch: float) -> tuple[list[str], list[float], list[list[dict]]]:
    # a letter whose lower case is several characters would move what follows
    lowered = [(t or "").lower() if len((t or "").lower()) == len(t or "") else "".join(c.lower()[:1] for c in t) for t in texts]
    found = [_WORD.findall(t) for t in lowered]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(counts) - counts
    langs, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not counts.sum() or not model.languages:
        return langs, scores, spans
    coded = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
    word, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    labels = label_words(model.score(distinct)[word], starts, counts, switch)
    letters = np.fromiter(map(len, distinct), np.int64, len(distinct))[word]
    owner = np.repeat(np.arange(len(texts)), counts)
    sums = np.bincount(owner * len(model.languages) + labels, letters, len(texts) * len(model.languages)).reshape(len(texts), -1)
    winner, total = sums.argmax(axis=1), sums.sum(axis=1)
    changed = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    by_text = np.searchsorted(changed, np.append(starts, len(labels)))
    for i, body in enumerate(lowered):
        if not counts[i]:
            continue
        langs[i], scores[i] = model.languages[winner[i]], float(sums[i, winner[i]] / total[i])
        cuts = changed[by_text[i]:by_text[i + 1]] - starts[i]
        if len(cuts) == 1:
            last = body.rindex(found[i][-1]) + len(found[i][-1])
            spans[i] = [{"start": _WORD.search(body).start(), "end": last, "lang": model.languages[labels[starts[i]]]}]
            continue
        places = [m.span() for m in _WORD.finditer(body)]
        stops = [*cuts[1:].tolist(), counts[i]]
        spans[i] = [{"start": places[a][0], "end": places[b - 1][1], "lang": model.languages[labels[starts[i] + a]]} for a, b in zip(cuts.tolist(), stops)]
    return langs, scores, spans


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 divided by 4; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """A model fitted on the documents that are not held out."""
    rest = docs.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id))
    return fit(rest, text, lang, F.xxhash64(F.col(doc_id)), sample)


def in_a_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, in all their columns: texts that are null or have no letter go."""
    model = learned(docs, doc_id, text, lang)
    columns = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]
    judged = identify(docs, model, columns, text)
    return judged.filter("lang_pred != 'und'").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
