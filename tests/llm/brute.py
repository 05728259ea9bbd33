"""The operators' contracts in plain Python over small tables, written apart from the operators."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def roots(nodes: list, linked) -> dict:
    """Smallest node reachable of each node."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text: str | None, k: int = 3) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows: list[tuple]) -> dict:
    """doc_id: (fingerprint, component) of (doc_id, text)."""
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= 2]
    group = roots(ids, linked)
    return {i: (f"{prints[i]:016x}", group[i]) for i in ids}


def targets(sizes: dict, order: list, share: float = 1.5, most: float = 2.0) -> dict:
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, out, left = set(order), {}, share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


KINDS = (
    ("assign", re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def base_spans(text: str | None) -> list[tuple]:
    found = [
        (m.start(), rank, kind, m.end()) for rank, (kind, pattern, group, least) in enumerate(KINDS)
        for m in pattern.finditer(text or "") if len(m[group]) >= least
    ]
    return sorted(found)


def near_vectors(rows: list[tuple], least: float = 0.98) -> dict:
    """vec_id: (n_links, component) of (vec_id, vector, label)."""
    import numpy as np

    ok = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, n = [], Counter()
    for k, (i, v, g) in enumerate(ok):
        for j, w, h in ok[k + 1:]:
            if g == h and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= least - 1e-15:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    group = roots([i for i, _, _ in rows], links)
    return {i: (n[i], group[i]) for i, _, _ in rows}


def without_repeats(texts: list, length: int = 35) -> list[tuple]:
    """(n_words, n_removed, kept_sha256) of each text."""
    split = [WORD.findall(t or "") for t in texts]
    windows = Counter(tuple(w[i:i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if windows[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def exact(rows: list[tuple]) -> dict:
    """text: (keep_id, size) of (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}
