"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: bytes | str) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def clean_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def decontaminate(docs, items, size=13):
    """docs, items: (id, text). Returns {(id, text): row}."""
    wins = defaultdict(set)
    for i, t in items:
        w = clean_words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w, hit, ids = clean_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[x]
        out[d, t] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def fingerprint(text):
    w = BLANK.findall((text or "").translate(UP))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, radius=2):
    fps = [(d, fingerprint(t)) for d, t in docs]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        groups[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(fps)), key=str)


def base_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            found.append((m.start(), 2, m.end(), "hex"))
    return sorted(found)


def substrings(docs, size=50):
    """Returns {(id, text): (n_words, n_removed, kept sha)}."""
    first: dict[tuple, int] = {}
    words = {(d, t): BLANK.findall(t or "") for d, t in docs}
    for (d, _), w in words.items():
        for k in range(len(w) - size + 1):
            if d is not None:
                x = tuple(w[k : k + size])
                first[x] = min(first.get(x, d), d)
    out = {}
    for (d, t), w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if d is not None and first[tuple(w[k : k + size])] < d:
                gone |= set(range(k, k + size))
        out[d, t] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def edited(docs):
    """docs sorted by id. Returns [(id, edited text, next text)]."""
    out = []
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1] or ""
        t = t or ""
        half = len(t) // 2
        out.append((d, t[: len(t) - half] + nxt[:half], nxt))
    return out


def jaccard(a, b, size=5):
    def shingles(t):
        w = BLANK.findall(t)
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def crc_mod(doc_id, n):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % n


def bits_of(x: int) -> np.ndarray:
    return np.array([x >> b & 1 for b in range(64)])
