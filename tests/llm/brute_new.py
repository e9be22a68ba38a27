"""Plain Python versions of the contracts of packing, search and repair, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

from tests.llm.brute import UP, sha

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k=20):
    """docs, items: (id, text). Returns rows (item_id, rank, doc_id, score)."""
    words = [(d, Counter(TERM.findall((t or "").translate(UP)))) for d, t in docs]
    words = [(d, w, sum(w.values())) for d, w in words if w]
    n_docs, total = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, w, _ in words for t in w)
    out = []
    for i, text in items:
        terms = Counter(TERM.findall((text or "").translate(UP)))
        scored = []
        for d, w, n in words:
            m = 75 + 25 * n * n_docs // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 12 * m)) for t, c in terms.items() if t in w)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def damaged(rows):
    """(conv, turn, role, text) after damage; the second value names all conversations."""
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out, {r[0] for r in rows}


def repaired(rows):
    """rows (turn, role, text) of one conversation, in order. Returns its result row, by trying all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    # States by regular expression position; the least (cost, audit) to each (row, state), inserts included.
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(3):
            for q, (c, audit, lines) in list(best.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if (q, initial) in step:
                        new = (c + 3, audit + "I", (*lines, f"{role}:"))
                        best[step[q, initial]] = min(best.get(step[q, initial], new), new)
        return best

    # Keeping only the least audit by cost and state is exact: what follows depends on the state alone, and no audit of equal cost is a prefix of another.
    for (_, role, text), fault in zip(rows, faults):
        new: dict = {}
        for q, (c, audit, lines) in inserts(best).items():
            ways = [(q, c + 4, "D", lines)]
            if fault in ("", "truncated"):
                for initial, name, op, cost in ((role[:1], role, "K", 0), ("u", "user", "R", 3), ("a", "assistant", "R", 3)):
                    if (q, initial) in step:
                        ways.append((step[q, initial], c + cost + 3 * (fault == "truncated"), op, (*lines, f"{name}:{text}")))
            for to, cost, op, made in ways:
                way = (cost, audit + op, made)
                new[to] = min(new.get(to, way), way)
        best = new
    cost, audit, lines = min(v for q, v in inserts(best).items() if q in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))


def conversations(rows):
    """All conversations after damage: {conv_id: row}. Turns of a conversation are unique."""
    after, names = damaged(rows)
    per = defaultdict(list)
    for c, turn, role, text in after:
        per[c].append((turn, role, text))
    return {c: repaired(sorted(per[c], key=lambda r: (r[0] is not None, r[0] or 0))) for c in names}
