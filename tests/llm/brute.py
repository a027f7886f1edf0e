"""Plain single-machine versions to compare with."""

from __future__ import annotations

import hashlib
import re

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, kind number, kind, end) by start, then kind."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def spelled(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text: str | None, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable), every pair compared."""
    sets = [(d, shingles(t, size)) for d, t in docs]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[i + 1 :]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets}


def struck(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (words, removed, checksum of what stays) under the rule of repeated windows."""
    first: dict[tuple, tuple[int, int]] = {}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
