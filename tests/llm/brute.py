"""Plain Python twins of the operators' definitions."""

from __future__ import annotations

import re
from collections import defaultdict

SMALL = {c: c + 32 for c in range(65, 91)}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))


def alphanumeric(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def shingle_set(text: str | None, size: int) -> frozenset:
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def shingle_classes(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """``id -> (set size, smallest linked id)``, all pairs with a common shingle compared."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common: dict[tuple[int, int], int] = defaultdict(int)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] += 1
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def passages(text: str | None, items: list[tuple[object, str | None]], window: int) -> tuple[int, set[int], set]:
    """``(words, places of hit words, items)``."""
    w = alphanumeric(text)
    hit, found = set(), set()
    for name, item in items:
        v = alphanumeric(item)
        m = min(window, len(v))
        for a in range(len(v) - m + 1 if v else 0):
            for b in range(len(w) - m + 1):
                if w[b : b + m] == v[a : a + m]:
                    hit.update(range(b, b + m))
                    found.add(name)
    return len(w), hit, found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)
