"""Step-by-step models that the operators are held against."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict


def words(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(docs: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    seen = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    for a, b in seen:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def deduped(docs: list[tuple[int | None, str | None]], min_chars: int = 40, min_documents: int = 5) -> list[tuple[int | None, int, int, str]]:
    """(id, lines, dropped, text) per row."""
    holders: dict[str, list[int]] = defaultdict(list)
    for i, text in docs:
        if i is not None:
            for key in {key_of(line) for line in (text or "").split("\n")}:
                if len(key) >= min_chars:
                    holders[key].append(i)
    keep = {key: max(ids) for key, ids in holders.items() if len(ids) >= min_documents}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        left = [x for x in lines if i is None or keep.get(key_of(x), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def edit_distance_within(item: str, text: str) -> int:
    """Least edits that turn item into some part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def unigrams(texts: list[str | None]) -> Counter:
    counts: Counter = Counter()
    for t in texts:
        counts.update([*words(t), None])
    return counts
