"""Plain versions of the operators, and small awkward tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def in_order(rows):
    """Rows by (id, text), null ids and texts last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def without_windows(rows, length):
    """(id, words, removed, kept text) of each row."""
    seen, out = set(), []
    for doc, text in in_order(rows):
        own = words(text)
        gone = [False] * len(own)
        for p in range(len(own) - length + 1):
            window = tuple(own[p:p + length])
            if window in seen:
                gone[p:p + length] = [True] * length
            seen.add(window)
        out.append((doc, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return out


def without_strings(rows, length):
    """(id, bytes, removed, spans, kept bytes) of each row."""
    seen, out = set(), []
    for doc, text in in_order(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            part = data[p:p + length]
            if part in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(part)
        out.append((doc, len(data), sum(gone), sum(map(bool, bytes(gone).split(b"\0"))),
                    bytes(b for b, g in zip(data, gone) if not g)))
    return out


def shingle_set(text, length=5):
    own = words((text or "").translate(LOWER))
    return {tuple(own[i:i + length]) for i in range(max(1, len(own) - length + 1))} if own else set()


def near_groups(rows):
    """(id, set size, smallest linked id) of each row with an id."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    common = Counter((a, b) for own in by.values() for a in own for b in own if a < b)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def corpus(seed, n=40, vocabulary=30, longest=60):
    """Rows (id, text) with shared passages, copies, edits, blanks, nulls and non-ASCII words."""
    r = random.Random(seed)
    letters = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    passage = [r.choice(letters) for _ in range(40)]
    out = []
    for i in range(n):
        own = [r.choice(letters) for _ in range(r.randint(0, longest))]
        kind = r.random()
        if kind < 0.3:
            a = r.randint(0, 20)
            own[len(own) // 2:len(own) // 2] = passage[a:a + r.randint(5, 20)]
        elif kind < 0.5 and out:
            own = words(out[r.randrange(len(out))][1])
            if own and r.random() < 0.7:
                own[r.randrange(len(own))] = "Edit"
        out.append((i, r.choice((" ", " ", "\n", " \t ")).join(own)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "x" * 5000), (n + 4, "A b C")]
