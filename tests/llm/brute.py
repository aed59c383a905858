"""Plain-loop versions of the operators, for small inputs."""

import re

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def shingles(text, n=5, lower=True):
    w = words(text, lower)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows):
    """rows: (id, text) -> {id: (set size, least id of its group)}, all pairs compared."""
    rows = [(i, shingles(t)) for i, t in rows]
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for at, (i, a) in enumerate(rows):
        for j, b in rows[:at]:
            if a and b and 4 * len(a & b) >= 3 * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in rows}


def without_repeats(rows, window=20):
    """rows: (id, text) -> {id: (words, removed, kept text)}."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        covered = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                covered[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(covered), " ".join(x for x, c in zip(w, covered, strict=True) if not c))
    return out
