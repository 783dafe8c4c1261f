"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_components(docs):
    """{doc_id: (n_shingles, component)} from all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = {}
    for d, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(d)
    common = {}
    for ds in holds.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_bytes(docs, length, first_only=False):
    """[(doc_id, n_bytes, n_removed, n_spans, rest)] in the order of ``docs``, which is the order of texts."""
    seen = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for k, (_, b) in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i:i + length], []).append((k, i))
    gone = [bytearray(len(b)) for _, b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places[1:] if first_only else places:
                gone[k][i:i + length] = b"\x01" * length
    out = []
    for (d, b), g in zip(data, gone, strict=True):
        runs = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((d, len(b), sum(g), runs, bytes(x for x, y in zip(b, g, strict=True) if not y)))
    return out
