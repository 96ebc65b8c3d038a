"""Plain definitions of the operators' results, for small inputs."""

import hashlib
import re


def spaced(text, lower=False):
    if text is None:
        return []
    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain(text):
    if text is None:
        return []
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(text, k=3):
    w = spaced(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def linked(nodes, pairs):
    """node -> smallest node reachable."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard_components(rows, k=3, percent=90):
    sets = {d: shingle_set(t, k) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(d)
    near, done = [], set()
    for d, s in sets.items():
        for e in set().union(*(by[x] for x in s)) if s else ():
            if d < e and (d, e) not in done:
                done.add((d, e))
                both = len(s & sets[e])
                if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                    near.append((d, e))
    comp = linked(sets, near)
    return {d: (len(sets[d]), comp[d]) for d in sets}


def remove_repeats(rows, size=20):
    """rows in order of their ids."""
    seen, out = set(), {}
    for d, t in rows:
        w = spaced(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            if x in seen:
                gone[i : i + size] = [True] * size
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def decontaminate(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = plain(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    out = {}
    for d, t in rows:
        w, hit, ids = plain(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[tuple(w[j : j + n])]
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out
