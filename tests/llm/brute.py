"""Plain, slow versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    a, b = WORD.findall(a), WORD.findall(b)
    if not a or not b:
        return False
    most = max(len(a), len(b)) // 5
    return abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most


def near_classes(rows):
    """{id: smallest id of its class} of (id, text) rows, by comparing all texts that share a word run or a text."""
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shingles = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
                for w in (WORD.findall(t or "") for _, t in rows)]
    for x, (i, s) in enumerate(rows):
        for y, (j, t) in enumerate(rows[:x]):
            if (s or "") == (t or "") or shingles[x] & shingles[y] and near(s or "", t or ""):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept bytes) of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, reach = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                for k in range(max(i, reach), i + length):
                    gone[k] = 1
                reach = i + length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, x in zip(t, gone) if not x)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target} by raising the level until none is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    pool, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = pool / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            pool -= out[s]
            free.remove(s)
    return out


def unit(key, seed="mix-1"):
    digest = hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return int(digest[:13], 16) / 2 ** 52


def mixed(rows):
    """{id: copies} of (id, source, text) rows."""
    size = {i: len(WORD.findall(t or "")) for i, _, t in rows}
    sizes = defaultdict(int)
    for i, s, _ in rows:
        sizes[s] += size[i]
    goal, out = targets(dict(sizes)), {}
    for s in sizes:
        rate = goal[s] / sizes[s] if sizes[s] else 0
        rest, run = goal[s] - int(rate) * sizes[s], 0
        for i in sorted((i for i, x, _ in rows if x == s), key=lambda i: (unit(i), i)):
            out[i] = int(rate) + (rate > int(rate) and run + size[i] / 2 <= rest)
            run += size[i]
    return out
