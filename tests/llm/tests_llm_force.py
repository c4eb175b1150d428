"""Brute-force versions that several tests use."""

import itertools
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def classes_by_force(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        sets[i] = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    root = {i: i for i in sets}
    find = lambda v: v if root[v] == v else find(root[v])
    for a, b in itertools.combinations(sets, 2):
        both = sum((sets[a] & sets[b]).values())
        if both and both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def targets_by_force(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return target
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
            capped.add(s)
