"""Plain versions of the operators, for small tables."""

import math
import re
from collections import Counter

import numpy as np


def near_pairs(blocks, threshold=0.8, least=40):
    bags = {i: Counter(re.findall(r"[A-Za-z0-9_]+", t or "")) for i, t in blocks.items() if i is not None}
    bags = {i: b for i, b in bags.items() if sum(b.values()) >= least}
    out = set()
    for i, a in bags.items():
        for j, b in bags.items():
            if i < j and (a & b).total() >= threshold * (a | b).total() - 1e-9:
                out.add((i, j))
    return out


def nearest(vectors, k=5, least=0.8, dimension=128):
    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and len(v) == dimension and None not in v}
    good = {i: v / np.linalg.norm(v) for i, v in good.items() if np.isfinite(v).all() and np.abs(v).sum() > 0}
    out = set()
    for i, v in good.items():
        near = sorted((-round(float(v @ w), 6), j) for j, w in good.items() if j != i and v @ w >= least - 1e-12)
        out |= {(min(i, j), max(i, j)) for _, j in near[:k]}
    return out


def places(semantic, full_text, top=10):
    """Both lists with higher is better."""
    value = {}
    for hits in (semantic, full_text):
        best = {}
        for q, i, v in hits:
            if v is not None and not math.isnan(v):
                best[q, i] = max(best.get((q, i), -math.inf), v)
        for q in {q for q, _ in best}:
            order = sorted((-v, i) for (p, i), v in best.items() if p == q)
            for n, (_, i) in enumerate(order, 1):
                value.setdefault(q, Counter())[i] += 1 / (60 + n)
    return {(q, n, i) for q, c in value.items() for n, (_, i) in enumerate(sorted((-round(v, 12), i) for i, v in c.items())[:top], 1)}


def stretches(texts, run):
    holders = {}
    for d, t in texts.items():
        for i in range(len(t or "") - run + 1):
            holders.setdefault(t[i : i + run], set()).add(d)
    out = set()
    for d, t in texts.items():
        hit = [i for i in range(len(t or "") - run + 1) if len(holders[t[i : i + run]]) > 1]
        while hit:
            a = z = hit[0]
            while hit and hit[0] <= z + run:
                z = hit.pop(0)
            out.add((d, a, z + run))
    return out


def pieces(text, limit=1800, least=900, overlap=150):
    if text is None or len(text) <= limit:
        return []
    out, s = [], 0
    while len(text) - s > limit:
        spots = range(s + limit, s + least, -1)
        kinds = [
            lambda e: text[e - 1] == "\n" and not text[text.rfind("\n", 0, e - 1) + 1 : e - 1].strip(" \t\r"),
            lambda e: text[e - 1] == "\n",
            lambda e: text[e - 1] == " ",
            lambda e: True,
        ]
        e = next(e for kind in kinds for e in spots if kind(e))
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(text))]
