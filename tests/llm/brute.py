"""Slow, plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Union:
    def __init__(self, items):
        self.of = {i: i for i in items}

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.of[max(a, b)] = min(a, b)


def shingles(text, k=5):
    words = SPACED.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_components(texts: dict[int, str | None]):
    """doc_id -> (n_shingles, component_id) for unique ids."""
    sets = {i: shingles(t) for i, t in texts.items()}
    u = Union(sets)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= 80 * (len(x) + len(y) - same):
                    u.join(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


def contamination(texts, items, window=13):
    """(n_words, n_hit, sorted item ids as strings) for each text."""
    wins = defaultdict(set)
    for item, text in items:
        ws = ALNUM.findall((text or "").translate(LOWER))
        if ws:
            m = min(len(ws), window)
            for i in range(len(ws) - m + 1):
                wins[tuple(ws[i : i + m])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for text in texts:
        ws = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(ws) - m + 1):
                w = tuple(ws[i : i + m])
                if w in wins:
                    hit.update(range(i, i + m))
                    found |= wins[w]
        out.append((len(ws), len(hit), sorted(found)))
    return out


def repeats(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) for each text: all strings of ``length`` bytes that recur."""
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def tokens(texts, path):
    """(start, n, crc32) of each text's ids with the end id."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    start, out = 0, []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def vector_links(vectors, threshold=0.9):
    """(n_links, component index) of each vector (None or bad: 0, itself)."""
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for v in vectors]
    links, u = [0] * n, Union(range(n))
    for i in range(n):
        for j in range(i + 1, n):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], float), np.array(vectors[j], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    u.join(i, j)
    return links, [u.find(i) for i in range(n)]


def fill_targets(sizes: dict, weights=(1, 2, 3), ratio=3):
    """Targets by resharing the excess until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > ratio * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: ratio * sizes[s] for s in over})


def language(model, text, window, letter):
    """Mean of the positions' probabilities over letter bytes, a position and a unit at a time."""
    raw, h_size = text.encode(), model.u[0].shape[1]
    total, counted = [0.0] * len(model.langs), 0
    for a in range(0, len(raw), window):
        piece = raw[a : a + window].ljust(window, b"\0")
        states = []
        for x, u, order in ((model.x[0], model.u[0], range(window)), (model.x[1], model.u[1], range(window - 1, -1, -1))):
            h, seen = [0.0] * h_size, {}
            for t in order:
                own = [float(x[k][piece[t]]) for k in range(3 * h_size)]
                back = [sum(float(u[k][j]) * h[j] for j in range(h_size)) for k in range(3 * h_size)]
                gate = [(own[k] + back[k]) / (2 + abs(own[k] + back[k])) * 0.5 + 0.5 for k in range(2 * h_size)]
                new = []
                for j in range(h_size):
                    n = own[2 * h_size + j] + gate[h_size + j] * back[2 * h_size + j]
                    n /= 1 + abs(n)
                    new.append(gate[j] * h[j] + (1 - gate[j]) * n)
                h = seen[t] = new
            states.append(seen)
        for t in range(min(window, len(raw) - a)):
            if letter[piece[t]]:
                both = states[0][t] + states[1][t] + [1.0]
                z = [sum(float(w) * v for w, v in zip(row, both)) for row in model.out]
                e = [np.exp(v - max(z)) for v in z]
                total = [s + v / sum(e) for s, v in zip(total, e)]
                counted += 1
    return [v / max(counted, 1) for v in total]
