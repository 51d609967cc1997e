"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


class Groups:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def katz(rows, discounts):
    """rows (id, text, train) to (id, n_tokens, n_known, N, base, score)."""
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", lower(t)) + [None]
    uni, pairs = collections.Counter(), collections.Counter()
    for _, t, train in rows:
        if train:
            w = tokens(t)
            uni.update(w)
            pairs.update(zip(["start", *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    types = lambda c: np.array([0] + [sum(1 for x in c.values() if x == r) for r in range(1, 7)])
    du, dp = discounts(types(uni)), discounts(types(pairs))
    d = lambda f, c: f[c] if c <= 5 else 1.0
    kept = sum(d(du, c) * c for c in uni.values())
    total = n if kept < n - 1e-9 else kept + 1
    one = lambda w: d(du, uni[w]) * uni[w] / total if w in uni else 1 - kept / total
    sums = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for (h, w), c in pairs.items():
        s = sums[h]
        s[0] += c
        s[1] += d(dp, c) * c
        s[2] += one(w)
    weights = {}
    for h, s in sums.items():
        t = s[0] if s[1] < s[0] else s[0] + 1
        weights[h] = t, (1 - s[1] / t) / (1 - s[2])
    probability = lambda h, w: d(dp, pairs[h, w]) * pairs[h, w] / weights[h][0] if (h, w) in pairs else weights.get(h, (1, 1.0))[1] * one(w)
    for h in list(weights)[:10]:  # exactly normalised
        assert abs(sum(probability(h, w) for w in [*uni, b"\0 unknown"]) - 1) < 1e-9
    out = []
    for i, t, _ in rows:
        w = tokens(t)
        score = sum(math.log10(probability(h, x)) for h, x in zip(["start", *w[:-1]], w))
        out.append((i, len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), score))
    return out


def contamination(docs, items):
    windows: dict = {}
    for i, t in items:
        w = alnum(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w else []:
            windows.setdefault(n, {}).setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = alnum(t)
        hit, names = [0] * len(w), set()
        for n, known in windows.items():
            for s in range(len(w) - n + 1):
                found = known.get(tuple(w[s : s + n]))
                if found:
                    names |= {str(x) for x in found if x is not None}
                    hit[s : s + n] = [1] * n
        out.append((i, len(w), sum(hit), tuple(sorted(names))))
    return out


def vectors(rows, threshold=0.93):
    """rows (id, vector, label) to (id, n_links, component)."""
    ok = [
        i is not None and lab is not None and x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x)
        for i, x, lab in rows
    ]
    links, groups = [0] * len(rows), Groups(range(len(rows)))
    by = collections.defaultdict(list)
    for k, (_, x, lab) in enumerate(rows):
        if ok[k]:
            by[lab, len(x)].append(k)
    for members in by.values():
        m = np.array([rows[k][1] for k in members], float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            links[members[a]] += 1
            links[members[b]] += 1
            groups.join(members[a], members[b])
    low = {}
    for k in range(len(rows)):
        if ok[k]:
            low[groups.find(k)] = min(low.get(groups.find(k), 1 << 60), rows[k][0])
    return [(rows[k][0], links[k], low[groups.find(k)] if ok[k] else rows[k][0]) for k in range(len(rows))]


def repeats(rows, length=100):
    """rows (id, text) with unique ids or equal texts to (id, n_bytes, n_removed, n_spans, sha256)."""
    key = lambda i, t: (2**63 - 1 if i is None else i, (t or "").encode())
    seen, done = set(), {}
    for i, b in sorted({key(*r) for r in rows}, key=lambda x: x[0]):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for s in range(len(b)) if gone[s] and (s == 0 or not gone[s - 1]))
        done[i, b] = len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return [(i, *done[key(i, t)]) for i, t in rows]


def letter_grams(text):
    """n-grams of one to three characters of the letters of a text, each run of other characters one blank."""
    s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.replace("\0", " ").lower()) + " ")
    return collections.Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n].strip())


def ranking(counts, top):
    code = lambda g: [ord(c) for c in g] + [0] * (3 - len(g))
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:top])}


def languages(texts, labelled, top=300):
    """(prediction, score) of each text by out-of-place distance to the profiles of (text, lang)."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in labelled:
        if text is not None and lang is not None:
            counts[lang] += letter_grams(text)
    profiles = {lang: ranking(c, top) for lang, c in sorted(counts.items())}
    out = []
    for text in texts:
        own = ranking(letter_grams(text or ""), top)
        apart = {lang: sum(abs(i - p[g]) if g in p else top for g, i in own.items()) for lang, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x), default=None) if own else None
        out.append(("und", 0.0) if best is None else (best, 1 - apart[best] / (len(own) * top)))
    return out
