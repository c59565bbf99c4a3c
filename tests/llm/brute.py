"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near_duplicates(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def repeats(texts, length, n_words=0):
    """For each text: (bytes removed, runs, remaining bytes). n_words: passages of so many words go as well."""
    data = [(t or "").encode() for t in texts]
    at = defaultdict(int)
    for d in data:
        for p in range(len(d) - length + 1):
            at[d[p : p + length]] += 1
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] if n_words else [] for d in data]
    passages = defaultdict(int)
    held = [[tuple(d[a:b] for a, b in w[i : i + n_words]) for i in range(len(w) - n_words + 1)] if n_words else [] for d, w in zip(data, found, strict=True)]
    for p in (p for own in held for p in own):
        passages[p] += 1
    out = []
    for d, w, own in zip(data, found, held, strict=True):
        gone = [False] * len(d)
        for i, p in enumerate(own):
            if passages[p] > 1:
                gone[w[i][0] : w[i + n_words - 1][1]] = [True] * (w[i + n_words - 1][1] - w[i][0])
        for p in range(len(d) - length + 1):
            if at[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), runs, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()
