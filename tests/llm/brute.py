"""Plain versions of the operators' contracts, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(ids, links):
    """Smallest id reachable by links, for each id."""
    parent = {i: i for i in ids}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(docs, percent):
    """doc_id: (n_shingles, component) for a dict of texts."""
    sets = {d: shingles(t) for d, t in docs.items()}
    inverted = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    shared = Counter()
    for members in inverted.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    where = groups(docs, links)
    return {d: (len(sets[d]), where[d]) for d in docs}


def cosine_links(vectors, least):
    """vec_id: (n_links, component) for a dict of vectors."""
    good = {}
    for v, x in vectors.items():
        if x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x):
            y = np.array(x, float)
            good[v] = y / np.linalg.norm(y)
    ids = sorted(good)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    n = Counter(x for pair in links for x in pair)
    where = groups(vectors, links)
    return {v: (n[v], where[v]) for v in vectors}


def repeated_words(docs, window=20):
    """doc_id: (n_words, n_removed, kept_sha256)."""
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    seen, out = set(), {}
    for d in sorted(docs):
        w = words[d]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_bytes(docs, window=50):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        keys = [raw[i : i + window] for i in range(len(raw) - window + 1)]
        gone = bytearray(len(raw))
        for i, k in enumerate(keys):
            if k in seen:
                gone[i : i + window] = b"\1" * window
        seen.update(keys)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(text):
    """(counts by kind, sha256 of the listing)."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ("assign", "access", "hex")
    listing = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
    n = Counter(k for _, k, _ in found)
    return tuple(n[k] for k in range(3)), hashlib.sha256(listing.encode()).hexdigest()
