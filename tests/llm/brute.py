"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def windows(words, n):
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def contamination(docs, items, n=13):
    by = defaultdict(set)
    for item, text in items:
        for g in windows(ITEM_WORD.findall((text or "").translate(UPPER)), n):
            by[g].add(str(item))
    sizes = {len(g) for g in by}
    out = {}
    for doc, text in docs:
        w = ITEM_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in by:
                    hit.update(range(i, i + k))
                    found |= by[g]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def quality(docs):
    out = {}
    for doc, text in docs:
        text = text or ""
        w = WORD.findall(text)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        rep = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        out[doc] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))
    return out


def base_spans(text):
    spans = []
    for k, (kind, pattern, fits) in enumerate((
        ("assign", r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.ASCII) if fits(m)]
    return [x[2] for x in sorted(spans)]


def shingles(text, k):
    w = [x.decode() for x in (text or "").translate(UPPER).encode().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_dups(docs, k=4, percent=80):
    sets = {d: shingles(t, k) for d, t in docs}
    index = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in index[g] if e < d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def repeats(docs, n=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) by sets of all n-byte strings."""
    data = {d: (t or "").encode() for d, t in docs}
    seen = Counter(b[i : i + n] for b in data.values() for i in range(len(b) - n + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def line_dedup(docs, least=20):
    """(n_lines, n_removed, n_near, kept text)."""
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for x in (t or "").split("\n"):
            if WORD.search(x):
                first.setdefault(x, d)
    by = defaultdict(list)
    for x in first:
        for n in {len(x), len(x) - 1} if len(x) >= least else ():
            by[n, 1, x[: n // 2]].append(x)
            by[n, 2, x[len(x) - (n - n // 2) :]].append(x)
    near = {max((first[x], x), (first[y], y))[1] for g in by.values() for i, x in enumerate(g) for y in g[:i] if x != y and one_edit(x, y)}
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = (0, 0, 0, None)
            continue
        now, seen, n_near = [], set(), set()
        for x in t.split("\n"):
            if WORD.search(x):
                if x in near and first[x] == d:
                    n_near.add(x)
                if x in near or x in seen or first[x] < d:
                    continue
                seen.add(x)
            now.append(x)
        out[d] = (len(t.split("\n")), len(t.split("\n")) - len(now), len(n_near), "\n".join(now))
    return out
