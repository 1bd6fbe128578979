"""Plain single-machine versions of the operators' contracts, for tests."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components_of(pairs, vertices):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def shingle_set(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(rows):
    """rows: (doc_id, text). doc_id -> (n_shingles, component_id)."""
    sets = {d: shingle_set(t) for d, t in rows}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    both = {}
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    links = [(a, b) for (a, b), k in both.items() if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)]
    comp = components_of(links, sets)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


def window_scrub(rows, win=13):
    """doc_id -> (n_words, n_removed, kept_sha256) for windows that also start in a smaller doc_id."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - win + 1):
            first.setdefault(tuple(w[i : i + win]), d)
    out = {}
    for d, w in words.items():
        drop = set()
        for i in range(len(w) - win + 1):
            if first[tuple(w[i : i + win])] < d:
                drop.update(range(i, i + win))
        kept = [x for i, x in enumerate(w) if i not in drop]
        out[d] = (len(w), len(drop), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def byte_scrub(rows, win=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) for byte strings that also start earlier."""
    raw = {d: (t or "").encode() for d, t in rows}
    seen, out = set(), {}
    for d in sorted(raw):
        b = raw[d]
        drop = bytearray(len(b))
        for i in range(len(b) - win + 1):
            s = b[i : i + win]
            if s in seen:
                drop[i : i + win] = b"\x01" * win
            else:
                seen.add(s)
        kept = bytes(x for x, r in zip(b, drop, strict=True) if not r)
        spans = sum(1 for i in range(len(b)) if drop[i] and not (i and drop[i - 1]))
        out[d] = (len(b), sum(drop), spans, hashlib.sha256(kept).hexdigest())
    return out


def conversation_trie(rows):
    """rows: (conv_id, turn, role, text). Sorted (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append(c)
        ends.setdefault(built, []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(x) == len(node) + 1 for x in below), sum(x not in inner for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked_search(docs, items, k=20):
    """Rows (item_id, rank, doc_id, score) of every item, sorted; ids may repeat or be null."""
    lower = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: TERM.findall((t or "").translate(lower))
    found = [(d, terms(t)) for d, t in docs]
    n = sum(bool(t) for _, t in found)
    total = sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, t in found:
            m = 75 + 25 * len(t) * n // total if total else 0
            s = 0
            for x in terms(text):
                if tf := t.count(x):
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)
