"""Suffix-array dedup with a run-length index.

Every byte covered by a string of WIN bytes that also starts earlier (in a smaller
doc_id, or earlier in the same document) is removed. The distinct strings around
repeated anchors (see ``anchors``) are dealt to shards of bounded size. A shard's strings
are concatenated, suffix-sorted and turned into a run-compressed Burrows-Wheeler
transform; what the index holds are its runs alone, with the suffixes sampled at run ends
and their matches. Within a run, one step of the text leads from a suffix and its
predecessor to the next pair, one symbol shorter. So matching statistics stream along the
text: from a sampled place on, the predecessor moves along and the match shrinks by one a
step, until the next sampled place. Places whose match with the predecessor reaches WIN
have equal windows; chains of such places are all occurrences of a window, and their
earliest start decides.

Edge cases: null and empty texts have no bytes; texts shorter than WIN stay whole; rows
that share a doc_id and start at the same place don't remove each other's bytes; a null
doc_id counts as smaller than any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .blocks import unpack

WIN = 100
UNIT = anchors.Unit(words=False, win=WIN, k=24)
PER_SHARD = 3000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of uint8 symbols: sorted by seven symbols, then tied suffixes by the ranks of what follows, three times as far a round."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(7, np.int64)))  # the end sorts before any symbol
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    order = np.argsort(key)
    rank = np.zeros(3 * n + 21, np.int64)  # 0 past the end; else 1 + the first place of the group of ties
    wide = 2 * int(n).bit_length() + 2 > 62

    def regroup(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes at sorted places, and the places still tied."""
        head = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        rank[order[places]] = head + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        return places[tied]

    sorted_key = key[order]
    left = regroup(np.arange(n), np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))[:n])
    far = 7
    while len(left):
        own = order[left]
        group, one = rank[own], rank[own + far]
        two = rank[own + 2 * far] if not wide else np.zeros(len(own), np.int64)
        # Places of a group stay together, so a group's number may stand for its rank.
        number = np.cumsum(np.concatenate(([True], group[1:] != group[:-1]))) - 1
        tail = one * (n + 1) + two
        by = np.lexsort((tail, number)) if wide or int(number[-1] + 1) * (n + 1) ** 2 >= 1 << 62 else np.argsort(number * (n + 1) ** 2 + tail)
        order[left] = own[by]
        g, t = number[by], tail[by]
        left = regroup(left, np.concatenate(([True], (g[1:] != g[:-1]) | (t[1:] != t[:-1]))))
        far *= 2 if wide else 3
    return order


class RunIndex:
    """Run-compressed BWT of a text: symbols and sizes of the runs, suffixes sampled at run ends, and their matches, by text place."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        """text: symbols, 0 ends a string; ends: the place of the end symbol at or after each place, which no match crosses."""
        n = len(text)
        array = suffix_array(text)
        bwt = text[array - 1]
        new = np.ones(n, bool)
        new[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        heads = np.flatnonzero(new)
        self.symbols, self.sizes, self.n = bwt[heads], np.diff(np.append(heads, n)), n
        #: Sampled suffixes: of each run's first place, by text place, and of the place before it.
        first, before = array[heads], np.append(array[heads[1:] - 1], -1)
        before = np.concatenate((before[-1:], before[:-1]))
        limit = np.where(before < 0, 0, np.minimum(ends[first] - first, ends[before] - before))
        match = _common(text, first, np.maximum(before, 0), limit)
        order = np.argsort(first)
        self.first, self.before, self.match = first[order], before[order], match[order]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text place its predecessor among the sorted suffixes, and the length of their match."""
        steps = np.diff(np.append(self.first, self.n))
        moved = np.arange(self.n) - np.repeat(self.first, steps)
        return np.repeat(self.before, steps) + moved, np.maximum(np.repeat(self.match, steps) - moved, 0)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of pairs of suffixes, at most ``limit``, eight symbols a step."""
    padded = np.concatenate((text, np.zeros(8, text.dtype)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        same = words[a[live] + out[live]] == words[b[live] + out[live]]
        whole = same.all(1)
        out[live] = np.minimum(out[live] + np.where(whole, 8, same.argmin(1)), limit[live])
        live = live[whole & (out[live] < limit[live])]
    return out


def first_places(bodies: list, docs: np.ndarray, places: np.ndarray, win: int):
    """Index of a shard: first (doc, place) of every window of every string."""
    raw = np.frombuffer(b"\0".join([*map(memoryview, bodies), b""]), np.uint8)
    lengths = np.array([len(memoryview(b)) for b in bodies], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    n = int(begin[-1])
    # Symbols are bytes plus one, as 0 ends a string; UTF-8 has no byte 0xFF.
    text = raw + np.uint8(1)
    text[begin[1:] - 1] = 0
    owner = np.repeat(np.arange(len(bodies)), lengths + 1)
    here = np.arange(n)
    ends = (begin[1:] - 1)[owner]
    before, match = RunIndex(text, ends).statistics()
    # Chains of equal windows: every place jumps to the head of its chain.
    root = np.where(match >= win, before, here)
    chained = np.flatnonzero(root != here)
    while True:
        far = root[root[chained]]
        if np.array_equal(far, root[chained]):
            break
        root[chained] = far
    # Starts as numbers that sort by (doc, place).
    known, code = np.unique(docs, return_inverse=True)
    value = (code[owner].astype(np.int64) << 40) | (places[owner] + here - begin[owner])
    least = value.copy()
    np.minimum.at(least, root[chained], value[chained])
    first = least[root]
    keep = ends - here >= win
    off = np.concatenate(([0], np.cumsum(np.maximum(lengths - win + 1, 0))))
    return known[first[keep] >> 40], first[keep] & ((1 << 40) - 1), off


def _scrubbed(with_text: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs, data, off = unpack(batch, i)
                of = anchors.covered(batch, i, len(docs), WIN)
                n, removed, runs, sha, text = [], [], [], [], []
                for row in range(len(docs)):
                    part = data[off[row] : off[row + 1]]
                    gone = of(row, len(part))
                    raw = part[~gone].tobytes()
                    n.append(len(part))
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                    sha.append(hashlib.sha256(raw).hexdigest())
                    text.append(raw if with_text else None)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def scrub(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``: the remaining bytes.

    The remaining bytes may cut a character in two, so they come as binary.
    """
    found = anchors.marked(docs, UNIT, first_places, PER_SHARD, within=True)
    out = found.mapInArrow(_scrubbed(with_text), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(anchors.real_id(out["doc"]).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
