"""Substring dedup with suffix automata of reference shards.

Every word that lies in a window of WIN words which also starts in a document with a
smaller doc_id is removed. Reference shards hold the distinct strings around repeated
anchors (see ``anchors``); each shard becomes one suffix automaton whose states know the
smallest document they occur in. Strings are streamed through it: the matching
statistic at a word is the longest suffix known, its suffix of WIN words tells the
window's first document, and maximal removed spans follow.

Shards are dealt to executors by anchor rather than broadcast to all: a broadcast of
all shards to all documents grows with the square of the corpus. ``scrub_against``
broadcasts the automaton of a reference of bounded size (such as a benchmark).

Edge cases: null and empty texts have no words; texts shorter than a window stay whole;
rows that share a doc_id don't remove each other's windows; a null doc_id counts as
smaller than any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .blocks import NO_ID, unpack
from .kernels import span_hashes, text_buffer, word_spans

WIN = 13
UNIT = anchors.Unit(words=True, win=WIN, k=5)
PER_SHARD = 4096
MAX_REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """A generalised suffix automaton over hashable symbols; states know their least owner."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [None]

    def add(self, word: list) -> None:
        last = 0
        for c in word:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(c)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, c, known)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.least.append(None)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = state
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.least.append(None)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        link[q] = twin
        return twin

    def own(self, word: list, owner) -> None:
        """Every prefix's state occurs in ``owner``; call ``settle`` afterwards."""
        state, least = 0, self.least
        for c in word:
            state = self.next[state][c]
            if least[state] is None or owner < least[state]:
                least[state] = owner

    def settle(self) -> None:
        """A suffix occurs wherever the longer string does."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[s]
            if p > 0 and least[s] is not None and (least[p] is None or least[s] < least[p]):
                least[p] = least[s]

    def matches(self, word: list, win: int):
        """At each place, the least owner of the window that ends there, if the matching statistic reaches it."""
        nxt, link, length = self.next, self.link, self.length
        state, known = 0, 0
        for c in word:
            while state and c not in nxt[state]:
                state = link[state]
                known = length[state]
            if c in nxt[state]:
                state, known = nxt[state][c], known + 1
            while state and length[link[state]] >= win:
                state = link[state]
                known = min(known, length[state])
            yield self.least[state] if known >= win else None


def first_documents(bodies: list, docs: np.ndarray, places: np.ndarray, win: int):
    """Index of a shard: the first document of every window of every string."""
    words = [bytes(b).split(b" ") for b in bodies]
    automaton = SuffixAutomaton()
    for w in words:
        automaton.add(w)
    for w, d in zip(words, docs.tolist(), strict=True):
        automaton.own(w, d)
    automaton.settle()
    firsts = [x for w in words for x in list(automaton.matches(w, win))[win - 1 :]]
    off = np.concatenate(([0], np.cumsum([len(w) - win + 1 for w in words])))
    return np.array(firsts, np.int64), np.zeros(len(firsts), np.int64), off  # documents alone decide


def _scrubbed(with_text: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs, data, off = unpack(batch, i)
                of = anchors.covered(batch, i, len(docs), WIN)
                n, removed, sha, text = [], [], [], []
                for row in range(len(docs)):
                    words = data[off[row] : off[row + 1]].tobytes().translate(_SPACES).split(b" ")
                    words = [w for w in words if w]
                    gone = of(row, len(words))
                    raw = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
                    n.append(len(words))
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(raw).hexdigest())
                    text.append(raw.decode("utf-8", "replace") if with_text else None)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def scrub(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one space)."""
    found = anchors.marked(docs, UNIT, first_documents, PER_SHARD, within=False)
    out = found.mapInArrow(_scrubbed(with_text), "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(anchors.real_id(out["doc"]).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def scrub_against(docs: DataFrame, reference: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: windows that occur in the texts of ``reference`` removed.

    The reference's words are bounded by MAX_REFERENCE_WORDS (an error beyond), since its
    automaton is broadcast.
    """
    automaton, total = SuffixAutomaton(), 0
    texts = []
    for row in reference.select("text").toLocalIterator():
        data, off = text_buffer(pa.array([row[0]], pa.string()))
        starts, ends, _ = word_spans(data, off)
        total += len(starts)
        if total > MAX_REFERENCE_WORDS:
            raise ValueError(f"the reference has more than {MAX_REFERENCE_WORDS} words")
        texts.append(span_hashes(data, starts, ends).tolist() if len(starts) else [])
        automaton.add(texts[-1])
    for w in texts:
        automaton.own(w, 0)
    automaton.settle()
    # Plain lists travel; the object is made anew in each task.
    shared = docs.sparkSession.sparkContext.broadcast((automaton.next, automaton.link, automaton.length, automaton.least))

    def run(batches):
        known = SuffixAutomaton()
        known.next, known.link, known.length, known.least = shared.value
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            n, removed, text = [], [], []
            for i in range(len(off) - 1):
                part = data[off[i] : off[i + 1]]
                starts, ends, _ = word_spans(part, np.array([0, len(part)]))
                words = span_hashes(part, starts, ends).tolist() if len(starts) else []
                gone = np.zeros(len(words), bool)
                for e, x in enumerate(known.matches(words, WIN)):
                    if x is not None:
                        gone[e - WIN + 1 : e + 1] = True
                n.append(len(words))
                removed.append(int(gone.sum()))
                text.append(b" ".join(part[a:b].tobytes() for a, b, g in zip(starts.tolist(), ends.tolist(), gone.tolist(), strict=True) if not g).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string())], names=["doc", "n_words", "n_removed", "kept_text"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc long, n_words long, n_removed long, kept_text string")
    return out.select(anchors.real_id(out["doc"]).alias("doc_id"), "n_words", "n_removed", "kept_text")
