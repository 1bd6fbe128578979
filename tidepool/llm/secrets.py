"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them.

The patterns give the base spans. The field tags tokens as O (outside), B (begin) or I
(inside a secret); its features are a token's length, character shape and mix, what
separates it from its neighbours, the neighbours' shapes and whether the word before
names a secret, and features of the whole text (share of digits, of assignments,
length). It is trained here, by maximum likelihood with forward-backward, on a bounded
set: windows of at most SAMPLE documents (least hashes) labelled by the patterns, and
seeded made-up lines. Viterbi decoding runs over whole texts: blocks of tokens in
lockstep, joined by their max-plus transfer matrices, so the result is exact.
Spans of the field that don't touch a base span are added; base spans stay.

Edge cases: null counts as empty; an empty text has no span; the scan reads whole texts;
spans that start together are listed by kind; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import WHITE, slices, span_hashes, text_buffer
from .store import small_hashes

# The base patterns.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ACCESS_MIN, HEX_MIN, VALUE_MIN = 18, 16, 12
# The same matches: a run too short fails at every later start of the run as well.
_ACCESS_LONG = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX_LONG = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE = 2000
SEED = 4
WINDOW = 12  # tokens on each side of a labelled one
EPOCHS = 70
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"key", b"auth", b"bearer", b"credential", b"pwd", b"passphrase")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; code points, end exclusive."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS_LONG.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX_LONG.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# --- tokens and features -----------------------------------------------------------------

_CLASS = np.zeros(256, np.uint8)  # 0 separator, 1 lower, 2 upper, 3 digit, 4 mark inside a token, 5 other letters
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[ord(c) for c in "+/_-."]] = 4
_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[[*range(48, 58), *range(97, 103)]] = True
#: Kind of the separator before a token: 0 none or start, 1 white space, 2 '=' or ':', 3 quote, 4 other.
_SEPARATOR = np.full(256, 4, np.uint8)
_SEPARATOR[WHITE] = 1
_SEPARATOR[[61, 58]] = 2
_SEPARATOR[[34, 39]] = 3

_LENGTHS = np.array([3, 5, 8, 12, 16, 20, 28, 40])
#: Sizes of the feature families, in order.
FAMILIES = {"length": 9, "mix": 64, "shape": 32, "digits": 5, "before": 25, "after": 5, "name": 2, "previous": 64, "next": 64, "file_digits": 4, "file_assign": 3, "file_length": 4, "bias": 1}
_BASE = np.concatenate(([0], np.cumsum(list(FAMILIES.values()))))
N_FEATURES = int(_BASE[-1])
_NAME_HASHES = np.sort(np.array([span_hashes(np.frombuffer(n, np.uint8), np.array([0]), np.array([len(n)]))[0] for n in _NAMES]))


def features(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, row of each token, feature ids [token, family])."""
    n = len(data)
    kind = _CLASS[data]
    solid = kind > 0
    begin = solid.copy()
    if n:
        begin[1:] &= ~solid[:-1]
        rows = offsets[:-1][offsets[:-1] < n]
        begin[rows] = solid[rows]
    stop = np.zeros(n + 1, bool)
    stop[1:] = solid
    stop[1:-1] &= ~solid[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    row = np.searchsorted(offsets, starts, side="right") - 1
    length = ends - starts

    def count(flags):
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        return total[ends] - total[starts], total

    lower, _ = count(kind == 1)
    upper, _ = count(kind == 2)
    digit, digits = count(kind == 3)
    mark, _ = count(kind == 4)
    other = length - lower - upper - digit - mark
    hexes, _ = count(_HEXDIGIT[data])
    turn = np.zeros(n, bool)
    if n > 1:
        turn[1:] = kind[1:] != kind[:-1]
    turns, _ = count(turn)
    turns = np.maximum(turns - 1, 0)
    mix = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (mark > 0) + 16 * (other > 0) + 32 * (hexes == length)
    size = np.searchsorted(_LENGTHS, length, side="right")
    short = (length >= 12).astype(np.int64)
    shape = np.minimum(turns, 7) + 8 * np.minimum(short + (length >= 16) + (length >= 28), 3)
    share = np.where(digit == 0, 0, 1 + np.minimum(3, 4 * digit // np.maximum(length, 1)))
    gap = np.where((starts > 0) & (row == np.searchsorted(offsets, np.maximum(starts - 1, 0), side="right") - 1), _SEPARATOR[data[np.maximum(starts - 1, 0)]], 0) if n else starts
    gap2 = np.where(starts > 1, _SEPARATOR[data[np.maximum(starts - 2, 0)]], 0) if n else starts
    gap2 = np.where((gap == 0) | (kind[np.maximum(starts - 2, 0)] > 0), 0, gap2) if n else starts
    after = np.where(ends < offsets[1:][row], _SEPARATOR[data[np.minimum(ends, n - 1)]], 0) if n else starts
    low = data | np.where(kind == 2, 32, 0).astype(np.uint8)
    hashes = span_hashes(low, starts, ends) if n else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(_NAME_HASHES, hashes), len(_NAME_HASHES) - 1)
    named = _NAME_HASHES[at] == hashes
    same_before = np.concatenate(([False], row[1:] == row[:-1])) if len(row) else np.zeros(0, bool)
    name_before = np.concatenate(([False], named[:-1])) & same_before if len(row) else same_before
    previous = np.where(same_before, np.concatenate(([0], mix[:-1])), 0) if len(row) else mix
    following = np.where(np.concatenate((same_before[1:], [False])), np.concatenate((mix[1:], [0])), 0) if len(row) else mix
    # Features of the whole text.
    size_of = np.maximum(np.diff(offsets), 1)
    equals = np.concatenate(([0], np.cumsum((data == 61) | (data == 58), dtype=np.int32)))
    file_digits = np.minimum(3, 50 * (digits[offsets[1:]] - digits[offsets[:-1]]) // size_of)
    file_assign = np.minimum(2, 200 * (equals[offsets[1:]] - equals[offsets[:-1]]) // size_of)
    file_length = np.searchsorted([200, 2000, 20000], size_of)
    columns = [size, mix, shape, share, gap * 5 + gap2, after, name_before.astype(np.int64), previous, following, file_digits[row], file_assign[row], file_length[row], np.zeros(len(starts), np.int64)]
    return starts, ends, row, np.stack(columns, 1).astype(np.int32) + _BASE[:-1].astype(np.int32) if len(starts) else np.zeros((0, len(columns)), np.int32)


# --- training ------------------------------------------------------------------------------


def _made_up(rng) -> list[tuple[str, list[tuple[int, int]]]]:
    """Seeded lines with secrets of usual forms, and plain ones, with the secrets' spans."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sets = {"hex": ("0123456789abcdef", (16, 64)), "base64": (alnum + "+/", (20, 60)), "key": (alnum, (20, 44)), "access": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (14, 18))}
    vowels, others = "aeiou", "bcdfghlmnprstvw"

    def word():
        return "".join(others[rng.integers(len(others))] + vowels[rng.integers(5)] for _ in range(rng.integers(1, 6)))

    def plain(k):
        out = []
        for _ in range(k):
            w = word()
            r = rng.random()
            out.append(w.capitalize() if r < 0.1 else f"{rng.integers(1, 3000)}" if r < 0.14 else w + ("." if r < 0.2 else "," if r < 0.26 else "") if r < 0.95 else f"https://{w}.example/{word()}" if r < 0.97 else f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}" if r < 0.99 else w.upper())
        return " ".join(out)

    lines = []
    for _ in range(450):
        head = plain(rng.integers(3, 14)) + " "
        kind = list(sets)[rng.integers(4)]
        letters, (a, b) = sets[kind]
        value = ("AKIA" if kind == "access" else "") + "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(a, b)))
        lead = ["", "password=", "token: ", "api_key = \"", "secret='", "bearer ", "key="][rng.integers(7)]
        tail = "\"" if lead.endswith("\"") else "'" if lead.endswith("'") else ""
        at = len(head) + len(lead)
        lines.append((f"{head}{lead}{value}{tail} {plain(rng.integers(2, 12))}", [(at, at + len(value))]))
        lines.append((plain(rng.integers(6, 40)), []))
        lines.append((f"{plain(5)} {['token', 'secret', 'password', 'key'][rng.integers(4)]}{[': ', ' is ', '=', ' '][rng.integers(4)]}{word()} {plain(6)}", []))
    return lines


def _sequences(texts: list[tuple[str, list[tuple[int, int]]]]):
    """Windows of tokens with tags: features [sequence, 2 WINDOW + 1, family], tags (-1: padding)."""
    feats, tags = [], []
    for text, spans in texts:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _, ids = features(data, np.array([0, len(raw)]))
        if not len(starts):
            continue
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        s, e = points[starts], points[ends]
        tag = np.zeros(len(starts), np.int64)
        hot = []
        for a, b in spans:
            own = np.flatnonzero((s >= a) & (e <= b))
            if len(own):
                tag[own] = 2
                tag[own[0]] = 1
                hot.append(int(own[0]))
        # Plain texts show their longest tokens, the likeliest mistakes.
        centres = hot or np.argsort(starts - ends, kind="stable")[:2].tolist()
        for c in centres[:4]:
            lo = max(0, c - WINDOW)
            cut = slice(lo, min(len(starts), lo + 2 * WINDOW + 1))
            k = cut.stop - cut.start
            f, t = np.zeros((2 * WINDOW + 1, ids.shape[1]), np.int32), np.full(2 * WINDOW + 1, -1, np.int64)
            f[:k], t[:k] = ids[cut], tag[cut]
            feats.append(f)
            tags.append(t)
    return np.array(feats), np.array(tags)


def train(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights [feature, tag] and transitions [tag, tag] (row 3: the start of a text)."""
    rng = np.random.default_rng(SEED)
    labelled = _made_up(rng)
    for t in texts:
        spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= VALUE_MIN]
        spans += [(a, b) for a, b, k in base_spans(t) if k]
        labelled.append((t, spans))
    feats, tags = _sequences(labelled)
    n, steps, _ = feats.shape
    real = tags >= 0
    weights, trans = np.zeros((N_FEATURES, 3)), np.zeros((4, 3))
    gold_w, gold_t = np.zeros_like(weights), np.zeros_like(trans)
    for f in range(feats.shape[2]):
        np.add.at(gold_w, (feats[:, :, f][real], tags[real]), 1)
    np.add.at(gold_t, (3, tags[:, 0]), 1)
    both = real[:, 1:]
    np.add.at(gold_t, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    m1, m2, v1, v2 = (np.zeros_like(x) for x in (weights, trans, weights, trans))
    for epoch in range(1, EPOCHS + 1):
        emit = weights[feats].sum(2)
        step = trans[:3]
        alpha, scale = np.zeros((n, steps, 3)), np.zeros((n, steps, 1))
        a = emit[:, 0] + trans[3]
        for t in range(steps):
            if t:
                prior = alpha[:, t - 1][:, :, None] + step[None]
                top = prior.max(1, keepdims=True)
                a = (top + np.log(np.exp(prior - top).sum(1, keepdims=True)))[:, 0] + emit[:, t]
            scale[:, t, 0] = a.max(1)
            alpha[:, t] = np.where(real[:, t, None], a - a.max(1, keepdims=True), 0)
        beta = np.zeros((n, steps, 3))
        for t in range(steps - 2, -1, -1):
            x = step[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = x.max(2, keepdims=True)
            b = (top + np.log(np.exp(x - top).sum(2, keepdims=True)))[:, :, 0]
            beta[:, t] = np.where(real[:, t + 1, None], b, 0)
        p = alpha + beta
        p = np.exp(p - p.max(2, keepdims=True))
        p = p / p.sum(2, keepdims=True) * real[:, :, None]
        grad_w, grad_t = gold_w.copy(), gold_t.copy()
        for k in range(3):
            for f in range(feats.shape[2]):
                grad_w[:, k] -= np.bincount(feats[:, :, f].ravel(), p[:, :, k].ravel(), N_FEATURES)
        grad_t[3] -= p[:, 0].sum(0)
        pair = alpha[:, :-1, :, None] + step + (emit[:, 1:] + beta[:, 1:])[:, :, None, :]
        pair = np.exp(pair - pair.max((2, 3), keepdims=True))
        pair = pair / pair.sum((2, 3), keepdims=True) * both[:, :, None, None]
        grad_t[:3] -= pair.sum((0, 1))
        for x, g, m, v in ((weights, grad_w, m1, v1), (trans, grad_t, m2, v2)):
            g = g / n - 1e-4 * x
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x += 0.2 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return weights, trans


# --- decoding ------------------------------------------------------------------------------

_BLOCK = 64


def viterbi(emit: np.ndarray, fresh: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of token sequences laid end to end; ``fresh`` marks the first token of each."""
    n = len(emit)
    if not n:
        return np.zeros(0, np.int8)
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n
    e = np.concatenate((emit, np.tile([0.0, -1e9, -1e9], (pad, 1)))).reshape(blocks, _BLOCK, 3)
    f = np.concatenate((fresh, np.ones(pad, bool))).reshape(blocks, _BLOCK)
    best = np.full((blocks, 3, 3), -1e18)  # [block, state on entry, state now]
    best[:, np.arange(3), np.arange(3)] = 0
    back = np.zeros((_BLOCK, blocks, 3, 3), np.int8)
    for j in range(_BLOCK):
        step = np.where(f[:, j, None, None], trans[3][None, None, :], trans[None, :3, :])
        x = best[:, :, :, None] + step[:, None, :, :]
        back[j] = x.argmax(2)
        best = x.max(2) + e[:, j, None, :]
    # From block to block.
    score, entry = [0.0, 0.0, 0.0], np.zeros((blocks, 3), np.int8)
    for b, m in enumerate(best.tolist()):
        new = []
        for c in range(3):
            options = (score[0] + m[0][c], score[1] + m[1][c], score[2] + m[2][c])
            s = max(range(3), key=options.__getitem__)
            entry[b, c] = s
            new.append(options[s])
        top = max(new)
        score = [x - top for x in new]
    exit_, start = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    state = max(range(3), key=score.__getitem__)
    for b in range(blocks - 1, -1, -1):
        exit_[b] = state
        state = int(entry[b, state])
        start[b] = state
    tags = np.zeros((blocks, _BLOCK), np.int8)
    now, which = exit_, np.arange(blocks)
    for j in range(_BLOCK - 1, -1, -1):
        tags[:, j] = now
        now = back[j, which, start, now].astype(np.int64)
    return tags.reshape(-1)[:n]


def field_spans(data: np.ndarray, offsets: np.ndarray, model) -> list[list[tuple[int, int]]]:
    """Spans of the field in every row of a slice, in code points."""
    weights, trans = model
    starts, ends, row, ids = features(data, offsets)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(starts):
        return out
    emit = np.zeros((len(starts), 3))
    for f in range(ids.shape[1]):
        emit += weights[ids[:, f]]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    tags = viterbi(emit, fresh, trans)
    if not tags.any():
        return out
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    inside = (tags == 2) & ~fresh
    inside[1:] &= tags[:-1] > 0
    head = (tags > 0) & ~inside
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(tags))
    solid = np.flatnonzero(tags == 0)
    nearest = np.append(solid, len(tags))[np.searchsorted(solid, first)]
    last = np.minimum(last, nearest) - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        r = row[a]
        out[r].append((int(points[starts[a]] - points[offsets[r]]), int(points[ends[b]] - points[offsets[r]])))
    return out


def merge(base: list[tuple[int, int, int]], field: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the field's spans that touch none of them, by start, then kind."""
    extra = [(a, b, 3) for a, b in field if all(b <= s or a >= e for s, e, _ in base)]
    return sorted(base + extra, key=lambda s: (s[0], s[2], s[1]))


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A field trained on at most SAMPLE distinct texts of ``docs`` (those of small hashes) and the made-up lines."""
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text")).filter("text IS NOT NULL")
    return train([x for (x,) in small_hashes(rows, "text", SAMPLE)])


def scan(docs: DataFrame, model) -> DataFrame:
    """doc_id and spans: structs (kind, start, end), base spans and added ones, by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            kinds, starts, ends, count = [], [], [], [0]
            for lo, hi in slices(off):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                field = field_spans(part, at, shared.value)
                for i in range(hi - lo):
                    spans = merge(base_spans(part[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")), field[i])
                    kinds += [KINDS[k] for _, _, k in spans]
                    starts += [a for a, _, _ in spans]
                    ends += [b for _, b, _ in spans]
                    count.append(len(kinds))
            items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(count, pa.int32()), items)], names=["doc_id", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
