"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are made in one pass over the labelled rows (all of them), summed by Spark per
(language, feature), and fitted on the driver: the log-probability matrix has FEATURES
columns and one row per language. It is broadcast, so its size must have a bound: at most
``most`` languages (a parameter; an error beyond, never a dropped language). A task
counts few languages at a time (HELD) and hands its sums on before it counts more; batches are scored as sparse rows (feature ids with row offsets)
against the matrix's rows.

Edge cases: null text and texts without a letter get ``und`` with score 0; without any
labelled row every text gets ``und``; equal scores go to the first language by name;
null labels are not learned from; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices, text_buffer

FEATURES = 1 << 15
ORDERS = (2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 512
HELD = 32
UNKNOWN = "und"

_memo: dict[str, np.ndarray] = {}


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    if "bmp" not in _memo:
        _memo["bmp"] = np.array([chr(i).isalpha() for i in range(0x10000)])
    out = np.zeros(len(points), bool)
    low = points < 0x10000
    out[low] = _memo["bmp"][points[low]]
    high = points[~low]
    if len(high):
        kinds, back = np.unique(high, return_inverse=True)
        out[~low] = np.array([chr(i).isalpha() for i in kinds])[back]
    return out


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a slice and their row offsets. A capital sigma has one small form here, as the other depends on what follows."""
    small = lambda s: s.replace("İ", "i").replace("Σ", "σ").lower()
    try:
        text = small(data.tobytes().decode("utf-8"))
        ahead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:  # rows that aren't UTF-8, one by one
        rows = [small(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, ahead = "".join(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), ahead


def _grams(points: np.ndarray, offsets: np.ndarray):
    """For each order: hashed feature of every start, and the first and last start of each row."""
    last = np.maximum(offsets[1:], offsets[:-1])
    for n in ORDERS:
        m = max(len(points) - n + 1, 0)
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ points[j : j + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        yield h >> np.uint32(32 - FEATURES.bit_length() + 1), offsets[:-1], np.maximum(last - n + 1, offsets[:-1])


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def flush():
        kept = {x: np.flatnonzero(c) for x, c in sums.items()}
        lang = [x for x, at in kept.items() for _ in range(1 + len(at))]
        feature = np.concatenate([np.append(-1, at) for at in kept.values()])
        number = np.concatenate([np.append(docs[x], sums[x][at]) for x, at in kept.items()])
        sums.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(feature, pa.int32()), pa.array(number, pa.int64())], names=["lang", "feature", "n"])

    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        labels = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi in slices(off):
            points, at = _points(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            names, codes = np.unique(labels[lo:hi].astype(str), return_inverse=True)
            own = np.repeat(codes, np.diff(at))
            rows = np.bincount(codes)
            for k, x in enumerate(names.tolist()):
                docs[x] = docs.get(x, 0) + int(rows[k])
                sums.setdefault(x, np.zeros(FEATURES, np.int64))
            for ids, first, stop in _grams(points, at):
                inside = np.zeros(len(ids) + 1, np.int32)
                np.add.at(inside, np.minimum(first, len(ids)), 1)
                np.add.at(inside, np.minimum(stop, len(ids)), -1)
                ok = np.cumsum(inside[:-1]) > 0
                ids, of = ids[ok], own[: len(ids)][ok]
                for k, x in enumerate(names.tolist()):
                    sums[x] += np.bincount(ids[of == k], minlength=FEATURES)
            if len(sums) > HELD:
                yield flush()
    if sums:
        yield flush()


def fit(labelled: DataFrame, most: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, log priors, log probabilities [language, feature]; labelled has text and lang."""
    rows = labelled.filter("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    if (kinds := rows.select("lang").distinct().limit(most + 1).count()) > most:
        raise ValueError(f"{kinds} languages or more, for a model of at most {most}")
    counted = counted.toArrow()
    lang = np.array(counted["lang"].to_pylist(), object)
    names = sorted(set(lang.tolist()))
    where = {x: i for i, x in enumerate(names)}
    code = np.array([where[x] for x in lang], np.int64)
    feature, n = counted["feature"].to_numpy(), counted["n"].to_numpy()
    docs, counts = np.zeros(len(names)), np.zeros((len(names), FEATURES))
    docs[code[feature < 0]] = n[feature < 0]
    seen = feature >= 0
    counts[code[seen], feature[seen]] = n[seen]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * FEATURES)
    return names, np.log(docs / docs.sum()) if names else docs, logs


def _score(points: np.ndarray, at: np.ndarray, prior: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Joint log score [row, language]."""
    out = np.tile(prior, (len(at) - 1, 1))
    for ids, first, stop in _grams(points, at):
        first, stop = np.minimum(first, len(ids)), np.minimum(stop, len(ids))
        for k in range(len(prior)):
            total = np.concatenate(([0.0], np.cumsum(logs[k][ids])))
            out[:, k] += total[stop] - total[first]
    return out


def _predicted(batch: pa.RecordBatch, names: list[str], prior: np.ndarray, logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for every row of a batch."""
    data, off = text_buffer(batch.column("text"))
    pred, prob = [], [np.zeros(0)]
    for lo, hi in slices(off):
        points, at = _points(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        letters = np.concatenate(([0], np.cumsum(_letters(points))))
        some = (letters[at[1:]] > letters[at[:-1]]) & bool(names)
        if not names:
            pred += [UNKNOWN] * (hi - lo)
            prob.append(np.zeros(hi - lo))
            continue
        joint = _score(points, at, prior, logs)
        best = joint.argmax(1)
        p = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
        pred += [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        prob.append(np.where(some, p, 0.0))
    return pred, np.concatenate(prob)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            pred, prob = _predicted(batch, *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(prob, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(score, "doc_id long, lang_pred string, score double")


def remainder():
    """crc32 of the doc_id as text, modulo 3 (null for a null doc_id)."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def fit_by_remainder(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A model learned from the documents whose remainder isn't 1."""
    return fit(docs.filter(remainder() != 1))


def accepted(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """Documents whose language is known with a posterior of ``least`` or more; all columns stay.

    Every row is judged by its own text, in one pass without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            pred, prob = _predicted(batch, *shared.value)
            good = (prob >= least) & (np.array(pred, object) != UNKNOWN)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
