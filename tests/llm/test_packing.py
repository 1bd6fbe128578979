"""Packing: every id in one piece, no padding, pieces' ids as the tokenizer gives them for whole texts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_llm import frame, made
from tidepool.llm import packing


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(packing._tokenizer())


def ids_of(model, text):
    return np.array([*model.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")


def check(model, rows, got):
    """The contract, by the ids of whole texts; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _ in rows}
    for d, text in rows:
        ids, at = ids_of(model, text), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


def test_pieces_of_whole_texts(spark, model):
    rng = random.Random(5)
    words = ["naïve", "It's", "can't.", "<|endoftext|>", "日本語", "x" * 300, "１２", "́a", "é", "Σας", "a-b", "  ", " ", " z", "\x1c", "İ"]
    rows = made(3) + [(1000 + i, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 900)))) for i in range(80)] + [(2000, "long words here " * 9000), (2001, "w " * 4095), (2002, "w " * 4094)]
    got = packing.packed(frame(spark, rows)).collect()
    assert check(model, rows, got) == 0


@pytest.mark.parametrize("sizes", [[2100] * 40, [3, 5, 1] * 300, [4095] * 7 + [1] * 3, [2048] * 9, [1400, 1300, 1396] * 20, list(range(1, 4000, 37))])
def test_histograms_of_every_kind(spark, model, sizes):
    rows = [(i, "w " * (n - 1)) for i, n in enumerate(sizes)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert check(model, rows, got) == 0


def test_most_documents_stay_whole():
    rng = random.Random(1)
    sizes = [min(4095, int(rng.lognormvariate(6.5, 1))) or 1 for _ in range(20_000)]
    histogram = [0] * packing.BINS
    for n in sizes:
        histogram[-(-n // (packing.WINDOW // packing.BINS)) - 1] += 1
    used = packing.plan(histogram, sum(sizes))
    taken = np.sum([np.array(w) * k for w, k in used], 0)
    assert (taken <= histogram).all() and sum(k for _, k in used) <= sum(sizes) // packing.WINDOW
    assert taken.sum() > 0.6 * len(sizes)
    assert all(np.dot(w, np.arange(1, packing.BINS + 1)) == packing.BINS for w, _ in used)


def test_least_squares_is_the_least():
    rng = np.random.default_rng(3)
    for _ in range(5):
        a, b = rng.random((8, 20)), rng.standard_normal(8)
        x = packing.least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and (abs(gradient[x > 0]) < 1e-6).all()


def test_packing_of_empty_and_odd_tables(spark, model):
    assert packing.packed(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, None), (3, text), (3, text), (3, "other words"), (4, ""), (5, " \n")]
    got = packing.packed(frame(spark, rows)).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(model, t)) for _, t in rows)
    assert sorted(r.doc_tokens for r in got if r.start == 0) == sorted(len(ids_of(model, t)) for _, t in rows)
    assert packing.packed(frame(spark, [(7, None)])).collect()[0].length == 1


def test_a_small_cache_forgets(model, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 8)
    encoder, rng = packing.Encoder(packing._tokenizer()), random.Random(2)
    for _ in range(30):
        text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.choice((3, 200))))
        ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == ids_of(model, text).tolist()
