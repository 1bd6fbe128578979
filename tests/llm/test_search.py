"""Ranked search against brute force: ties, copies, shards of queries, odd tables; and how few documents are scored exactly."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_llm import frame, made
from tidepool.llm import lexical


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in items], "item_id long, text string, doc_id long, score long, rank long, query long, item long")


def found(spark, docs, items):
    index = lexical.build(frame(spark, docs).repartition(3))
    return sorted(map(tuple, lexical.search(index, items_frame(spark, items)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_brute_force(spark, seed):
    docs = made(seed, 150)
    rng = random.Random(seed)
    texts = [t for _, t in docs if t]
    items = [(i, " ".join(rng.choice(texts).split(" ")[: rng.randint(1, 30)] + rng.choice(texts).split(" ")[:5])) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "AB " * 50), (7, "ünïcode x ab"), (None, "ab")]
    assert found(spark, docs, items) == brute.ranked_search(docs, items)


def test_ties_and_copies_beyond_k(spark):
    """More copies than places: all tie, and the smallest ids come first."""
    docs = [(i, "the same words here") for i in range(200, 0, -1)] + [(1000 + i, f"other text number{i} same") for i in range(50)]
    items = [(1, "same words"), (2, "number7 other")]
    assert found(spark, docs, items) == brute.ranked_search(docs, items)


def test_shards_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 4)
    monkeypatch.setattr(lexical, "ROWS", 16)
    docs = made(5, 80)
    items = [(i, t) for i, t in made(5, 30)]
    assert found(spark, docs, items) == brute.ranked_search(docs, items)


def test_search_of_empty_and_odd_tables(spark):
    docs, items = made(2, 20), [(1, "ab"), (2, None)]
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None), (2, " .. ")], items) == []
    odd = [(None, "a b c"), (None, "a"), (3, "a b"), (3, "a b"), (3, "c"), (4, None), (5, ""), (6, "b " * 400_000 + "rare")]
    items = [(1, "a"), (1, "a"), (None, "b c rare"), (2, "A b B")]
    assert found(spark, odd, items) == brute.ranked_search(odd, items)


def test_bounds_hold_and_leave_few(spark):
    docs = made(6, 400)
    index = lexical.build(frame(spark, docs))
    batches = index.blocks.toArrow().to_batches()
    text = next(t for _, t in docs if t and len(t) > 300)
    term, times = np.unique(lexical._terms(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0], return_counts=True)
    shard = lexical.Shard(term, np.arange(len(term) + 1), np.zeros(len(term), np.int64), times.astype(np.int64), 1)
    uppers, reach, lows = [], 0, []
    exact = {}
    for batch in batches:
        for i in range(batch.num_rows):
            upper, slack, (held, lo, hi) = shard.bounds(batch, i)
            m, rows = lexical._at(batch, i, "m", np.int64), lexical._at(batch, i, "rows", np.uint16)
            tf = lexical._tf(batch, i, len(rows))
            score = np.zeros(len(m), np.int64)
            for t, a, b in zip(held, lo, hi, strict=True):
                score[rows[a:b]] += times[t] * lexical._impacts(tf[a:b].astype(np.int64), m[rows[a:b]])
            assert (score * 255 <= upper[0] * lexical.SCALE).all() and (score * 255 >= (upper - slack)[0] * lexical.SCALE).all()
            uppers += upper[0].tolist()
            lows += (upper - slack)[0].tolist()
    threshold = sorted(lows)[-20]
    assert sum(u >= threshold for u in uppers) < len(docs) // 3
