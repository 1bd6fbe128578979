"""Novelty against plain sets, with the corpus in one shard and in many."""

import random

import pytest

from tidepool.operators import novelty as N


def plain(text):
    return {text[i : i + 4] for i in range(max(1, len(text) - 3))} if text else set()


@pytest.mark.parametrize("most", [1 << 22, 300])
def test_novelty_against_sets(spark, monkeypatch, most):
    monkeypatch.setattr(N, "GRAMS", most)
    rng = random.Random(3)
    alphabet = ["ab", "cd ", "é", "日本", "\U0001f600", "\U0001f601x", "the "]
    make = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    corpus = [(i, make(rng.randint(0, 40))) for i in range(60)] + [(99, ""), (98, None), (97, "xyz")]
    rows = [(i, make(rng.randint(0, 30)) if i % 4 else rng.choice(corpus)[1]) for i in range(80)] + [(200, None), (201, ""), (202, "xyz"), (203, "a\x00")]
    dr, dc = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(corpus, "item long, text string")
    got = {r.id: (r.novelty, r.n_near) for r in N.novelty(dr, ["id"], dc, "item", near=0.3).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        own = plain(text)
        likes = [len(own & plain(t)) / len(own | plain(t)) for _, t in corpus if own and plain(t)]
        assert got[i] == (pytest.approx(1 - max(likes, default=0.0)) if own else 0.0, sum(x > 0.3 for x in likes))


def test_an_empty_corpus_and_empty_rows(spark):
    rows = spark.createDataFrame([(1, "some text")], "id long, text string")
    assert N.novelty(rows, ["id"], rows.filter("id < 0"), "id").first().novelty == 1.0
    assert N.novelty(rows.filter("id < 0"), ["id"], rows, "id").count() == 0


def test_texts_of_a_period_are_held_against_the_one_before_in_blocks(spark):
    """Copies count as rows but are compared once; the pairs of blocks hold every pair of texts."""
    from tidepool.operators.novelty import against_last_period

    draw = random.Random(5)
    texts = {(b, "".join(draw.choice("abc ") for _ in range(draw.randint(1, 14))).strip() or "a"): draw.randint(1, 50) for b in (1, 1, 2, 4) for _ in range(40)}
    rows = spark.createDataFrame([(b, x, k) for (b, x), k in texts.items()], "b long, skel string, k long")
    got = {(r.b, r.skel): (r.best, r.close) for r in against_last_period(rows, "b", "skel", "k", 0.3, size=7).collect()}
    cut = lambda x: {x[i : i + 4] for i in range(max(1, len(x) - 3))}
    like = lambda x, y: len(cut(x) & cut(y)) / len(cut(x) | cut(y))
    want = {(b, x): (max(like(x, y) for c, y in texts if c == b - 1), sum(k for (c, y), k in texts.items() if c == b - 1 and like(x, y) > 0.3)) for b, x in texts if b == 2}
    assert got == want and len(want) > 20
