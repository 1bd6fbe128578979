"""The conversation trie against brute force: shared heads, hot conversations split over ranges, long lists of ends, odd tables."""

import random

import pytest

from tests.llm import brute
from tidepool.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, key string, parent long, depth long, part long, n long, l1 long, at long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], KIND).repartition(5)


def found(df):
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


def talk(seed, n):
    rng = random.Random(seed)
    said = ["", None, "a", "bb", "ééé", "\U0001f600 x"]
    rows = []
    for c in rng.sample(range(0, 900), n):
        for t in range(rng.choice((1, 1, 2, 3, 9, 14))):
            rows.append((c, rng.choice((t, t, None)) if t == 0 else t, rng.choice(("user", "user", "assistant", None)), rng.choice(said[:3]) if rng.random() < 0.8 else rng.choice(said)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_against_brute_force(spark, seed):
    rows = talk(seed, 120)
    assert found(frame(spark, rows)) == brute.conversation_trie(rows)


def test_a_conversation_split_over_ranges_and_its_copies(spark):
    """Two equal conversations with most of the rows: shared nodes far deeper than a range is long."""
    rows = [(c, t, "user", f"{t % 3}") for c in (500, 600, 601) for t in range(70)] + talk(9, 30)
    assert found(frame(spark, rows)) == brute.conversation_trie(rows)


def test_many_ends_go_on_in_more_rows_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 20)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(6)]
    assert found(frame(spark, rows)) == brute.conversation_trie(rows)


def test_trie_of_empty_and_odd_tables(spark):
    assert found(frame(spark, [])) == []
    rows = [(None, 1, "user", "x"), (None, None, None, None), (7, None, None, None), (7, None, None, None), (7, 2, "b", "t"), (7, 2, "a", "u"), (-5, 1, "user", "long " * 5000), (-5, 1, "user", "long " * 5000)]
    assert found(frame(spark, rows)) == brute.conversation_trie(rows)
    one = [(3, 1, "user", "x")]
    assert found(frame(spark, one)) == brute.conversation_trie(one)
