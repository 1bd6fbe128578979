"""The distributed fit against one over a matrix, however the rows are dealt."""

import math
import random

import pytest

from tidepool.operators import fitting


def tokens(seed, n=900):
    rng = random.Random(seed)
    values, labels = [], []
    for i in range(n):
        good = rng.random()
        labels.append((i, round(10 * good**2, 1) if i % 50 else None))
        for metric, noise in (("a", 0.1), ("b", 0.5), ("c", 2.0)):
            if rng.random() < 0.8:
                values.append((i, metric, min(1.0, max(0.0, good + rng.uniform(-noise, noise)))))
                if rng.random() < 0.1:
                    values.append((i, metric, rng.random()))
    return values, labels


def ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def plain_objective(x, y, w):
    score = [min(fitting.BINS - 1, int(sum(a * b / sum(w) for a, b in zip(w, row, strict=True)) * fitting.BINS)) for row in x]
    a, b = ranks(score), ranks(y)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    rho = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
    left, top = len(y) // 10, 0.0
    for s in sorted(set(score), reverse=True):
        own = [v for v, t in zip(y, score, strict=True) if t == s]
        take = min(left, len(own))
        top += take * sum(own) / len(own)
        left -= take
    lift = top / (len(y) // 10) / (sum(y) / len(y))
    return 0.4 * rho + 0.6 * min(1, max(0, lift / 3))


@pytest.fixture(scope="module")
def data(spark):
    values, labels = tokens(4)
    return values, labels, spark.createDataFrame(values, "token_key long, metric_id string, normalized double"), spark.createDataFrame(labels, "token_key long, label double")


def held(spark, values, labels):
    """(part, features, label) rows in plain Python; parts by Spark's hash."""
    means = {m: sum(v for _, k, v in values if k == m) / sum(k == m for _, k, _ in values) for m in "abc"}
    own = {}
    for i, m, v in values:
        own.setdefault(i, {}).setdefault(m, []).append(v)
    part = {r.id: r.p for r in spark.range(len(labels)).selectExpr("id", "pmod(xxhash64(id), 4) = 3 AS p").collect()}
    rows = [(part[i], [sum(own[i][m]) / len(own[i][m]) if m in own[i] else means[m] for m in "abc"], y) for i, y in labels if i in own and y is not None]
    return {p: ([x for h, x, _ in rows if h == p], [y for h, _, y in rows if h == p]) for p in (False, True)}


def test_objectives_equal_those_of_the_matrix(spark, data):
    values, labels, dv, dl = data
    rows = held(spark, values, labels)
    found = fitting.labelled(dv.repartition(7), dl)
    trials = [[1, 1, 1], [2, 0.5, 0], [0, 0, 1], [5, 1, 0.2]]
    for name, part in (("train", False), ("holdout", True)):
        want = [plain_objective(*rows[part], w) for w in trials]
        assert fitting.objectives(found, name, trials).tolist() == pytest.approx(want, abs=2e-3)


def test_the_fit_weighs_what_tells(spark, data):
    values, labels, dv, dl = data
    one = {r.metric_id: r for r in fitting.fit_weights(dv, dl).collect()}
    two = {r.metric_id: r for r in fitting.fit_weights(dv.repartition(5, "metric_id"), dl.repartition(3)).collect()}
    assert {m: r.weight for m, r in one.items()} == {m: r.weight for m, r in two.items()}
    assert one["a"].weight > one["b"].weight > one["c"].weight >= 0
    rows = held(spark, values, labels)
    w = [one[m].weight for m in "abc"]
    assert one["a"].train == pytest.approx(plain_objective(*rows[False], w), abs=2e-3) and one["a"].train > plain_objective(*rows[False], [1, 1, 1])
    assert one["a"].holdout == pytest.approx(plain_objective(*rows[True], w), abs=2e-3)
    lost = {r.metric_id: r.delta for r in fitting.ablate(dv, dl).collect()}
    assert max(lost, key=lost.get) == "a"
    for j, m in enumerate("abc"):
        assert lost[m] == pytest.approx(one["a"].holdout - plain_objective(*rows[True], [0 if k == j else v for k, v in enumerate(w)]), abs=4e-3)


def test_few_tokens_are_not_fitted(spark, data):
    _, _, dv, dl = data
    assert {r.weight for r in fitting.fit_weights(dv.filter("token_key < 150"), dl).collect()} == {1.0}
    assert fitting.fit_weights(dv.filter("token_key < 0"), dl).count() == 0
