"""Hamming search, clusters and leaders against plain Python; candidates are few and recall is whole."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_plain import leaders
from tidepool.operators import hamming, neardup, similarity


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def clouds(seed, n, spread):
    """Fingerprints around a few centres and at random, with copies."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        h = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, spread)):
            h ^= 1 << rng.randrange(64)
        out.append(out[-1] if out and rng.random() < 0.1 else h)
    return out


@pytest.mark.parametrize(("distance", "m"), [(0, None), (3, None), (10, None), (10, 3), (10, 5), (16, None), (16, 6), (17, 17)])
def test_pairs_lose_none(spark, distance, m):
    values = clouds(distance, 140, distance)
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(values)], "id long, h long")
    want = {(a, b, (values[a] ^ values[b]).bit_count()) for a in range(140) for b in range(a + 1, 140) if (values[a] ^ values[b]).bit_count() <= distance}
    if m is None:
        got = [tuple(r) for r in similarity.hamming_pairs(df, "id", "h", distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    else:
        got = [tuple(sorted((r.x, r.y))) for r in hamming.near_hashes(df, "h", distance, cuts=hamming.bands(distance, m)).collect()]
        assert len(got) == len(set(got)) and set(got) == {tuple(sorted((signed(values[a]), signed(values[b])))) for a, b, d in want if d}


@pytest.mark.parametrize("m", range(1, 12))
def test_bands_cover_every_pair(m):
    """Whatever bits differ, some band has few enough of them."""
    rng = random.Random(m)
    cuts = hamming.bands(10, m)
    assert sum(w for _, w, _ in cuts) == 64
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 10))
        assert any(((diff >> lo) & ((1 << w) - 1)).bit_count() <= r for lo, w, r in cuts)


def test_candidates_stay_few():
    """At the reference distance a fingerprint meets a small part of the others, and an ever smaller one as they grow."""
    shares = [hamming.candidates(n, hamming.chosen(10, n)) / n for n in (10_000, 1_000_000, 100_000_000)]
    assert shares[0] < 0.03 and shares[2] <= shares[1] < 0.002


def test_clusters(spark):
    values = clouds(5, 120, 6)
    df = spark.createDataFrame([(i % 2, i, signed(h)) for i, h in enumerate(values)] + [(1, 900, None)], "k long, id long, h long")
    want = {}
    for k in (0, 1):
        own = [i for i in range(120) if i % 2 == k]
        parent = {i: i for i in own}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a in own:
            for b in own:
                if a < b and (values[a] ^ values[b]).bit_count() <= 10:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
        want |= {i: root(i) for i in own}
    got = {}
    for r in similarity.hamming_clusters(df, "id", "h", 10, ["k"]).collect():
        got.setdefault((r.k, r.cluster), set()).add(r.id)
    expected = {}
    for i, r in want.items():
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize(("seed", "local"), [(1, 4096), (2, 40), (3, 0)])
def test_leaders_as_one_pass_finds_them(spark, monkeypatch, seed, local):
    """One hot group with most rows, chains of neighbours among them; groups in a task each, the hot one in rounds, or all in rounds."""
    monkeypatch.setattr(neardup, "LOCAL", local)
    values = clouds(seed, 150, 9)
    chain = random.Random(seed).getrandbits(64)
    for k in range(30):
        chain ^= 0b111 << (2 * k)
        values.append(chain)
    random.Random(seed).shuffle(values)
    rows = [("hot" if i % 9 else "cold", i, signed(h)) for i, h in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, id long, h long")
    got = {r.id: r.leader for r in neardup.leader_groups(df, "g", "id", "h", 6).collect()}
    want = {}
    for g in ("hot", "cold"):
        want |= leaders([(i, h % (1 << 64)) for k, i, h in rows if k == g], 6)
    assert got == want


def test_leaders_of_an_empty_table(spark):
    assert neardup.leader_groups(spark.createDataFrame([], "g string, id long, h long"), "g", "id", "h", 6).count() == 0


def test_wide_distances_are_compared_in_blocks(spark):
    """All pairs within each key, over one block and over many, and no plan with thousands of constants."""
    from tidepool.operators import hamming as H

    draw = random.Random(8)
    seeds = [draw.getrandbits(64) for _ in range(12)]
    made = sorted({(g, (s ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 12)))) - (1 << 63)) for s in seeds for g in (1, 2, None) for _ in range(6)}, key=str)
    rows = spark.createDataFrame(made, "g int, h long")
    want = sorted((str(g), x, y, bin((x ^ y) & (1 << 64) - 1).count("1")) for g, x in made for k, y in made if g == k and x < y and bin((x ^ y) & (1 << 64) - 1).count("1") <= 16)
    own = rows.select("g", F.col("h").alias("x")).distinct()
    for found in (H.near_hashes(rows, "h", 16, ["g"]), H.in_blocks(own, 16, ["g"], len(made), size=9)):
        assert sorted((str(r.g), r.x, r.y, r.distance) for r in found.collect()) == want
    assert len(want) > 100
    assert len(H.near_hashes(rows, "h", 16)._jdf.queryExecution().toString()) < 20_000


def test_clusters_at_a_wide_distance_are_made_without_probes(spark):
    """Components over blocks equal those over the bands."""
    draw = random.Random(11)
    seeds = [draw.getrandbits(64) for _ in range(9)]
    made = [(i, signed(draw.choice(seeds) ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 9))))) for i in range(80)]
    rows = spark.createDataFrame(made, "i long, h long")
    assert len(hamming.near_hashes(rows, "h", 17)._jdf.queryExecution().toString()) < 20_000
    got = {r.i: r.cluster for r in similarity.hamming_clusters(rows, "i", "h", 17).collect()}
    part = {h: h for _, h in made}
    for _ in made:
        for _, a in made:
            for _, b in made:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= 17:
                    part[a] = part[b] = min(part[a], part[b])
    assert got == {i: part[h] for i, h in made}


def test_blocks_give_a_forest_of_dense_clusters(spark):
    """Of near fingerprints, a pair of blocks gives fewer pairs than it has fingerprints, and components stay the same."""
    draw = random.Random(12)
    seeds = [draw.getrandbits(64) for _ in range(4)]
    made = sorted({signed(draw.choice(seeds) ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6)))) for _ in range(240)})
    own = spark.createDataFrame([(h,) for h in made], "x long")
    for size in (60, 1000):
        k = -(-len(made) // size)
        pairs = {f: [(r.x, r.y) for r in hamming.in_blocks(own, 17, [], len(made), size, forest=f).collect()] for f in (False, True)}
        assert len(pairs[False]) > 5000 and set(pairs[True]) < set(pairs[False]) and len(pairs[True]) < k * (k + 1) * 2 * size
        parts = []
        for f in (False, True):
            part = {h: h for h in made}
            for _ in range(len(made)):
                last = dict(part)
                for a, b in pairs[f]:
                    part[a] = part[b] = min(part[a], part[b])
                if part == last:
                    break
            parts.append(part)
        assert parts[0] == parts[1]
        if k == 1:
            assert len(pairs[True]) == len(made) - len(set(parts[0].values()))
    plan = similarity.hamming_clusters(own.withColumn("i", F.col("x")), "i", "x", 17)
    assert {r.i: r.cluster for r in plan.collect()} == parts[0]


def test_leaders_of_many_groups_in_bundles(spark):
    """A task takes many groups at a time, and each is gone through as if it were alone."""
    rng = random.Random(5)
    rows = [(g, 10 * g + k, rng.getrandbits(4) - 8 if k else 7, k) for g in [None, *range(300)] for k in range(9) for g in [g if g is not None else 300]]
    df = spark.createDataFrame(rows, "g long, id long, h long, w long")
    want = {}
    for g in {r[0] for r in rows}:
        led = []
        for _, i, h, _ in sorted(r for r in rows if r[0] == g):
            near = [x for x in led if bin((x[1] ^ h) & (2**64 - 1)).count("1") <= 2]
            want[i] = near[0][0] if near else i
            led += [] if near else [(i, h)]
    got = neardup.leader_groups(df, "g", "id", "h", 2, "w")
    assert {r.id: (r.leader, r.w) for r in got.collect()} == {r[1]: (want[r[1]], r[3]) for r in rows}


def test_plain_texts_need_no_python(spark):
    """ASCII texts are normalised and cut to skeletons by Spark itself, as Python does it."""
    from tidepool.functions import text as X

    texts = [None, "", " ", "A\x1cB\x1f\tc \n", "Gm @Al_1 $SOL #Gem https://e.co/1?x 12.5k!!  <a> it's", "１２ ＠Ab Straße é​ \U0001f680 #日本 $Abc", "x" * 30 + "\x0b\x0c\r end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: r.n for r in df.select("id", X.normalize("text").alias("n")).collect()}
    normal = X.normal_rows(df, "id")
    assert {r.id: r.text for r in normal.collect()} == want
    patterns = [*X.KINDS, (X.EMOJI, "emo")]
    old = F.col("text")
    for pattern, kind in patterns:
        old = F.regexp_replace(old, f"(?U){pattern}", f" <{kind}> ")
    old = F.trim(F.regexp_replace(F.regexp_replace(old, r"(?U)[^\w<>\s]", " "), r"(?U)\s+", " "))
    rows = normal.select(X.skeletonize("text").alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in rows) and any(r.new and "<emo>" in r.new for r in rows)
