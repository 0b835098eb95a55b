"""Hand-made rows whose results are known from the rules themselves, for queries that SQL repeats rule by rule."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.functions import decisions
from lynceus.operators import audit, identify, metrics, sightings
from lynceus.operators import gallery as G


@pytest.mark.parametrize(
    "photos, want",
    [(1, {0.0: 5, 0.79: 5, 0.8: 15, 0.99: 15, 1.0: 30, 1.19: 30, 1.2: 45, 1.49: 45, 1.5: 95, 1.7: 95, 1.99: 95, 2.0: 97, 2.99: 97, 3.0: 98, 50.0: 98}), (2, {1.19: 30, 1.2: 30, 1.49: 30, 1.5: 95, 0.8: 15, 0.1: 5, 3.0: 98})],
)
def test_likelihood(spark, photos, want):
    df = spark.createDataFrame([(s, photos) for s in want], "s double, n int")
    assert {r.s: r.p for r in df.select("s", decisions.likelihood(F.col("s"), F.col("n")).alias("p")).collect()} == want
    if photos == 1:
        assert {r.s: r.p for r in df.select("s", decisions.likelihood(F.col("s")).alias("p")).collect()} == want


def test_score_bins_and_fit(spark):
    rows = [(0.0, False), (0.79, False), (0.8, True), (1.0, False), (1.1, True), (1.2, True), (1.5, True), (2.5, True), (3.0, True), (4.99, False), (5.0, True), (900.0, True), (-0.5, True)]
    df = spark.createDataFrame(rows, "score double, right boolean")
    fit = {"log1p": 1.5, "constant": -1.0}
    got = {r.bin: (r.n, r.right, r.fitted) for r in metrics.binned(df, fit).collect()}
    assert {k: v[:2] for k, v in got.items()} == {0.0: (2, 0), 0.8: (1, 1), 1.0: (2, 1), 1.2: (1, 1), 1.5: (1, 1), 2.0: (1, 1), 3.0: (2, 1), 5.0: (2, 2)}
    chance = lambda s: 1 / (1 + math.exp(-(1.5 * math.log1p(s) - 1.0)))
    assert got[3.0][2] == pytest.approx((chance(3.0) + chance(4.99)) / 2) and got[0.8][2] == pytest.approx(chance(0.8))
    assert "fitted" not in metrics.binned(df).columns


def test_combiners(spark):
    """Two photos, two classes, worked out by hand."""
    rows = [(1, 9, True, 0, 3.0, 0.5), (1, 9, True, 1, 1.0, 0.6), (2, 9, False, 0, 0.0, 0.1), (2, 9, False, 1, 2.0, 0.4)]
    p = spark.createDataFrame(rows, "q long, grp long, side boolean, cls int, spot double, emb double")
    f = {(q, c): math.log1p(s) + e for q, _, _, c, s, e in rows}
    score = lambda how: {r.cls: r.score for r in identify.combine(p, how).collect()}
    assert score("sum") == pytest.approx({0: f[1, 0] + f[2, 0], 1: f[1, 1] + f[2, 1]})
    assert score("sides") == pytest.approx({0: f[1, 0], 1: f[1, 1]})
    assert score("best spot, mean vector") == pytest.approx({0: math.log(4) + 0.3, 1: math.log(3) + 0.5})
    assert score("sum of spots, best vector") == pytest.approx({0: math.log(4) + 0.5, 1: math.log(2) + math.log(3) + 0.6})
    # Photo 1 votes for class 0, photo 2 for class 1, each with a thousandth of its own best score.
    want = {0: 1 + 1e-3 * f[1, 0] + 1e-6 * (f[1, 0] + f[2, 0]), 1: 1 + 1e-3 * f[2, 1] + 1e-6 * (f[1, 1] + f[2, 1])}
    assert score("vote") == pytest.approx(want, abs=1e-12)


#: Class 1: photo 1 of sighting 10, photos 2 and 3 of 11, photo 4 of 12; class 2: photos 5 and 6 of one sighting; class 3: photo 7 alone.
PHOTOS = [(1, 1, 10, 0), (2, 1, 11, 0), (3, 1, 11, 0), (4, 1, 12, 0), (5, 2, 20, 0), (6, 2, 20, 1), (7, 3, 30, 0)]
#: Consistent matches; 15 or more are strong.
MATCHES = {(1, 2): 40, (1, 3): 3, (1, 4): 2, (2, 4): 5, (3, 4): 14}
GALLERY = "id long, cls int, grp long, side int"


def met(spark):
    both = {**MATCHES, **{(b, a): n for (a, b), n in MATCHES.items()}}
    grp = {i: g for i, _, g, _ in PHOTOS}
    out = {}
    for (a, b), n in both.items():
        one = out.setdefault((a, grp[b]), [0, 0.0])
        one[0] += n >= 15
        one[1] += n
    return spark.createDataFrame([(a, g, s, t) for (a, g), (s, t) in out.items()], "id long, rgrp long, strong long, total double")


def test_support_counts_strong_sightings_and_sums_all(spark):
    got = {r.id: (r.sightings, r.total) for r in audit.support_of(met(spark), spark.createDataFrame(PHOTOS, GALLERY)).collect()}
    assert got == {1: (1, 45.0), 2: (1, 45.0), 3: (0, 17.0), 4: (0, 21.0), 5: (0, 0.0), 6: (0, 0.0), 7: (0, 0.0)}
    left = {(r.id, r.gone): (r.sightings, r.total) for r in audit.without_sighting(met(spark), audit.support_of(met(spark), spark.createDataFrame(PHOTOS, GALLERY))).collect()}
    assert left[1, 11] == (0, 2.0) and left[1, 12] == (1, 43.0) and left[3, 12] == (0, 3.0)


def test_own_sighting_is_no_support(spark):
    g = spark.createDataFrame(PHOTOS, GALLERY)
    m = met(spark)
    queries = g.selectExpr("id as q", "cls as true_cls", "grp")
    # 2 finds 1 of its class: only its own sighting supports it.  5 finds 1 from another class: the support counts.
    top = spark.createDataFrame([(2, 1, 1, 2.5), (4, 1, 1, 2.5), (5, 1, 1, 2.5), (3, 1, 4, 2.5), (6, 1, 1, 1.5), (7, 1, 1, 0.5)], "q long, cls int, ref long, score double")
    got = {r.q: (r.support, r.band) for r in audit.two_tier(top, queries, m, audit.support_of(m, g), 2.0, 1.2).collect()}
    assert got == {2: (0, "check"), 4: (1, "match"), 5: (1, "match"), 3: (0, "check"), 6: (1, "check"), 7: (1, "possibly new")}


def test_index_choice(spark):
    g, m = spark.createDataFrame(PHOTOS, GALLERY), met(spark)
    general, own = audit.index_choice(m, g, 1)
    # 1 and 2 tie in both counts, the smaller id stays; each side of a class has its own.
    assert sorted(r.id for r in general.collect()) == [1, 5, 6, 7]
    assert {(r.gone, r.id) for r in own.collect()} == {(10, 4), (11, 1), (12, 1)}
    general, own = audit.index_choice(m, g, None)
    # All but unsupported ones; classes with one sighting stay whole.
    assert sorted(r.id for r in general.collect()) == [1, 2, 5, 6, 7]
    assert {(r.gone, r.id) for r in own.collect()} == {(12, 1), (12, 2)}


def test_by_sighting_adds_up_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), int(rng.integers(4)), [float(x) for x in rng.normal(size=5)]) for i in range(40)]
    g = spark.createDataFrame(rows, "id long, cls int, grp long, v array<float>")
    v = np.array([r[3] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for a, x in zip(rows, v, strict=True):
        for b, y in zip(rows, v, strict=True):
            if a[1] == b[1] and a[2] != b[2]:
                one = want.setdefault((a[0], b[2]), [0, 0.0])
                one[0] += x @ y >= 0.2
                one[1] += x @ y
    for block in (7, None):
        got = {(r.id, r.rgrp): (r.strong, r.total) for r in G.by_sighting(g, 0.2, block).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == n and got[k][1] == pytest.approx(t) for k, (n, t) in want.items())


def test_blocks_grow_with_the_table():
    assert G.block_rows(2000, 2000, 64, 8) == G.LEAST_BLOCK and G.block_rows(10**6, 10**6, 64, 1000) == G.MOST_BLOCK
    assert G.block_rows(10**6, 10**6, 4096, 1000) * 4096 <= G.BLOCK_NUMBERS and G.block_rows(0, 0, 0, 8) >= 1


def test_comparable_photo_falls_back_to_other_views(spark):
    day = lambda s: None if s is None else __import__("datetime").date.fromisoformat(s)
    rows = [
        (1, "a", "top", "2024-01-01"), (2, "a", "top", "2024-02-01"), (3, "a", "top", "2024-02-01"), (4, "a", "left", "2023-01-01"),  # another date of the view, then the latest
        (5, "b", "top", "2024-01-01"), (6, "b", "left", "2024-01-01"), (7, "b", "rear", "2024-03-01"),  # no photo of the view: any other
        (8, "c", "top", "2024-01-01"), (9, "c", "top", "2024-01-01"), (10, "d", "top", None), (11, "e", "top", None), (12, "e", "left", None),
    ]
    df = spark.createDataFrame([(i, c, v, day(d)) for i, c, v, d in rows], "id long, cls string, view string, date date")
    assert {r.id: r.other for r in sightings.closest_comparable(df).collect()} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 7, 6: 7, 7: 5, 8: 9, 9: 8, 11: 12, 12: 11}


def test_eras(spark):
    df = spark.createDataFrame([("2023-12-31",), ("2024-01-01",), (None,)], "d string").select(decisions.era(F.to_date("d")).alias("e"))
    assert [r.e for r in df.collect()] == ["before 2024", "2024+", None]
