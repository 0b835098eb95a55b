"""Shortlists, matches and their verification, same pictures, resampling, drawings with replacement."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.functions import pictures
from lynceus.operators import alignment, audit, geometry, metrics, spots

FEATURES = "photo long, cls int, kp int, d array<double>, x double, y double"


def photos(seed=0, n=12):
    """Photos of four individuals: one set of keypoints each, turned and shifted, some descriptors new."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(4):
        at, d = rng.uniform(0, 1, (n, 2)), rng.uniform(0, 9, (n, 16))
        for k in range(3):
            turn = rng.uniform(-0.5, 0.5)
            m = np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
            place, own = at @ m.T + rng.uniform(-0.1, 0.1, 2), d + rng.normal(0, 0.05, d.shape)
            own[:3] = rng.uniform(0, 9, (3, 16))
            rows += [(c * 3 + k, c, i, np.abs(own[i]).tolist(), *map(float, place[i])) for i in range(n)]
    return rows


def test_shortlist_matches_and_inliers(spark, monkeypatch):
    monkeypatch.setattr(spots, "BLOCK", 5)
    p = spots.photos_of(spark.createDataFrame(photos(), FEATURES))
    e = spots.evidence(p, p)
    want = {}
    for r in e.select("q", "r", spots.score_of("mutg").alias("s")).collect():
        want.setdefault(r.q, []).append((-r.s, r.r))
    short = spots.shortlist(p, p, "mutg", 2)
    got = {}
    for r in short.collect():
        got.setdefault(r.q, set()).add(r.r)
    assert got == {q: {r for _, r in sorted(x)[:2]} for q, x in want.items()}
    assert all({q // 3} == {r // 3 for r in rs} for q, rs in got.items())  # the others of the individual
    matched = spots.matches(p, p, short)
    counts = {(r.q, r.r): [r[k] for k in spots.KINDS] for r in e.collect()}
    for r in matched.collect():
        assert [r[k] for k in spots.KINDS] == counts[r.q, r.r]
        assert sum(m.ratio < 0.8 and m.mutual and m.back < 0.8 for m in r.m) == r["mut@0.8"]
        assert sum(m.ratio < 0.67 for m in r.m) == r["q2r@0.67"]
    # All but the three new descriptors of each side follow one motion.
    out = spots.verified(matched, ("similarity", "homography")).collect()
    assert all(r.rs_similarity >= 9 and r.rs_homography >= 9 and r.rs_mutaff >= 9 and r.rs67_similarity <= r.rs_similarity for r in out)
    none = spots.verified(spots.matches(p, p, spark.createDataFrame([(0, 9), (0, 4)], "q long, r long")), ("similarity",)).collect()
    assert len(none) == 2 and all(r.rs_similarity <= 4 for r in none)


def test_votes_as_columns(spark, monkeypatch):
    monkeypatch.setattr(spots, "BLOCK", 4)
    rows = photos(3, 5)
    p = spots.photos_of(spark.createDataFrame(rows, FEATURES))
    root = {}
    for photo, cls, kp, d, _, _ in rows:
        v = np.array(d)
        root.setdefault((photo, cls), []).append(np.sqrt(v / (v.sum() + 1e-7)))
    skip = [(0, 1), (0, 2), (4, 5)]
    near = spots.nearest_refs(p, p, 3, spark.createDataFrame(skip, "q long, r long"))
    by_ref, by_cls = {}, {}
    for (q, _), own in root.items():
        for d in own:
            order = sorted((min(np.linalg.norm(d - x) for x in ds), r, c) for (r, c), ds in root.items() if r != q and (q, r) not in skip)
            edge, best = order[3][0], {}
            for gap, r, c in order[:3]:
                by_ref[q, r] = by_ref.get((q, r), 0) + edge - gap
                best[c] = min(best.get(c, 9e9), gap)
            for c, gap in best.items():
                by_cls[q, c] = by_cls.get((q, c), 0) + edge - gap
    pairs = spark.createDataFrame([(q, r, c) for q, _ in root for r, c in root if q != r], "q long, r long, cls int")
    got = spots.with_votes(pairs, near, 3).collect()
    assert len(got) == pairs.count()
    for r in got:
        assert r.lnbnn_ref == pytest.approx(by_ref.get((r.q, r.r), 0.0), abs=1e-6) and r.lnbnn_cls == pytest.approx(by_cls.get((r.q, r.cls), 0.0), abs=1e-6)


@pytest.mark.parametrize("model", list(geometry.MINIMAL))
def test_minimal_fits_are_the_single_fits(model):
    rng = np.random.default_rng(5)
    need = geometry.MINIMAL[model]
    a, b = rng.uniform(0, 1, (20, need, 2)), rng.uniform(0, 1, (20, need, 2))
    a[3] = a[3, :1]  # a set that determines nothing
    many = geometry.minimal_fits(model, a, b)
    for k in range(20):
        one = geometry.fit(model, a[k], b[k])
        if k == 3:
            assert one is None and not np.isfinite(many[k]).all()
            continue
        x, y = (m / np.linalg.norm(m) for m in (one, many[k]))
        assert np.abs(x * np.sign((x * y).sum()) - y).max() < 1e-6


def test_verify_takes_pairs_without_matches(spark):
    rows = [(1, 2, [(0.1, 0.1, 0.2, 0.2)] * 9), (1, 3, []), (1, 4, None)]
    df = spark.createDataFrame(rows, "q long, r long, m array<struct<ax:double,ay:double,bx:double,by:double>>")
    assert {(x.r, x.matches) for x in geometry.verify_lists(df, "similarity").collect()} == {(2, 9), (3, 0), (4, 0)}


def texture(rng, h, w):
    """A smooth picture with structure."""
    y, x = np.mgrid[0:h, 0:w]
    return sum(rng.uniform(10, 30) * np.sin(x * rng.uniform(0.02, 0.2) + y * rng.uniform(0.02, 0.2) + rng.uniform(0, 6)) for _ in range(8)) + 128


def test_same_pictures(spark):
    """Two motions of one array are found, an unrelated one isn't; what is found feeds the audit."""
    rng = np.random.default_rng(7)
    base = np.clip(texture(rng, 90, 120), 0, 255)
    motion = lambda t, s, dx, dy: np.array([[s * math.cos(t), -s * math.sin(t), dx], [s * math.sin(t), s * math.cos(t), dy], [0, 0, 1.0]])
    turns = {2: motion(0.1, 0.97, 4, -3), 3: motion(-0.07, 1.02, -5, 6)}
    arrays = {1: base, 4: np.clip(texture(rng, 90, 120), 0, 255)}
    arrays |= {k: alignment.warped(base, m, base.shape)[0] for k, m in turns.items()}
    pics = spark.createDataFrame([(k, 120, 90, a.astype(int).ravel().tolist()) for k, a in arrays.items()] + [(5, 120, 90, None), (6, 7, 7, [1, 2])], "id long, width int, height int, gray array<int>")
    at = rng.uniform(15, 75, (50, 2)) * [120 / 90, 1]
    d = rng.uniform(0, 9, (50, 16))
    rows = []
    for k in (1, 2, 3, 4, 5, 6):
        place = np.column_stack((at, np.ones(50))) @ turns.get(k, np.eye(3)).T
        own = d if k != 4 else rng.uniform(0, 9, d.shape)
        rows += [(k, k, i, own[i].tolist(), *map(float, place[i, :2] / 120)) for i in range(50)]
    p = spots.photos_of(spark.createDataFrame(rows, FEATURES))
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 1), (5, 1), (6, 1)], "q long, r long")
    got = {(r.b, r.a): r for r in alignment.same_pictures(spots.matches(p, p, pairs), pics).collect()}
    assert got.keys() == {(2, 1), (3, 1), (3, 2), (5, 1), (6, 1)}
    assert all(got[k].same and got[k].overlap > 0.7 and got[k].difference < 4 for k in ((2, 1), (3, 1), (3, 2)))
    assert not got[5, 1].same and got[5, 1].difference is None and not got[6, 1].same
    unlike = alignment.difference(base, arrays[4], np.eye(3))
    assert unlike[0] > alignment.SAME and unlike[1] == 1.0 and alignment.difference(base, base, np.diag([0.3, 0.3, 1.0]))[0] is None
    dated = spark.createDataFrame([(1, 1, "d1"), (2, 1, "d1"), (3, 2, "d1"), (4, 3, "d1")], "id long, cls int, date string")
    twins = alignment.duplicates(alignment.same_pictures(spots.matches(p, p, pairs), pics), dated)
    assert sorted(map(tuple, twins.collect())) == [(1, 3), (2, 3)]  # of one class and day two like pictures are expected
    best = spark.createDataFrame([(3, 1, 1, 0.9), (3, 2, 9, 0.1)], "q long, cls int, ref long, score double")
    truth = spark.createDataFrame([(3, 2)], "q long, true_cls int")
    assert [(r.flag, r.duplicate) for r in audit.flags(best, truth, 0.35, 0.05, twins).collect()] == [("", True)]


def test_warped_is_the_plain_inverse():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 256, (9, 11)).astype(float)
    m = np.array([[1.1, 0.1, -1.0], [0.05, 0.9, 0.7], [0.002, 0.001, 1.0]])
    got, covered = alignment.warped(b, m, (8, 10))
    inverse = np.linalg.inv(m)
    for y in range(8):
        for x in range(10):
            u, v, w = inverse @ [x, y, 1]
            u, v = u / w, v / w
            value = weight = 0.0
            for i in range(11):
                for j in range(9):
                    share = max(0, 1 - abs(u - i)) * max(0, 1 - abs(v - j))
                    value, weight = value + share * b[j, i], weight + share
            assert abs(got[y, x] - round(value)) <= 1 and covered[y, x] == (weight >= 0.5 - 1e-12)


def plain_resize(p, rows, columns):
    """Weights pixel by pixel, lines first."""

    def line(values, wanted):
        size = len(values)
        scale = size / wanted
        out = []
        for o in range(wanted):
            centre, wide = (o + 0.5) * scale, max(scale, 1.0)
            lo, hi = max(0, int(centre - 3 * wide + 0.5)), min(size, int(centre + 3 * wide + 0.5))
            w = []
            for i in range(lo, hi):
                t = (i - centre + 0.5) / wide
                sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
                w.append(sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0)
            whole = [int(x / sum(w) * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w]
            out.append(min(255, max(0, (sum(a * b for a, b in zip(whole, values[lo:hi], strict=True)) + 2**21) >> 22)))
        return out

    p = [line(list(map(int, r)), columns) if p.shape[1] != columns else list(map(int, r)) for r in p]
    p = list(zip(*p, strict=True))
    p = [line(list(c), rows) if len(c) != rows else list(c) for c in p]
    return [list(r) for r in zip(*p, strict=True)]


@pytest.mark.parametrize("shape", [(16, 17), (8, 8), (40, 31), (1, 1), (5, 300), (200, 17), (16, 90)])
def test_resampling(spark, shape):
    g = np.random.default_rng(sum(shape)).integers(0, 256, shape)
    want = plain_resize(g, 16, 17)
    assert pictures.resampled(g).tolist() == want
    df = spark.createDataFrame([(g.ravel().tolist(), shape[1], shape[0]), ([1, 2], 3, 3), (None, 1, 1), ([1], None, 1)], "p array<int>, w int, h int")
    got = [r[0] for r in df.select(pictures.hash_picture("p", "w", "h")).collect()]
    assert got[0] == [x for r in want for x in r] and got[1:] == [None] * 3


def test_gray(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)], "r int, g int, b int")
    assert [r[0] for r in df.select(pictures.gray_of(F.col("r"), F.col("g"), F.col("b"))).collect()] == [255, 0, 76, 150, 29]


def test_bootstrap(spark):
    """The interval lies about the closed form, reruns and other layouts agree, and occurrences are as in drawing with replacement."""
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("kind"), (F.col("id") % 10 < 3).alias("f"))
    run = lambda df, seed=0: {r.kind: r for r in metrics.bootstrap(df, F.col("id"), ["kind"], F.col("f"), lambda p: 1 - F.pow(1 - p, 2), 120, seed).collect()}
    a, b = run(rows), run(rows.repartition(7))
    assert {k: (r.n, r.low, r.high) for k, r in a.items()} == {k: (r.n, r.low, r.high) for k, r in b.items()}
    for k, share in ((0, 0.4), (1, 0.2)):
        # The standard error of 1 - (1 - p)^2 is 2 (1 - p) times that of p.
        error = 2 * (1 - share) * math.sqrt(share * (1 - share) / 1500)
        r = a[k]
        assert r.n == 1500 and r.estimate == pytest.approx(1 - (1 - share) ** 2)
        assert abs(r.low - (r.estimate - 1.96 * error)) < 0.01 and abs(r.high - (r.estimate + 1.96 * error)) < 0.01
    assert run(rows, 1)[0].low != a[0].low
    w = np.array([r[0] for r in rows.select(metrics.occurrences(F.col("id"), 50, 3)).collect()])
    assert w.shape == (3000, 50) and abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - math.exp(-1)) < 0.005 and abs(w.var() - 1) < 0.02
