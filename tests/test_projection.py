"""Learned spaces against plain NumPy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import gallery as G
from lynceus.operators import projection as P

ROWS = "id long, cls int, grp long, v array<float>"


def gallery(n=180, dim=6, classes=4, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, dim)) * 1.5
    cls = rng.integers(0, classes, n)
    x = (centres[cls] + rng.normal(size=(n, dim)) * (0.3 + np.arange(dim))).astype(np.float32)
    return cls, rng.integers(0, 23, n), x


def frame(spark, cls, grp, x):
    return spark.createDataFrame([(i, int(c), int(g), [float(y) for y in v]) for i, (c, g, v) in enumerate(zip(cls, grp, x, strict=True))], ROWS)


def plain_pca(x, dim, whiten=False):
    mean = x.mean(0)
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    return lambda z: (z - mean) @ vt[:dim].T / (s[:dim] / np.sqrt(len(x) - 1) if whiten else 1.0)


def plain_shrunk(x):
    """Scaled to unit variance, Ledoit and Wolf's estimate by its definition, scaled back."""
    scale = x.std(0)
    scale[scale == 0] = 1.0
    z = (x - x.mean(0)) / scale
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / p / n**2, d2)
    return ((b2 / d2) * mu * np.eye(p) + (1 - b2 / d2) * s) * np.outer(scale, scale)


def plain_lda(x, cls, dim):
    first = plain_pca(x, dim)
    z = first(x)
    within = sum(plain_shrunk(z[cls == c]) * (cls == c).mean() for c in np.unique(cls))
    between = plain_shrunk(z) - within
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    w = vectors[:, np.argsort(-values.real)[: len(np.unique(cls)) - 1]].real
    w = w / np.sqrt(np.einsum("ij,ik,kj->j", w, within, w))
    return lambda y: first(y) @ w


def same_up_to_sign(a, b):
    return all(np.allclose(p, q, atol=1e-6) or np.allclose(p, -q, atol=1e-6) for p, q in zip(a.T, b.T, strict=True))


@pytest.mark.parametrize("whiten", [False, True])
def test_pca(spark, whiten):
    cls, grp, x = gallery()
    x64 = x.astype(float)
    assert same_up_to_sign(P.fit_pca(frame(spark, cls, grp, x), 4, whiten)(x64), plain_pca(x64, 4, whiten)(x64))


def test_lda(spark):
    cls, grp, x = gallery()
    x64 = x.astype(float)
    got, want = P.fit_lda(frame(spark, cls, grp, x).repartition(5), 5)(x64), plain_lda(x64, cls, 5)(x64)
    assert got.shape == want.shape == (len(x), 3) and same_up_to_sign(got, want)


def plain_folds(grp, k):
    """The largest group first, to the fold with the fewest rows."""
    names, n = np.unique(grp, return_counts=True)
    load, out = [0] * k, {}
    for i in sorted(range(len(names)), key=lambda i: (-n[i], -names[i])):
        f = min(range(k), key=lambda f: (load[f], f))
        load[f] += n[i]
        out[int(names[i])] = f
    return out


@pytest.mark.parametrize("seed", range(4))
def test_folds(spark, seed):
    rng = np.random.default_rng(seed)
    grp = rng.choice(60, 400, p=(w := rng.pareto(1.0, 60) + 0.05) / w.sum())
    df = spark.createDataFrame([(int(g),) for g in grp], "grp long")
    assert {r.grp: r.fold for r in P.folds(df, 5).collect()} == plain_folds(grp, 5)


def test_deal_sizes_of_many_groups():
    turns = P.deal_sizes([(10**6, 3), (1, 10**9), (7, 10)], 5)
    assert len(turns) < 40 and all(len(order) <= 5 for _, _, order in turns)


def test_out_of_fold(spark):
    cls, grp, x = gallery(90, 4, 3)
    got = P.out_of_fold(frame(spark, cls, grp, x), lambda rows: P.fit_lda(rows, 4), 3, lambda q, r: G.score(q, r, "sighting"))
    fold, x64 = plain_folds(grp, 3), x.astype(float)
    fold = np.array([fold[g] for g in grp])
    best = {}
    for f in range(3):
        z = plain_lda(x64[fold != f], cls[fold != f], 4)(x64)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        for i in np.flatnonzero(fold == f):
            for j in np.flatnonzero(grp != grp[i]):
                best[i, cls[j]] = max(best.get((i, cls[j]), -2), z[i] @ z[j])
    rows = {(r.q, r.cls): r.score for r in got.collect()}
    assert rows.keys() == best.keys() and all(rows[k] == pytest.approx(best[k], abs=1e-6) for k in best)


def test_multinomial_logistic_is_at_its_minimum(spark):
    cls, grp, x = gallery(150, 5, 3)
    df = frame(spark, cls, grp, x / 4)
    prob = {}
    for r in P.logistic_scores(df, df, c=0.5).collect():
        prob.setdefault(r.q, {})[r.cls] = r.score
    p = np.array([[prob[i][c] for c in range(3)] for i in range(len(x))])
    assert np.allclose(p.sum(1), 1)
    # Log-odds are linear in the vectors; their weights must be where the penalised likelihood has no slope.
    z = np.log(p) - np.log(p).mean(1, keepdims=True)
    one = np.hstack(((x / 4).astype(float), np.ones((len(x), 1))))
    w = np.linalg.lstsq(one, z, rcond=None)[0]
    assert np.allclose(one @ w, z, atol=1e-6)
    weight = len(x) / (3 * np.bincount(cls)[cls])
    slope = one.T @ ((p - np.eye(3)[cls]) * weight[:, None]) + np.vstack((w[:-1] / 0.5, np.zeros((1, 3))))
    assert np.abs(slope).max() < 0.02


def test_kmeans_takes_the_cheapest_of_ten(spark):
    cls, grp, x = gallery(120, 3, 5, seed=3)
    df = frame(spark, cls, grp, x)

    def cost(starts, seed):
        rows = {r.id: r.cluster for r in P.kmeans(df, 5, seed, starts).collect()}
        of = np.array([rows[i] for i in range(len(x))])
        return sum(((x[of == c] - x[of == c].mean(0)) ** 2).sum() for c in set(of))

    ten = cost(10, 0)
    assert all(ten <= cost(1, s) + 1e-3 for s in range(3))


def test_running_sums(spark):
    from lynceus.operators.prefix import running_before

    rng = np.random.default_rng(0)
    t = rng.permutation(500)
    df = spark.createDataFrame([(float(a), int(a) % 7, int(a) % 3) for a in t], "t double, k long, w long")
    for r in running_before(df, "t", ["k", "w"]).collect():
        assert (r.before_k, r.before_w) == (sum(a % 7 for a in range(int(r.t))), sum(a % 3 for a in range(int(r.t))))
    assert running_before(df.limit(0), "t", ["k"]).collect() == []


def test_projections_of_an_empty_fold(spark):
    cls, grp, x = gallery(20, 3, 2)
    df = frame(spark, cls, grp, x).withColumn("cls", F.lit(0))
    assert P.fit_lda(df, 3)(x.astype(float)).shape == (20, 1)


@pytest.mark.parametrize("balanced", [False, True])
def test_binary_logistic_is_at_its_minimum(spark, balanced):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -0.5] + rng.logistic(size=300) > 0.8).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    got = {r.term: r.weight for r in P.logistic(df, ["a", "b"], "y", c=0.7, balanced=balanced).collect()}
    w = np.array([got["a"], got["b"], got["constant"]])
    one = np.hstack((x, np.ones((300, 1))))
    weight = 300 / (2 * np.bincount(y)[y]) if balanced else np.ones(300)
    slope = one.T @ ((1 / (1 + np.exp(-one @ w)) - y) * weight) + np.array([w[0] / 0.7, w[1] / 0.7, 0])
    assert np.abs(slope).max() < 0.01
