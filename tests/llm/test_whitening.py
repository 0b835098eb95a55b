"""Whitening against a plain version: exact sums in Python's integers, the covariance in one product."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lynceus.llm import whitening as W
from lynceus.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=16):
    """``id -> (deviation, whitened)``, n, explained; the signs are free."""
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in rows.items()}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = np.array([[float(Fraction(c * n - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    keep = [i for i in np.argsort(-values) if values[i] > 1e-12 * values.max()][:components]
    out = {k: (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), (np.array([float(Fraction(c * n - s, n)) for c, s in zip(v, sums, strict=True)]) @ vectors[:, keep]) / np.sqrt(values[keep])) for k, v in x.items()}
    return out, n, values[keep] / values.sum()


def check(got, rows, components=16):
    want, n, explained = plain(rows, components)
    k = len(explained)
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert table.keys() == rows.keys() and all(sorted(t) == list(range(1, k + 1)) for t in table.values())
    whitened = np.array([[table[i][c].whitened for c in range(1, k + 1)] for i in rows])
    expected = np.array([want[i][1] for i in rows])
    sign = np.sign((whitened * expected).sum(0))
    assert np.abs(whitened * sign - expected).max() < 1e-6
    assert {r.n for r in got} == {n} and all(r.deviation == want[r.vec_id][0] for r in got)
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 for r in got)
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-8


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(5)
    check(W.op13(df).collect(), {r.vec_id: r.embedding for r in df.collect()})


@pytest.mark.parametrize("tile, block, fan", [(3, 20, 2), (7, 70, 3), (64, 1 << 22, 64)])
def test_tiles_make_the_covariance(spark, tile, block, fan):
    """Tiles that don't divide the dimensions, one or many row-blocks, trees of several levels."""
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (60, 10)) + 1_000_000
    fit = spark.createDataFrame([(r.tolist(),) for r in x], f"`{W._X}` array<long>").repartition(4)
    n, sums = W.exact_sums(fit, 10)
    assert n == 60 and sums == x.sum(0).tolist()
    v = W.covariance(Scratch(spark, "test"), fit, 10, n, sums, tile, block, fan)
    assert np.allclose(v, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)


def test_copies_count_once_and_odd_rows_go(spark):
    rng = np.random.default_rng(2)
    good = {i: rng.normal(size=5).astype(np.float32).tolist() for i in range(40)}
    good |= {100 + i: good[3] for i in range(500)}
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 0), (901, [nan] * 5, 0), (902, [inf, 0.0, 0.0, 0.0, 0.0], 0), (903, [None, 1.0, 0.0, 0.0, 0.0], 0), (904, [], 1), (905, [1e30] * 5, 1)]
    df = spark.createDataFrame([(k, v, 0) for k, v in good.items()] + odd, SCHEMA).repartition(3)
    check(W.op13(df).collect(), good)


def test_fewer_components_than_asked_for(spark):
    """Vectors on a line have one; a single distinct vector and an empty table have none; repeated ids are rows each."""
    line = {i: [float(i), 2.0 * i, 0.0] for i in range(9)}
    check(W.op13(spark.createDataFrame([(k, v, 0) for k, v in line.items()], SCHEMA)).collect(), line)
    assert W.op13(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 5, SCHEMA)).collect() == []
    assert W.op13(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.op13(spark.createDataFrame([(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, [0.0, 0.0], 0)], SCHEMA)).count() == 3


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(3)
    short, long = ({o + i: rng.normal(size=d).astype(np.float32).tolist() for i in range(30)} for o, d in ((0, 3), (100, 4)))
    got = W.op13(spark.createDataFrame([(k, v, 0) for k, v in (short | long).items()], SCHEMA)).collect()
    check([r for r in got if r.vec_id < 100], short)
    check([r for r in got if r.vec_id >= 100], long)


def test_large_entries_are_exact_or_null(spark):
    """Deviations beyond a long are null, sums of large integers are exact."""
    big = {i: [float(i % 7) * 2.0**40, float(i)] for i in range(50)}
    out = W.whiten(spark.createDataFrame([(k, v) for k, v in big.items()], "vec_id long, embedding array<double>")).collect()
    want, n, _ = plain(big)
    assert {r.n for r in out} == {n} and all(r.deviation == (d if (d := want[r.vec_id][0]) < 1 << 63 else None) for r in out)


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], "w", 5) for i in range(6)], "vec_id long, embedding array<float>, word string, Component int")
    out = W.whiten(df)
    assert out.columns == ["vec_id", "word", *W.OUTPUTS] and out.filter("word = 'w'").count() == 12
