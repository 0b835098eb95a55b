"""Geometry, picture hashes, score names, table swaps, decisions and kept streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.functions import pictures
from lynceus.operators import geometry, greedy, spots
from lynceus.operators import manifest as O
from lynceus.sources import tables


def moved(model, n, outliers, seed):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 1, (n, 2))
    if model == "similarity":
        t = 0.7
        b = 0.9 * a @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + [0.3, -0.1]
    elif model == "affine":
        b = a @ np.array([[1.1, 0.2], [-0.3, 0.8]]) + [0.1, 0.2]
    else:
        h = np.array([[1.1, 0.1, 0.05], [-0.05, 0.95, 0.1], [0.1, -0.15, 1.0]])
        p = np.column_stack((a, np.ones(n))) @ h.T
        b = p[:, :2] / p[:, 2:]
    b[:outliers] += rng.choice([-1, 1], (outliers, 2)) * rng.uniform(0.8, 3, (outliers, 2))
    return a, b


@pytest.mark.parametrize("model", ["similarity", "affine", "homography"])
@pytest.mark.parametrize("outliers", [0, 6, 20])
def test_inliers(model, outliers):
    a, b = moved(model, 40, outliers, outliers)
    assert geometry.inliers(model, a, b) == 40 - outliers
    assert geometry.inliers(model, a[:4], b[:4]) == 0


def test_epipolar_inliers():
    rng = np.random.default_rng(2)
    x = np.column_stack((rng.uniform(-1, 1, (40, 2)), rng.uniform(3, 6, 40)))
    turn = np.array([[np.cos(0.2), 0, np.sin(0.2)], [0, 1, 0], [-np.sin(0.2), 0, np.cos(0.2)]])
    y = x @ turn.T + [0.8, 0.1, 0.0]
    a, b = x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:]
    assert geometry.inliers("epipolar", a, b) == 40
    b[:12, 1] += rng.uniform(1, 2, 12)
    assert 28 <= geometry.inliers("epipolar", a, b, draws=2000) <= 31


def test_verify_and_scores_by_name(spark):
    a, b = moved("similarity", 20, 5, 1)
    rows = [(1, 2, *map(float, (*p, *q))) for p, q in zip(a, b, strict=True)] + [(1, 3, 0.1, 0.2, 0.3, 0.4)]
    found = geometry.verify(spark.createDataFrame(rows, "q long, r long, ax double, ay double, bx double, by double"))
    assert {(x.q, x.r): (x.matches, x.inliers) for x in found.collect()} == {(1, 2): (20, 15), (1, 3): (1, 0)}
    kinds = ", ".join(f"0 as `{k}`" for k in spots.KINDS)
    e = spark.sql(f"select 1L as q, r, 7 as cls, 20 as nq, 30 as nr, {kinds} from values (2L), (3L), (4L) as t(r)")
    e = e.join(found.select("q", "r", F.col("inliers").alias("rs_sim")), ["q", "r"], "left").withColumns({"lnbnn_cls": F.lit(0.25), "pre:own": F.col("r") * 2})
    got = {x.r: (x.a, x.b, x.c, x.d) for x in e.select("r", *[spots.score_of(k).alias(n) for n, k in zip("abcd", ("rs_sim", "rs_sim_n", "lnbnn_cls", "pre:own"), strict=True)]).collect()}
    assert got == {2: (15.0, 75.0, 0.25, 4.0), 3: (0.0, 0.0, 0.25, 6.0), 4: (0.0, 0.0, 0.25, 8.0)}


def test_best_of_class_is_what_all_pairs_say(spark):
    rng = np.random.default_rng(0)
    rows = [(p, p % 3, k, [float(x) for x in rng.integers(0, 9, 4)]) for p in range(30) for k in range(p % 5)]
    f = spots.photos_of(spark.createDataFrame(rows, "photo long, cls int, kp int, d array<double>"))
    e = spots.evidence(f, f)
    for kind in ("base", "base@0.8", "raw@0.6", "mut@0.8", "mutn@0.9", "mutg"):
        top = F.max(F.struct(spots.score_of(kind).alias("score"), (-F.col("r")).alias("r"))).alias("x")
        want = {(x.q, x.cls): (round(x.x.score, 9), -x.x.r) for x in e.groupBy("q", "cls").agg(top).collect()}
        assert {(x.q, x.cls): (round(x.score, 9), x.r) for x in spots.best_of_class(f, f, kind).collect()} == want


def test_difference_hash(spark):
    rng = np.random.default_rng(0)
    grays = [rng.integers(0, 256, (16, 17)) for _ in range(5)]
    grays.append(np.minimum(255, grays[0] + 1))
    df = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in enumerate(grays)] + [(9, [1, 2])], "id long, p array<int>")
    got = {r.id: r for r in df.select("id", pictures.difference_bits(F.col("p")).alias("b"), pictures.pack_bits(pictures.difference_bits(F.col("p"))).alias("h")).collect()}
    for i, g in enumerate(grays):
        bits = (g[:, 1:] > g[:, :-1]).astype(int).ravel()
        assert got[i].b == bits.tolist()
        assert [x & (1 << 64) - 1 for x in got[i].h] == [sum(int(b) << k for k, b in enumerate(bits[w * 64 : w * 64 + 64])) for w in range(4)]
    assert got[9].b is None and got[9].h is None
    prints = df.filter("id < 9").select("id", pictures.pack_bits(pictures.difference_bits(F.col("p"))).alias("h"))
    assert {r.id: r.twin for r in greedy.first_kept(prints).collect()}[5] in (0, None)


def test_swap_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a")], "id long, v string")
    tables.overwrite(old, path)
    failing = spark.range(3).select(F.col("id"), F.when(F.col("id") < 5, F.raise_error(F.lit("broken off"))).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken off|TASK_WRITE_FAILED"):
        tables.overwrite(failing, path)
    assert spark.read.parquet(path).collect() == old.collect()
    # A crash between the two renames: the old rows lie aside and come back.
    (tmp_path / "t").rename(tmp_path / "t.old")
    tables.upsert_table(spark.createDataFrame([(2, "b")], "id long, v string"), path, "id", "v")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.next").exists()
    # A rename that fails puts the old table back.
    with pytest.raises(OSError):
        tables._swap(spark, str(tmp_path / "nothing"), path)
    assert spark.read.parquet(path).count() == 2


def test_check_keys(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "a long, b long")
    assert tables.check_keys(df, "a").count() == 2
    with pytest.raises(Exception, match="b is null"):
        tables.check_keys(df, "b").collect()
    with pytest.raises(ValueError, match="more than once"):
        tables.check_keys(df.unionAll(df), "a")


def test_splits_by_bucket(spark, monkeypatch):
    rows = spark.range(700).select("id", (F.col("id") % 3).alias("cls"))
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    want = {r.id: r.split for r in O.assign_splits(rows, "cls", digest, F.col("id")).collect()}
    monkeypatch.setattr(O, "BUCKET", 10)
    assert {r.id: r.split for r in O.assign_splits(rows, "cls", digest, F.col("id")).collect()} == want
    assert sorted({s: list(want.values()).count(s) for s in set(want.values())}.items()) == [("test", 105), ("train", 490), ("valid", 105)]
