"""Centroid clustering against a plain version in Python's integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from lynceus.llm import centroids as C

DIM = 4
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    m = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(m)) for _, x in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(m)):
            mine = [x for (_, x), (_, c) in zip(kept, own, strict=True) if c == j]
            if mine:
                m[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    inertia = {j: sum(d for d, c in own if c == j) for j in range(len(m))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in m]
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, own, strict=True))


def got(df, k, rounds, dim, **more):
    out = C.cluster(df.select("vec_id", "embedding"), k=k, rounds=rounds, dim=dim, **more)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


@pytest.mark.parametrize("k", [1, 3, 8])
def test_like_the_plain_version(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=DIM) + 3 * (i % 5)).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, rows[i][1], 0) for i in range(40)] + [(7, rows[3][1], 0), (7, rows[4][1], 0), (None, rows[5][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scans = []
    assert got(df, k, 6, DIM, scans=scans) == plain([r[:2] for r in rows], k, 6, DIM)
    assert scans[0] == len(rows) and (k == 1 or sum(scans[1:]) < len(rows) * 6)  # the bounds save scans


def test_bounds_leave_most_vectors_alone(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=DIM) / 10 + 5 * np.eye(DIM)[i % DIM]).tolist(), 0) for i in range(400)]
    scans = []
    assert got(spark.createDataFrame(rows, SCHEMA), 4, 5, DIM, scans=scans) == plain([r[:2] for r in rows], 4, 5, DIM)
    assert scans[0] == 400 and max(scans[3:]) < 10  # near the end only few vectors are looked at


def test_ties_go_to_the_smaller_number(spark):
    """Points on a grid with centroids at equal distances, and centroids that are equal."""
    rows = [(i, [float(i % 3), float(i % 2), 0.0, 0.0], 0) for i in range(60)]
    assert got(spark.createDataFrame(rows, SCHEMA), 5, 4, DIM) == plain([r[:2] for r in rows], 5, 4, DIM)
    same = [(i, [0.5] * DIM, 0) for i in range(20)]
    out = got(spark.createDataFrame(same, SCHEMA), 3, 2, DIM)
    assert out == plain([r[:2] for r in same], 3, 2, DIM) and {r[1] for r in out} == {0}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [], 0), (3, [1.0] * 3, 0), (4, [1.0, nan, 0.0, 0.0], 0), (5, [inf, 0.0, 0.0, 0.0], 0), (6, [None, 0.0, 0.0, 0.0], 0), (9, [1e30, 0.0, 0.0, 0.0], 0)]
    rows = [*odd, (7, [-0.0001, 0.0, 0.0, 2.0], None), (8, [0.0] * DIM, 1)]
    assert [r[0] for r in got(spark.createDataFrame(rows, SCHEMA), 8, 3, DIM)] == [7, 8]
    assert got(spark.createDataFrame([r for r in rows if r[0] != 9], SCHEMA), 8, 3, DIM) == plain([r[:2] for r in rows if r[0] != 9], 8, 3, DIM)
    assert got(spark.createDataFrame(odd, SCHEMA), 8, 3, DIM) == [] == got(spark.createDataFrame([], SCHEMA), 8, 3, DIM)


def test_large_components_are_exact(spark):
    """Distances near 2 ** 62, which doubles don't hold, decide."""
    rows = [(i, [131071.0 * (-1) ** i, float(i) / 1024, 131071.0, 0.0], 0) for i in range(30)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 4, 3, DIM) == plain([r[:2] for r in rows], 4, 3, DIM)


def test_other_columns_come_back(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0, 0.0, 0.0], i, "x", 1) for i in range(9)], "vec_id long, embedding array<float>, Cluster long, word string, distance int")
    out = C.cluster(df, k=2, rounds=2, dim=DIM)
    assert out.columns == ["vec_id", "word", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.filter("word = 'x'").count() == 9 and {r.cluster for r in out.collect()} == {0, 1}


def test_query_and_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    mine = sorted(tuple(r) for r in C.op11(spark.read.parquet(path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert mine == sorted(con.execute(C.OP11_SQL).fetchall())
    assert mine == plain([(r.vec_id, r.embedding) for r in spark.read.parquet(path).collect()], 8, 10, 64)
