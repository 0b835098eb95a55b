"""Known answers for operators, and every registered query against its SQL."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.functions import boxes, decisions, text, vectors
from lynceus.operators import gallery as G
from lynceus.operators import greedy, projection, spots
from lynceus.operators import manifest as O
from lynceus.operators import metrics as M
from lynceus.operators import session as S
from lynceus.operators import sightings
from lynceus.operators.components import connected

GALLERY = "id long, cls int, grp long, v array<float>"


def test_ties_go_to_the_smaller_class(spark):
    g = spark.createDataFrame([(1, 0, 1, [1.0, 0.0]), (2, 2, 2, [0.0, 1.0]), (3, 1, 3, [0.0, 1.0]), (4, 0, 4, [0.0, 2.0])], GALLERY)
    top = G.top_classes(G.score(g, g), 3).filter("q = 4").orderBy("rank").collect()
    assert [(r.cls, r.rank) for r in top] == [(1, 1), (2, 2), (0, 3)]


def test_no_other_sighting_is_no_query(spark):
    g = spark.createDataFrame([(1, 0, 1, [1.0, 0.0]), (2, 0, 1, [1.0, 0.1]), (3, 1, 2, [0.0, 1.0]), (4, 1, 3, [0.0, 1.0])], GALLERY)
    best = G.score(G.with_other_sighting(g), g)
    assert {r.q for r in best.select("q").collect()} == {3, 4} and {r.cls for r in best.collect()} == {0, 1}


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_change_nothing(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(3)), int(rng.integers(4)), [float(x) for x in rng.normal(size=5)]) for i in range(20)]
    g = spark.createDataFrame(rows, GALLERY)
    v = np.array([r[3] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[2] != b[2]:
                want[i, b[1]] = max(want.get((i, b[1]), -2), v[i] @ v[j])
    got = {(r.q, r.cls): r.score for r in G.score(g, g, block=block).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    near = G.score(g, g, "self", "overall", 2, block=block).groupBy("q").count().collect()
    assert all(r["count"] == 2 for r in near)


def test_auc_with_ties(spark):
    rows = [(1.0, True), (2.0, True), (2.0, True), (2.0, False), (0.0, False)]
    assert M.auc(spark.createDataFrame(rows, "score double, known boolean")).first()[0] == pytest.approx(4 / 6)


def test_calibrate_takes_the_first_best_and_the_highest_kept(spark):
    pairs = spark.createDataFrame([(0, 4.0, 1.0), (1, 3.0, 2.0), (2, 2.0, 3.0), (3, 1.0, 0.0), (4, None, 0.5)], "q long, s_known double, s_new double")
    r = M.calibrate(pairs).first()
    sk, sn = [4, 3, 2, 1], [1, 2, 3, 0, 0.5]
    best = max(sorted(set(sk + sn)), key=lambda t: (round(np.mean([x >= t for x in sk]) + np.mean([x < t for x in sn]), 9), -t))
    assert r.t == best
    assert M.calibrate(pairs, 0.75).first().t == 2.0


def test_bands_are_unrounded(spark):
    rows = spark.createDataFrame([(1.96, 1), (2.0, 1), (1.2, 1), (1.2, 2), (1.5, 2), (1.1999, 1)], "s double, n int")
    got = [r[0] for r in rows.select(decisions.band(F.col("s"), F.col("n"))).collect()]
    assert got == ["check", "match", "check", "possibly new", "check", "possibly new"]


def test_split_counts_are_half_even(spark):
    rows = spark.createDataFrame([("a",)] * 4 + [("b",)] * 10 + [("c",)] * 30, "cls string")
    got = {r.cls: (r.train, r.valid, r.test) for r in O.split_counts(rows, "cls").collect()}
    assert got == {"a": (2, 1, 1), "b": (6, 2, 2), "c": (22, 4, 4)}


def test_fuse_defaults(spark):
    spot = spark.createDataFrame([(1, 1, 3.0), (1, 2, -5.0)], "q long, cls int, score double")
    emb = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.25)], "q long, cls int, score double")
    got = {r.cls: r.score for r in G.fuse(spot, emb).collect()}
    assert got == {1: pytest.approx(math.log1p(3) + 0.5), 2: pytest.approx(-1.0), 3: pytest.approx(0.25)}


def test_mutual_matches_by_block_and_by_pair():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 3, 7, 12]
    photos = [rng.random((n, 4)) for n in sizes] + [np.eye(4), np.eye(4) + 0.01 * rng.random((4, 4))]
    most = max(map(len, photos))
    block = np.zeros((len(photos), most, 4))
    real = np.zeros((len(photos), most), bool)
    for i, p in enumerate(photos):
        block[i, : len(p)], real[i, : len(p)] = p, True
    for p in photos:
        if len(p):
            got = spots.block_evidence(p, block, real)
            for other, row in zip(photos, got, strict=True):
                want = spots.evidence_of(p, other) if len(other) else dict.fromkeys(spots.KINDS, 0)
                assert dict(zip(spots.KINDS, row.tolist(), strict=True)) == want
    a, b = spots.evidence_of(photos[-2], photos[-1]), spots.evidence_of(photos[-1], photos[-2])
    assert a["mut@0.8"] == b["mut@0.8"] == 4
    assert all(v == 0 for v in spots.evidence_of(photos[1], photos[5]).values() if v) or spots.evidence_of(photos[1], photos[5])["mut@0.9"] == 0


def test_evidence_and_scores(spark):
    rows = [(p, p % 2, k, [float((p * 7 + k * 3 + c * c) % 11) for c in range(4)]) for p in range(6) for k in range(1 if p == 5 else 4)]
    f = spots.photos_of(spark.createDataFrame(rows, "photo long, cls int, kp int, d array<double>"))
    e = spots.evidence(f, f)
    names = ["base", "base@0.8", "raw@0.6", "mut@0.8", "mutn@0.9", "mutg", "mut@0.67"]
    got = e.select("q", "r", *[spots.score_of(n).alias(f"s{i}") for i, n in enumerate(names)]).collect()
    assert len(got) == 30 and all(r.s3 >= 0 for r in got) and all(r.s5 == 0 for r in got if 5 in (r.q, r.r))


def nearest_features(queries, refs, k):
    """The k nearest features of other photos, relational form."""
    q = queries.select("photo", "kp", spots.root_descriptor(F.col("d")).alias("v"))
    r = refs.select(F.col("photo").alias("ref"), "cls", F.col("kp").alias("rkp"), spots.root_descriptor(F.col("d")).alias("w"))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    both = q.join(r, F.col("photo") != F.col("ref")).select("photo", "kp", "ref", "cls", "rkp", F.round(gap, 9).alias("d"))
    rank = F.row_number().over(Window.partitionBy("photo", "kp").orderBy("d", "ref", "rkp"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def test_lnbnn_relational(spark):
    rows = [(p, p % 2, k, [float(1 + (p * 5 + k * 3 + c) % 7) for c in range(3)]) for p in range(4) for k in range(2)]
    f = spark.createDataFrame(rows, "photo long, cls int, kp int, d array<double>")
    near = nearest_features(f, f, 4)
    votes = spots.lnbnn(near, 3).collect()
    assert votes and all(r.votes >= 0 for r in votes)
    assert spots.lnbnn(near, 3, "ref").count() >= len(votes)


def test_packed_lists(spark):
    row = spark.createDataFrame([("A:b:1.5;c:2",), ("",)], "p string").select(text.unpack_list(F.col("p")).alias("x")).collect()
    assert [(i.name, i.score) for i in row[0].x] == [("A:b", 1.5), ("c", 2.0)] and row[1].x == []


def test_text_functions(spark):
    r = spark.createDataFrame([("data/x/12.jpg", "a 2024-05-06 b", "IMG (2)", "2024:05:06 01:02:03", "back")], "p string, n string, s string, e string, v string")
    got = r.select(text.photo_id(F.col("p")), text.first_date(F.col("n")).cast("string"), text.is_copy_name(F.col("s")), text.exif_time(F.col("e")), text.view_name(F.col("v"))).first()
    assert tuple(got) == (12, "2024-05-06", True, "2024-05-06 01:02:03", "rear")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = df.select(vectors.unit(vectors.doubles("v")).alias("u"), vectors.unpack_floats(vectors.pack_floats(F.col("v"))).alias("w"), vectors.root_descriptor(F.col("v")).alias("r")).collect()
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[1].u == [0.0, 0.0] and got[0].w == [3.0, 4.0]
    assert got[0].r == pytest.approx([math.sqrt(3 / 7), math.sqrt(4 / 7)], abs=1e-6)


def test_boxes(spark):
    df = spark.range(1).select(boxes.valid_box(F.lit(-5), F.lit(0), F.lit(1200), F.lit(500)).alias("a"), boxes.valid_box(F.lit(5), F.lit(5), F.lit(5), F.lit(9)).alias("b"))
    r = df.select("a", "b", boxes.iou(F.col("a"), F.col("a")).alias("i"), boxes.crop(F.col("a"), F.lit(100), F.lit(100), boxes.TIGHT).alias("c")).first()
    assert tuple(r.a) == (0, 0, 1000, 500) and r.b is None and r.i == 1.0
    assert (r.c.x1 - r.c.x0) * (r.c.y1 - r.c.y0) == pytest.approx(2500, rel=0.05)


def test_sighting_chain(spark):
    schema = "id long, cls string, encounter_id long, encounter_date string, file_date string, filename string, digest string"
    rows = [
        (1, "a", 1, "d1", None, None, "h1"), (2, "a", 1, "d1", None, "f", "h2"), (3, "a", 2, "d2", None, "f", "h3"), (4, "b", 3, "d9", None, None, "h3"),
        (5, "c", None, None, "x", None, "h5"), (6, "c", 7, None, "x", None, "h6"), (7, "d", None, None, None, None, "h7"), (8, "e", None, None, None, None, "h8"),
    ]
    twice = spark.createDataFrame([(8, 4), (100, 1)], "a long, b long")
    got = {r.id: r.grp for r in sightings.sighting_groups(spark.createDataFrame(rows, schema), twice).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 1, 5: 5, 6: 5, 7: 7}


def test_greedy_keeps_c(spark):
    prints = spark.createDataFrame([(1, [0]), (2, [(1 << 10) - 1]), (3, [(1 << 20) - 1]), (4, [0])], "id long, h array<long>")
    got = {r.id: r.twin for r in greedy.first_kept(prints).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 1}


def test_greedy_against_a_loop(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 8)]
    rows = []
    for i in range(150):
        h = [base[i % 8], base[(i * 3) % 8]]
        for b in rng.integers(0, 63, int(rng.integers(0, 9))):
            h[int(b) % 2] ^= 1 << int(b)
        rows.append((i, h))
    kept, want = [], {}
    for i, h in rows:
        hit = next((k for k, g in kept if sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(h, g, strict=True)) <= 10), None)
        want[i] = hit
        if hit is None:
            kept.append((i, h))
    assert {r.id: r.twin for r in greedy.first_kept(spark.createDataFrame(rows, "id long, h array<long>")).collect()} == want


def test_upsert_nulls_what_is_stale(spark):
    old = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [2.0])], "id long, sha string, v array<double>")
    new = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "id long, sha string")
    got = {r.id: (r.sha, r.v) for r in O.upsert(old, new, "id", "sha", ("v",)).collect()}
    assert got == {1: ("x", [1.0]), 2: ("z", None), 3: ("w", None)}


def test_last_feedback_on_a_set_wins(spark):
    log = spark.createDataFrame([("m1", "known", 1), ("S1", "new", 2)], "id string, verdict string, seq int")
    members = spark.createDataFrame([("S1", "m1"), ("S1", "m2")], "id string, member string")
    out = S.last_wins(S.fan_out(log, members, "id", "member"), ["target"], "seq", ["verdict"])
    assert {r.target: r.verdict for r in out.collect()} == {"m1": "new", "S1": "new", "m2": "new"}


def test_connected_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    got = connected(e, spark.range(45).withColumnRenamed("id", "node")).collect()
    assert all(r.component == (0 if r.node <= 40 else r.node) for r in got)


def test_projections(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, i % 5, [float(x) for x in rng.normal(size=6) + 3 * np.eye(6)[i % 3]]) for i in range(90)]
    g = spark.createDataFrame(rows, GALLERY)
    x = np.array([r[3] for r in rows], np.float32).astype(float)
    f = projection.fit_pca(g, 3)
    values, vectors_ = np.linalg.eigh(np.cov(x.T))
    assert np.abs(np.abs(f(x)) - np.abs((x - x.mean(0)) @ vectors_[:, ::-1][:, :3])).max() < 1e-6
    white = projection.fit_pca(g, 3, True)(x)
    assert np.allclose(white.var(0, ddof=1), 1)
    z = projection.fit_lda(g, 6)(x)
    assert z.shape[1] == 2 and min(np.linalg.norm(z[np.arange(90) % 3 == a].mean(0) - z[np.arange(90) % 3 == b].mean(0)) for a in range(3) for b in range(a)) > 1.5
    fold = {r.grp: r.fold for r in projection.folds(g, 5).collect()}
    assert sorted(fold.values()) == [0, 1, 2, 3, 4]


def test_streamed_log(spark, tmp_path):
    from lynceus.streaming import keyed
    from lynceus.streaming import log as L

    rows = [(i, f"u{i % 3}", "known" if i % 4 else "new") for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, upload string, verdict string")
    folder = str(tmp_path / "log")
    for lo in (6, 0, 9):  # arrival out of order
        df.filter(f"seq >= {lo} and seq < {lo + 3} or {lo} = 0 and seq >= 3 and seq < 6").coalesce(1).write.mode("append").parquet(folder)
    L.keep_last(L.read_log(spark, folder, df.schema), str(tmp_path / "cp"), ["upload"], "seq", ["verdict"]).awaitTermination()
    got = {r.upload: (r.verdict, r.seq) for r in keyed.kept(spark, str(tmp_path / "cp")).collect()}
    assert got == {"u0": ("known", 9), "u1": ("known", 10), "u2": ("known", 11)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    counts = L.run_to_end(L.count_windows(L.read_log(spark, str(tmp_path / "ev"), events.schema)))
    assert counts.agg(F.sum("n")).first()[0] == events.count()
    assert L.run_to_end(L.drop_seen(L.read_log(spark, str(tmp_path / "ev"), events.schema), "user_id"), "append").count() == events.select("user_id").distinct().count()


def test_every_query_with_sql(spark):
    import duckdb

    from lynceus.plans import registry

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    queries, sql = registry.queries(), registry.oracle_sql()
    show = lambda v: "\0" if v is None else repr(round(v, 5)) if isinstance(v, float) else repr(v)
    bad = []
    for name in sql:
        got = queries[name](spark, folder)
        names = sorted(got.columns)
        want = c.sql(sql[name])
        assert sorted(want.columns) == names, name
        a = sorted(tuple(map(show, r)) for r in got.select(*names).collect())
        b = sorted(tuple(map(show, r)) for r in want.project(", ".join(f'"{n}"' for n in names)).fetchall())
        if a != b:
            bad.append(name)
    assert not bad
