"""Queries that compare all pairs do it once, and what they keep of the pairs is made in the blocks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lynceus.operators import alignment, gallery, metrics, projection
from lynceus.plans import reid, session
from lynceus.streaming import keyed

SMALL = "/root/testdata/sf0.001"


def sql(name, **tables):
    con = duckdb.connect()
    for t, path in ({"embeddings": f"{SMALL}/embeddings.parquet"} | tables).items():
        con.execute(f"CREATE VIEW {t} AS FROM '{path}'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_all_years_come_from_one_grid(spark, monkeypatch):
    whole, asked = gallery.grid, []
    monkeypatch.setattr(gallery, "grid", lambda *a: asked.append(1) or whole(*a[:5], 64))
    assert sorted(map(tuple, entry.queries()["years_apart"](spark, SMALL).collect())) == sql("years_apart")
    assert len(asked) == 1


def test_pictures_are_compared_where_pairs_are_found(spark):
    """Blocks and pairs say the same of pictures of several sizes, by a motion that isn't none; unsound ones have no difference."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        h, w = [(8, 8), (6, 9)][i % 2]
        gray = None if i == 7 else rng.integers(0, 256, h * w - (i == 9)).tolist()
        rows.append((i, i % 3, i % 7, rng.standard_normal(4).tolist(), w, h, gray))
    g = spark.createDataFrame(rows, "id long, cls int, grp long, v array<double>, width int, height int, gray array<int>")
    matrix = np.array([[0.9, -0.1, 0.1], [0.1, 0.9, 0.0], [0, 0, 1.0]])
    pairs = gallery.score(g, g, "not_before", "over", 0.2).select(F.col("q").alias("a"), F.col("ref").alias("b"), F.array(*[F.lit(float(x)) for x in matrix.ravel()]).alias("matrix"))
    want = {tuple(r) for r in alignment.compared(pairs, g).collect()}
    got = {(a, b, d, o) for a, b, d, o in map(tuple, alignment.alike(g, 0.2, matrix, 16).collect())}
    near = lambda rows: {(a, b): (d, o) for a, b, d, o in rows}
    assert near(got).keys() == near(want).keys() and len(want) > 100
    for k, (d, o) in near(want).items():
        assert near(got)[k] == (d if d is None else pytest.approx(d, rel=1e-12), pytest.approx(o, rel=1e-12)), k
    assert {None} < {d for d, _ in near(want).values()}


def test_a_fit_doesnt_score_the_gallery_again(spark, monkeypatch):
    whole, plans = projection.logistic, []
    monkeypatch.setattr(projection, "logistic", lambda rows, *a, **k: plans.append(rows._jdf.queryExecution().toString()) or whole(rows, *a, **k))
    assert entry.queries()["logit_likelihood"](spark, SMALL).count() == 2
    assert len(plans) == 1 and "CoGroups" not in plans[0]


def test_no_row_is_multiplied_by_the_replicates(spark):
    """The sums of every replicate are those of :func:`metrics.occurrences`, from a row a batch and group; null keys, flags and groups too."""
    rows = spark.createDataFrame([(None if i == 5 else i, None if i % 7 == 3 else i % 3, None if i % 4 == 1 or i % 3 == 2 else i % 5 < 2) for i in range(400)], "id long, kind long, f boolean")
    got = metrics.bootstrap(rows, F.col("id"), ["kind"], F.col("f"), lambda p: p, 30, 9)
    plan = got._jdf.queryExecution().toString()
    drawn = rows.select("kind", F.col("f").cast("int").alias("f"), F.posexplode(metrics.occurrences(F.col("id"), 30, 9)).alias("r", "w"))
    p = drawn.groupBy("kind", "r").agg((F.sum(F.col("w") * F.col("f")) / F.nullif(F.sum("w"), F.lit(0))).alias("p")).filter("p is not null")
    want = {r.kind: (r.low, r.high) for r in p.groupBy("kind").agg(F.percentile("p", 0.025).alias("low"), F.percentile("p", 0.975).alias("high")).collect()}
    both = {r.kind: (r.low, r.high) for r in got.collect()}
    assert set(want) == {None, 0, 1} and both.keys() == {None, 0, 1, 2}
    assert {k: both[k] for k in (0, 1)} == {k: pytest.approx(want[k], rel=1e-12) for k in (0, 1)} and both[2] == (None, None)
    assert "MapInArrow" in plan and "posexplode(flatten" not in plan


def test_the_summary_of_a_stream_asks_no_python_for_a_key(spark, monkeypatch):
    """Several files a micro-batch too."""
    monkeypatch.setattr(session, "FILE_ROWS", 200, raising=False)
    monkeypatch.setattr(keyed.Keep, "handleInputRows", None)
    got = entry.queries()["stream_log_summary"](spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sql("stream_log_summary", events=f"{SMALL}/events.parquet")


def test_methods_share_their_scores(spark):
    assert "CoGroups" not in entry.queries()["method_decisions"](spark, SMALL)._jdf.queryExecution().toString()


def test_a_recheck_compares_the_pick_alone(spark, monkeypatch):
    """Picks come from a row a query and block, their second score from references of the pick's class."""
    whole, asked = gallery.score, []
    monkeypatch.setattr(gallery, "score", lambda q, r, exclude, keep, k: asked.append((exclude, keep)) or whole(q, r, exclude, keep, k, 64))
    assert sorted(map(tuple, entry.queries()["spot_recheck"](spark, SMALL).collect())) == sql("spot_recheck")
    assert asked == [("sighting", "pick"), ("sighting_or_other_class", "class")]


@pytest.mark.parametrize("keep", ["class", "pick"])
@pytest.mark.parametrize("exclude", gallery.BY_GROUP)
@pytest.mark.parametrize("alike", [False, True])
def test_screened_products_say_what_whole_ones_do(keep, exclude, alike, monkeypatch):
    """Copies, references a hair apart, zero and unsound vectors, crowds of one vector, short runs."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    schema = pa.schema([("q", pa.int64()), ("cls", pa.int32()), ("ref", pa.int64()), ("score", pa.float64())])
    monkeypatch.setattr(gallery, "CELLS", 1 << 16)

    def rows(n, first, groups):
        v = np.round(rng.standard_normal((n, 8)), 0 if alike else 3)
        v[7], v[8, 2], v[9, 3] = 0, np.nan, np.inf
        v[20:40] = v[10]
        v[40:60] = v[11] + 1e-9 * rng.standard_normal((20, 8))
        if alike:
            v[60:] = v[60]
        return pa.table({"id": rng.permutation(n) + first, "cls": rng.integers(0, 3, n).astype(np.int32), "grp": rng.integers(0, groups, n), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})

    for groups in (4, 300):
        a, b = rows(300, 0, groups), rows(700, 200, groups)
        rule, order = gallery.EXCLUSIONS[exclude], [("q", "ascending"), ("cls", "ascending")]
        want = gallery.block_of(a, b, rule, lambda s, q, r: gallery.REDUCTIONS[keep](s, q, r, 1), schema).sort_by(order)
        got = gallery.best_of_block(a, b, rule, keep, schema).sort_by(order)
        assert got["q"] == want["q"] and np.allclose(got["score"], want["score"], rtol=0, atol=1e-14) and len(want) > 250
        by = {(x["id"], x["cls"]) for x in b.select(["id", "cls"]).to_pylist()}
        assert {(x["ref"], x["cls"]) for x in got.to_pylist()} <= by
        if keep == "class":
            assert got["cls"] == want["cls"]


def test_models_share_one_list_of_the_nearest(spark, monkeypatch):
    """One comparison for 1, 3 and 5 nearest says what three do."""
    whole, asked = gallery.score, []
    monkeypatch.setattr(gallery, "score", lambda *a: asked.append(a[3:]) or whole(*a))
    got = {r.model: (r.valid, r.test) for r in entry.queries()["model_comparison"](spark, SMALL).collect()}
    assert sorted(asked) == [("class", 1), ("overall", 5)] and len(got) == 5
    g = reid.load(spark, SMALL)
    train, ask = g.filter("grp > 1"), g.filter("grp <= 1")
    for k in (1, 3):
        flags = metrics.hits(gallery.top_classes(gallery.knn_votes(whole(ask, train, "none", "overall", k))), reid.truth(ask))
        hit = {r.part: r.top1 for r in metrics.accuracy(flags.withColumn("part", F.col("q") % 7), "part").collect()}
        assert got[f"nearest {k}"] == (pytest.approx(hit[0], abs=1e-6), pytest.approx(hit[1], abs=1e-6))
