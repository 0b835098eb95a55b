"""What a larger table showed: ties of rounding, memory and rows that grew with the pairs."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lynceus.llm import language_id
from lynceus.operators import gallery, greedy, spots
from lynceus.sources import index


def test_means_between_two_thousandths_are_rounded_as_sql_rounds(spark, tmp_path):
    """Means of 37.5915 and 64.9425, whose binary neighbours go up and down."""
    values = {1: [6.3, 30.36, 62.35, 47.34, 7.28, 0.32, 28.48, 64.11, 30.59, 56.75, 16.52, 121.91, 21.72, 24.41, 42.83, 26.29, 94.84, 11.75, 41.42, 16.26], 2: [8.45, 10.18, 8.47, 146.5, 15.7, 112.94, 178.82, 38.48], 3: [1.0, 2.5]}
    rows = [(i, u, "view", x) for u, xs in values.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in entry.queries()["pack_unpack_top5"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == set(con.execute(entry.oracle_sql()["pack_unpack_top5"]).fetchall())
    assert {p for _, p, _, _ in got} == {"a:view:37.592", "a:view:64.942", "a:view:1.75"}


def test_means_are_added_in_the_order_of_events(spark, tmp_path):
    """Sums that depend on their order are those of the events' order, however the rows are dealt."""
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3), "view", float(x)) for i, x in enumerate(rng.choice([1e16, 1.0, -1e16, 3.25, 0.1], 300))]
    rows += [(300, 5, "view", None), (301, 6, "view", None), (302, 6, "view", 2.5)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    frame.repartition(7, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    rows_of = {r.user_id: tuple(r) for r in entry.queries()["pack_unpack_top5"](spark, str(tmp_path)).collect()}
    got = {u: r[1] for u, r in rows_of.items()}
    for u in range(3):
        total = 0.0
        for _, _, _, x in rows[u:300:3]:
            total += x
        assert float(got[u].rpartition(":")[2]) == round(total / 100 * 1000) / 1000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert [rows_of[u] for u in (5, 6)] == con.execute("FROM (" + entry.oracle_sql()["pack_unpack_top5"] + ") WHERE user_id IN (5, 6) ORDER BY user_id").fetchall()


@pytest.mark.parametrize("k", [1, 3, 6, 70])
def test_best_of_rows_is_a_whole_sort(k):
    """Ties, left-out cells and rows with fewer than k; what is put in order is little."""
    rng = np.random.default_rng(0)
    s, ids = np.round(rng.random((50, 300)), 2), rng.permutation(300)
    s[rng.random(s.shape) < 0.3] = s[3] = s[4, 2:] = -np.inf
    i, j = gallery.best_of_rows(s, k, ids)
    want = [(a, b) for a in range(50) for b in sorted(np.flatnonzero(np.isfinite(s[a])), key=lambda b: (-s[a, b], ids[b]))[:k]]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_a_reference_with_nan_hides_no_other(spark):
    rows = [(0, 1, 0, [1.0, 0.0]), (1, 1, 1, [float("nan"), 0.0]), (2, 1, 1, [0.9, 0.1]), (3, 2, 1, [0.0, 1.0])]
    g = spark.createDataFrame(rows, "id long, cls int, grp long, v array<double>")
    for keep in ("class", "overall"):
        assert {r.ref for r in gallery.score(g.filter("id = 0"), g, "sighting", keep, 1).collect()} == ({2, 3} if keep == "class" else {2})


def test_counts_of_photos_are_reduced_in_slabs(spark, monkeypatch):
    """However many photos a block has, a task holds the counts of so many pairs, and a sum leaves it as one row."""
    monkeypatch.setattr(spots, "COUNTS", 40)
    monkeypatch.setattr(spots, "CELLS", 64)
    rng = np.random.default_rng(2)
    rows = [(p, p % 3, k, rng.uniform(0, 9, 4).tolist()) for p in range(30) for k in range(1 + p % 5)]
    f = spots.photos_of(spark.createDataFrame(rows, "photo long, cls int, kp int, d array<double>"))

    def reduce(q, r, counts):
        if len(q["id"]) * len(r["id"]) > 40:
            raise AssertionError("a whole block at a time")
        return pa.table({"n": [q["id"].size]})

    assert sum(r.n for r in spots._grid(f, f, ("mut@0.8",), reduce, "n long").collect()) == 30
    whole = spots.evidence(f, f)
    want = whole.agg(*[F.sum(f"`{k}`").alias(k) for k in spots.KINDS]).first()
    assert spots.totals(f, f).collect() == [want] and want["q2r@0.9"] > 0
    best = {}
    for r in whole.select("q", "r", "cls", spots.score_of("mutg").alias("s")).collect():
        best[r.q, r.cls] = max(best.get((r.q, r.cls), (-1, 0)), (r.s, -r.r))
    assert {(r.q, r.cls): (r.score, -r.r) for r in spots.best_of_class(f, f, "mutg").collect()} == best


def test_look_alikes_are_linked_with_what_is_kept_only(spark, monkeypatch):
    """Many prints near one another and equal ones: the loop's result, and no table of all links."""
    monkeypatch.setattr(greedy, "FIRST", 40)
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(2**62), 2**62, (6, 4))
    rows = []
    for i in rng.permutation(400).tolist():
        h = [int(x) for x in seeds[i % 6]]
        for b in rng.integers(0, 63, rng.integers(0, 9)):
            h[int(b) % 4] ^= 1 << int(b)
        rows.append((i, h))
    rows.append((400, None))
    want, kept = {400: None}, []
    for i, h in sorted(rows[:-1]):
        want[i] = next((a for a, o in kept if sum((x ^ y).bit_count() for x, y in zip(h, o, strict=True)) <= 10), None)
        if want[i] is None:
            kept.append((i, h))
    asked, whole = [], greedy.links
    monkeypatch.setattr(greedy, "links", lambda p, d: asked.append(p.count()) or whole(p, d))
    got = {r.id: r.twin for r in greedy.first_kept(spark.createDataFrame(rows, "id long, h array<long>")).collect()}
    assert got == want and len(kept) > 6 and sum(asked) < 200


def test_own_class_scores_leave_no_row_a_pair(spark, monkeypatch):
    """The indexes without a sighting and the other encounters are reduced in the blocks, with SQL's results."""
    whole = gallery.score

    def score(queries, refs, exclude="sighting", keep="class", k=1, block=None):
        if keep == "over":
            raise AssertionError("a row a pair")
        return whole(queries, refs, exclude, keep, k, 64)

    monkeypatch.setattr(gallery, "score", score)
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    for name in ("restricted_index_accuracy", "supported_index_accuracy", "one_other_encounter", "one_other_encounter_by_era"):
        got = sorted(map(tuple, entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
        assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall()), name


def test_an_index_has_no_more_blocks_than_cores_need(spark, tmp_path):
    g = spark.range(2000).selectExpr("id", "cast(id % 3 as int) as cls", "id % 7 as grp", "array(cast(id as float), 1f) as v")
    cores = spark.sparkContext.defaultParallelism
    assert index.write_index(g, "many_blocks", 1, f"file://{tmp_path}/index") <= index.BUCKETS * cores
    got = {tuple(r) for r in index.search("many_blocks", g.filter("id < 9"), keep="overall", k=2).select("q", "ref").collect()}
    assert got == {tuple(r) for r in gallery.score(g.filter("id < 9"), g, keep="overall", k=2).select("q", "ref").collect()} and len(got) == 18


def test_the_margin_comes_from_all_labelled_texts(spark):
    """The quantile over every rightly named text outside the held-out fifth and the dictionaries, far more than 512 of a language."""
    words = {"de": ["wort", "satz", "und", "haus", "nicht", "wird"], "en": ["word", "phrase", "and", "house", "not", "will"]}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[x], rng.integers(2, 60))), x) for i in range(2400) for x in [("de", "en")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = language_id.learn(docs)
    enc, margins = language_id.Encoders(content), []
    learned = {r.doc_id for r in docs.filter(~language_id.held_out("doc_id")).collect()}
    for i, t, x in rows:
        name, _, margin = enc.judge(t)
        if i in learned and name == x and language_id.normalise(t)[: language_id.SAMPLE_BYTES] not in content[x]:
            margins.append(margin)
    assert len(margins) > 1200
    assert language_id.learn_margin(docs, content) == sorted(margins)[int(language_id.MARGIN_QUANTILE * len(margins))]


def test_rules_of_the_own_class_meet_no_other(spark, monkeypatch):
    """Support by sightings compares photos of one class only: no block has a reference of a class that none of its queries has, but for classes that are dealt alike."""
    met, whole = spark.sparkContext.accumulator(0), gallery.block_of

    def block_of(a, b, *rest):
        met.add(a.num_rows * b.num_rows)
        return whole(a, b, *rest)

    monkeypatch.setattr(gallery, "block_of", block_of)
    g = spark.range(400).selectExpr("id", "cast(id % 20 as int) as cls", "id % 7 as grp", "array(cast(id % 13 as float), 1f) as v")
    assert gallery.by_sighting(g, 0.9).count() == 400 * 6 and met.value < 400 * 400 / 4
