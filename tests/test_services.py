"""A bucketed index, a paged service, a batch client and a plan of moves."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import batch
from lynceus.operators import gallery as G
from lynceus.sources import index, paged


def gallery(spark, n=60):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(5)), int(rng.integers(4)), [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, cls int, grp long, v array<float>")


def show(df):
    return sorted((r.q, r.cls, r.ref, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("keep, k", [("class", 1), ("class", 2), ("overall", 3), ("over", 0.3)])
def test_index_is_the_gallery(spark, tmp_path, monkeypatch, keep, k):
    g, name = gallery(spark), f"t_{uuid.uuid4().hex}"
    assert index.write_index(g, name, 16, f"file://{tmp_path}/index") == 4 == index.blocks_of(spark, name)
    q = g.filter("id % 2 = 0")
    assert show(index.search(name, q, "sighting", keep, k)) == show(G.score(q, g, "sighting", keep, k))
    some = g.filter("id % 3 = 0").select("id")
    assert show(index.search(name, q, "self", keep, k, without=some)) == show(G.score(q, g.filter("id % 3 <> 0"), "self", keep, k))
    assert show(index.search(name, q, "self", keep, k, only=some)) == show(G.score(q, g.filter("id % 3 = 0"), "self", keep, k))
    monkeypatch.setattr(index, "QUERIES", 7)
    assert show(index.search(name, q, "sighting", keep, k)) == show(G.score(q, g, "sighting", keep, k))


def test_index_isnt_moved(spark, tmp_path):
    """The plan has no exchange between the index's scan and the join of blocks."""
    g, name = gallery(spark), f"t_{uuid.uuid4().hex}"
    index.write_index(g, name, 16, f"file://{tmp_path}/index")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.search(name, g, keep="over", k=0.2, without=g.select("id").limit(1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    right = plan[plan.index("\n+- ") :]  # the second child of the join of blocks
    assert plan.startswith("FlatMapCoGroupsInArrow") and "Bucketed: true" in right and name in right and "Exchange" not in right, plan


def service(folder):
    def fetch(number):
        import os

        path = f"{folder}/{number}.json"
        return open(path).read() if os.path.exists(path) else None

    return fetch


def answers(folder, numbers):
    for n in numbers:
        (folder / f"{n}.json").write_text(json.dumps({"id": n}))


def test_paged_batch_stops_at_the_gap(spark, tmp_path):
    found = [1, 2, 5, 30, 54, 79, 104, 130, 131]  # 26 numbers between 104 and 130 hold no answer
    answers(tmp_path, found)
    paged.register(spark, "turtles", service(str(tmp_path)))
    got = paged.read_paged(spark, "turtles", 400)
    assert sorted(r.number for r in got.collect()) == [1, 2, 5, 30, 54, 79, 104]
    assert json.loads(got.filter("number = 30").first().body) == {"id": 30}
    # The gap before the first answer counts, whole tables stay whole, and blocks don't hide a gap.
    assert paged.read_paged(spark, "turtles", 400, first=150).count() == 0
    rows = spark.createDataFrame([(n, "x") for n in (4090, 4095, 4096, 4120, 4146, 9000)], "number long, body string")
    assert sorted(r.number for r in paged.up_to_the_end(rows, 4085).collect()) == [4090, 4095, 4096, 4120]
    assert paged.up_to_the_end(rows, 1).count() == 0 and paged.up_to_the_end(rows.filter("number < 4121"), 4085).count() == 4


def test_paged_stream_goes_on(spark, tmp_path):
    (tmp_path / "a").mkdir()
    answers(tmp_path / "a", [1, 2, 7])
    paged.register(spark, "growing", service(str(tmp_path / "a")))

    def run():
        stream = spark.readStream.format("growing").option("atonce", 40).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.number for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2, 7]
    answers(tmp_path / "a", [8, 30, 55])
    assert run() == [1, 2, 7, 8, 30, 55]


def test_batch(spark):
    h = {"a": 0, "b": 1, "c": 0xFFFF, "d": 0xFFFE, "e": 0xFFFFFFFF, "f": None, "g": 0xFFFFFFF0, "z": None}
    files = spark.createDataFrame([(i, n, None if x is None else [x]) for i, (n, x) in enumerate(h.items())], "id long, name string, h array<long>")
    earlier = spark.createDataFrame([(1, "old1", [3]), (2, "old2", [1])], "id long, name string, h array<long>")
    done = spark.createDataFrame([("c",), ("q",)], "name string")
    sifted = batch.sift(files, done, earlier, 4)
    got = {r.name: (r.state, r.twin) for r in sifted.collect()}
    # c is done and so no picture of this run: d is kept; g is a copy of e.
    assert got == {"a": ("duplicate", "old1"), "b": ("duplicate", "old1"), "c": ("done", None), "d": ("todo", None), "e": ("todo", None), "f": ("todo", None), "g": ("duplicate", "e"), "z": ("todo", None)}
    said = spark.createDataFrame([("d", True, True), ("e", False, None), ("f", True, False)], "name string, ok boolean, found boolean")
    out = batch.run(sifted, lambda names: said.join(names, "name", "left_semi"))
    states = {r.name: r.state for r in out.collect()}
    assert states == {"a": "duplicate", "b": "duplicate", "c": "done", "d": "matched", "e": "failed", "f": "skipped", "g": "duplicate", "z": "failed"}
    assert batch.counts(out).first().asDict() == {"done": 1, "duplicate": 3, "failed": 2, "skipped": 1, "matched": 1, "n": 8}


def test_move_plan(spark):
    report = [("a.jpg", "dup", 1), ("a.jpg", "dup", 2), ("a.jpg", "dup", 3), ("a (moved).jpg", "dup", 4), ("b.jpg", "dup", 5), ("b.jpg", "none", 6), ("noend", "none", 7), ("noend", "none", 8), ("c (moved 7).jpg", "dup", 9), (".x", "dup", 10)]
    existing = [("dup", "b.jpg"), ("dup", "b (moved).jpg"), ("dup", "c.jpg"), ("none", "other.jpg")]
    plan = batch.move_plan(spark.createDataFrame(report, "name string, folder string, n int"), spark.createDataFrame(existing, "folder string, name string"), "n")
    got = {r.n: (r.folder, r.target) for r in plan.collect()}
    assert len(set(got.values())) == len(report) and not set(got.values()) & set(existing)
    assert [got[i][1] for i in (1, 4, 5, 6, 7, 9, 10)] == ["a.jpg", "a (moved).jpg", "b (moved 2).jpg", "b.jpg", "noend", "c (moved 7).jpg", ".x"]
    assert [got[i][1] for i in (2, 3)] == ["a (moved 2).jpg", "a (moved 3).jpg"] and got[8][1] == "noend (moved)"
