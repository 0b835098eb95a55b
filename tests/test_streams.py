"""Streams: state by key, restarts, late rows, near copies whatever the files."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lynceus.operators import greedy
from lynceus.streaming import copies, keyed
from lynceus.streaming import log as L

LOG = "seq long, key string, kind string, value double"


def files(spark, path, parts, schema):
    """Each part as one file that the stream takes as a micro-batch, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/.{i}")
        one = next(Path(f"{path}/.{i}").glob("*.parquet"))
        Path(path, f"{i:03d}.parquet").write_bytes(one.read_bytes())


def size_of(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*") if p.is_file())


def test_last_wins_over_late_rows_and_a_restart(spark, tmp_path):
    rows = [(i, f"k{i % 7}", "ab"[i % 2], float(i) if i % 5 else None) for i in range(60)]
    random.Random(1).shuffle(rows)
    (tmp_path / "log").mkdir()
    files(spark, tmp_path / "log", [rows[:20], rows[20:30]], LOG)
    run = lambda: L.keep_last(L.read_log(spark, str(tmp_path / "log"), spark.createDataFrame([], LOG).schema), str(tmp_path / "cp"), ["key", "kind"], "seq", ["value"]).awaitTermination()
    state = lambda: sorted(((r.key, r.kind), (r.value, r.seq)) for r in keyed.kept(spark, str(tmp_path / "cp")).collect())

    def last(some):
        out = {}
        for seq, key, kind, value in sorted(some, key=lambda r: r[0]):
            out[key, kind] = (value, seq)
        return sorted(out.items(), key=lambda x: x[0])

    run()
    assert state() == last(rows[:30])
    # A restart goes on from the checkpoint; rows that come late don't replace later ones.
    for i, part in enumerate((rows[30:50], rows[50:]), 2):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(str(tmp_path / f"more{i}"))
        (tmp_path / "log" / f"{i:03d}.parquet").write_bytes(next((tmp_path / f"more{i}").glob("*.parquet")).read_bytes())
    run()
    assert state() == last(rows)
    run()
    assert state() == last(rows)


def test_one_key_holds_most_rows(spark, tmp_path):
    """The rows of a key are combined before the shuffle: 5,000 rows of one key reach the store as a row a batch."""
    rows = spark.range(5000).select(F.col("id").alias("seq"), F.lit("hot").alias("key"), F.col("id").cast("double").alias("value"))
    assert keyed.last_of_batch(rows.coalesce(1), ["key"], "seq").collect()[0].seq == 4999
    assert keyed.last_of_batch(rows.coalesce(1), ["key"], "seq").count() == 1
    sums = keyed.sums_of_batch(rows.coalesce(1).withColumn("n", F.lit(1).cast("long")), ["key"], ["n", "value"]).collect()
    assert [(r.key, r.n, r.value) for r in sums] == [("hot", 5000, sum(map(float, range(5000))))]


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    """Of a state of 20,000 keys a micro-batch of one key writes next to nothing."""
    many = [(i, f"k{i}", "a", 1.0) for i in range(20_000)]
    (tmp_path / "log").mkdir()
    files(spark, tmp_path / "log", [many], LOG)
    run = lambda: L.keep_last(L.read_log(spark, str(tmp_path / "log"), spark.createDataFrame([], LOG).schema), str(tmp_path / "cp"), ["key"], "seq", ["value"]).awaitTermination()
    run()
    whole = size_of(tmp_path / "cp")
    files(spark, tmp_path / "more", [[(90_000, "k5", "a", 2.0)]], LOG) if (tmp_path / "more").mkdir() is None else None
    (tmp_path / "log" / "900.parquet").write_bytes((tmp_path / "more" / "000.parquet").read_bytes())
    run()
    assert size_of(tmp_path / "cp") - whole < whole / 4
    got = keyed.kept(spark, str(tmp_path / "cp"))
    assert got.count() == 20_000 and got.filter("key = 'k5'").first().value == 2.0


def test_summary_is_that_of_the_whole_log(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(5).write.parquet(str(tmp_path / "log"))
    L.keep_summary(L.read_log(spark, str(tmp_path / "log"), e.schema), str(tmp_path / "cp")).awaitTermination()
    got = {(r.day, r.event_type): (r.n, r.users, round(r.total, 3)) for r in L.summary_of(keyed.kept(spark, str(tmp_path / "cp"))).collect()}
    assert got == {(r.day, r.event_type): (r.n, r.users, round(r.total, 3)) for r in L.daily_summary(e).collect()}
    assert sum(n for n, _, _ in got.values()) == e.count()


def test_members(spark, tmp_path):
    schema = "seq long, upload_id string, method string, notes string"
    rows = [(1, "S1", "sighting", "photos a;b"), (2, "S2", "sighting", "photos c"), (3, "a", "best", "spot 2.1"), (4, "S1", "sighting", "photos a;b;d"), (5, "S2", "sighting", None)]
    got = L.members_in(spark.createDataFrame(rows, schema))
    want = {"S1": ["a", "b", "d"], "S2": ["c"]}
    assert {r.upload_id: r.members for r in got.collect()} == want
    assert sorted(map(tuple, L.set_of(got, "upload_id").collect())) == [("a", "S1"), ("b", "S1"), ("c", "S2"), ("d", "S1")]
    (tmp_path / "log").mkdir()
    files(spark, tmp_path / "log", [rows[3:], rows[:3]], schema)  # the later row comes first
    L.keep_members(L.read_log(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema), str(tmp_path / "cp")).awaitTermination()
    assert {r.upload_id: r.members for r in keyed.kept(spark, str(tmp_path / "cp")).collect()} == want


def prints(n, seed):
    """Hashes of 128 bits in chains: each next one a few bits from the one before, some equal, some alone, one null."""
    rng = random.Random(seed)
    rows, h = [], rng.getrandbits(128)
    for i in range(n):
        step = rng.random()
        if step < 0.3:
            h = rng.getrandbits(128)
        elif step < 0.9:
            for _ in range(rng.randint(1, 7)):
                h ^= 1 << rng.randrange(128)
        words = [(h >> 64) & (1 << 64) - 1, h & (1 << 64) - 1]
        rows.append((i, [w - (1 << 64) if w >> 63 else w for w in words]))
    return rows


@pytest.mark.parametrize("cuts", [(60,), (20, 40, 60), (1, 2, 59, 60)])
def test_near_copies_are_those_of_the_whole(spark, tmp_path, cuts):
    schema = "id long, h array<long>"
    rows = prints(60, 5)
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
    kept, want = [], {}
    for i, h in rows:
        want[i] = next((j for j, o in kept if bits(h, o) <= 10), None)
        if want[i] is None:
            kept.append((i, h))
    whole = {r.id: r.twin for r in greedy.first_kept(spark.createDataFrame(rows, schema), 10).collect()}
    assert whole == want and 0 < sum(t is not None for t in want.values()) < 60
    (tmp_path / "log").mkdir()
    files(spark, tmp_path / "log", [rows[a:b] for a, b in zip((0, *cuts), cuts, strict=False)], schema)
    stream = L.read_log(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema)
    copies.keep_first(stream, str(tmp_path / "t"), str(tmp_path / "cp"), 10).awaitTermination()
    assert {r.id: r.twin for r in copies.decided(spark, str(tmp_path / "t")).collect()} == want


def test_near_copies_after_a_restart_and_a_null(spark, tmp_path):
    schema = "id long, h array<long>"
    (tmp_path / "log").mkdir()
    files(spark, tmp_path / "log", [[(0, [5, 9]), (1, None)]], schema)
    run = lambda: copies.keep_first(L.read_log(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema), str(tmp_path / "t"), str(tmp_path / "cp"), 10).awaitTermination()
    run()
    spark.createDataFrame([(2, [5, 8]), (3, None), (4, [-1, -1])], schema).coalesce(1).write.parquet(str(tmp_path / "more"))
    (tmp_path / "log" / "900.parquet").write_bytes(next((tmp_path / "more").glob("*.parquet")).read_bytes())
    run()
    assert {r.id: r.twin for r in copies.decided(spark, str(tmp_path / "t")).collect()} == {0: None, 1: None, 2: 0, 3: None, 4: None}
