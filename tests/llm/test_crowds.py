"""Rows that repeat without end, lists in shards under many probes, cells of near-equal vectors."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lynceus.llm import embedding_dedup, exact_dedup, mixing, url_filter


def test_one_row_many_times_is_no_bucket(spark):
    """Of 300,000 copies of a row at most one a source is rounded, the others are wholes and noughts; reruns over other files agree."""
    rows = spark.range(300_000).selectExpr("1L as doc_id", "'five words of one text' as text", "'a' as source").unionAll(spark.range(3000).selectExpr("id as doc_id", "concat('a text of its own ', id) as text", "if(id % 2 = 0, 'a', null) as source"))
    got = mixing.mix(rows.repartition(8)).select("doc_id", "source", "size", "target", "taken").cache()
    assert got.count() == 303_000
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) < r.m
    known = spark.createDataFrame([(i, "s", 7, 5, 0.37) for i in range(10)] + [(20, "s", 8, 5, 0.5), (21, None, 7, 5, 0.25), (22, None, 7, 5, 0.75)], f"`{mixing.RID}` long, `{mixing._SOURCE}` string, `{mixing._ORDER}` long, size long, `{mixing._P}` double")
    p = {r[0]: r[4] for r in mixing.settle_copies(known).collect()}
    assert [p[i] for i in range(3)] == [1.0] * 3 and abs(p[3] - 0.7) < 1e-9 and [p[i] for i in range(4, 10)] == [0.0] * 6 and p[20] == 0.5
    again = mixing.mix(rows.repartition(3)).select("doc_id", "source", "taken")
    ask = lambda df: sorted(map(tuple, df.groupBy("doc_id", F.coalesce("source", F.lit("?")).alias("s")).agg(F.sum("taken").alias("t"), F.max("taken").alias("m")).collect()))
    assert ask(got) == ask(again)


def test_copies_over_partitions(spark):
    """Copies in several partitions are numbered through."""
    part = lambda k: [((k << 33) + i, "s", 7, 5, 0.3) for i in range(5)]
    known = spark.createDataFrame(part(0) + part(3) + part(9), f"`{mixing.RID}` long, `{mixing._SOURCE}` string, `{mixing._ORDER}` long, size long, `{mixing._P}` double")
    p = sorted((r[0], r[4]) for r in mixing.settle_copies(known).collect())
    assert [x for _, x in p[:4]] == [1.0] * 4 and abs(p[4][1] - 0.5) < 1e-9 and all(x == 0 for _, x in p[5:])


def test_shards_under_many_probes(spark, monkeypatch):
    """Groups hold a bounded number of probes; the result is that of one file."""
    monkeypatch.setattr(url_filter, "GROUP_PROBES", 2000)
    pages = spark.range(6000).selectExpr("id as page_id", "concat('https://', if(id % 3 = 0, 'common.example.org', concat('h', id % 700, '.site', id % 5, '.com')), '/es/p', id) as url")
    one = url_filter.judge(pages)
    many = url_filter.judge(pages, largest=200)
    show = lambda df: sorted(tuple(map(str, r)) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())
    assert show(one) == show(many)


def test_a_cell_of_near_equal_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=64)
    x = v + rng.normal(0, 0.02, (4096, 64))
    table = pa.table({"cls": ["a"] * 4096, "dim": [64] * 4096, "cell": [0] * 4096, "c": [0] * 4096, "d": [0] * 4096, "chunk": [0] * 4096, "node": np.arange(4096), "m": np.ones(4096, np.int64), "own": [True] * 4096, "v": x.tolist()})
    key = tuple(pa.scalar(k) for k in ("a", 64, 0, 0, 0))
    began = time.monotonic()
    got = embedding_dedup._join(0.93)(key, table).to_pandas()
    assert time.monotonic() - began < 2 and (got.links == 4095).all() and (got.b == 0).all() and len(got) == 4096
    # Two clusters, one loner, in two chunks of one cell.
    rows = [(i, (v if i % 3 else -v) + rng.normal(0, 0.02, 64), 0) for i in range(120)] + [(500, rng.normal(size=64), 0), (501, v * 1.0, 0), (502, v * 1.0, 0)]
    df = spark.createDataFrame([(i, e.tolist(), c) for i, e, c in rows], "vec_id long, embedding array<double>, label int")
    for chunk in (8, 8192):
        embedding_dedup.CHUNK = chunk
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.op6(df).collect()}
        assert got == {i: (39, 0) if i < 120 and i % 3 == 0 else (81, 1) if i < 120 or i > 500 else (0, 500) for i, _, _ in rows}


def test_texts_are_moved_once(spark):
    """Without its text the result is the same, and the first shuffle holds the normalised bytes only."""
    docs = spark.createDataFrame([(1, "a  b", "x"), (2, "a b", "y"), (3, None, "z"), (4, "", "z"), (5, "q" * 5000, None), (6, "q" * 5000 + "!", None)], "doc_id long, text string, lang string")
    whole, bare = exact_dedup.exact_dedup(docs), exact_dedup.exact_dedup(docs, keep_text=False)
    assert bare.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(tuple, whole.drop("text").fillna("?").collect())) == sorted(map(tuple, bare.fillna("?").collect()))
