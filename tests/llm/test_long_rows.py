"""Very long rows are linear work, large lists are searched in shards, samples stay bounded, intermediate tables go."""

import time

import corpus_pipeline as P
from test_more_contracts import URLS, plain_verdict

from lynceus.llm import language_id, line_dedup, toxicity, url_filter
from lynceus.llm.common import Scratch
from lynceus.sources.scratch import shared_folder


def test_a_text_of_many_boilerplate_lines(spark):
    text = "\n".join(f"this line {i % 50000} is everywhere" for i in range(100_000))
    rows = [(i, text, f"s{i}") for i in range(12)] + [(99, "only here\n" + text + "\nand here", "s1")]
    began = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_chars=9).collect()}
    assert time.monotonic() - began < 120
    assert all(got[i].text == "" and got[i].n_removed == 100_000 for i in range(12)) and got[99].text == "only here\nand here"


def test_a_host_of_many_labels(spark):
    host = "a." * 100_000 + "example.org"
    df = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, "http://" + "b." * 50_000 + "cheap-pills.example.com")], "page_id long, url string")
    began = time.monotonic()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "block")} and time.monotonic() - began < 20


def test_list_in_shards(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = url_filter.judge(df, largest=100).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url), r
    assert url_filter.judge(df.limit(0), largest=100).collect() == []


def test_one_id_repeated(spark, monkeypatch):
    """A sample holds as many rows as it says, however often an id or a row occurs."""
    docs = spark.range(3000).selectExpr("7L as doc_id", "concat('wort satz und text ', id % 3) as text", "'de' as lang")
    assert sum(map(len, language_id.learn(docs).values())) < 200
    assert language_id.learn_margin(docs, language_id.learn(docs)) == 0.0
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    drawn = []
    monkeypatch.setattr(toxicity.Sample, "of", classmethod(lambda cls, texts: drawn.append(len(texts)) or (_ for _ in ()).throw(KeyboardInterrupt)))
    try:
        toxicity.learn(docs, labels)
    except KeyboardInterrupt:
        pass
    assert drawn == [3]


def listed(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return set()
    return {f"{s.getPath().getName()}/{t.getPath().getName()}" for s in fs.listStatus(path) for t in fs.listStatus(s.getPath())}


def test_pipeline_leaves_only_what_its_result_reads(spark):
    before = listed(spark)
    out = P.run(spark, "/root/testdata/sf0.001")
    left = {x for x in listed(spark) - before}
    assert left and all(x.startswith("lynceus-pack-") for x in left), left
    assert out.count() > 100


def test_release_is_for_its_owner_only(spark):
    with Scratch.owned("one"):
        a = Scratch(spark, "t").save(spark.range(5).toDF("x"), "a")
    b = Scratch(spark, "t").save(spark.range(6).toDF("x"), "b")
    Scratch.release(spark, "one")
    assert b.count() == 6
    try:
        a.count()
        raise AssertionError("the table is still there")
    except Exception as e:
        assert "the table is still there" not in str(e)
