"""Readers and writers."""

import struct

from pyspark.sql import functions as F

from lynceus.sources import schemas, tables


def test_csv(spark, tmp_path):
    p = tmp_path / "crops.csv"
    p.write_text('capture_id,turtle_name,found,ymin,xmin,ymax,xmax\n1,"A, ""B""",1,0,5,,x\n2,,0,1,2,3,4\n')
    got = tables.read_csv(spark, str(p), schemas.CROPS).orderBy("capture_id").collect()
    assert [tuple(r) for r in got] == [(1, 'A, "B"', True, 0, 5, None, None, None), (2, None, False, 1, 2, 3, 4, None)]
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), schemas.CROPS).collect() == []
    assert tables.read_json_lines(spark, str(tmp_path / "none"), schemas.VIEW_ANSWERS).collect() == []


def test_pictures(spark, tmp_path):
    for name in ("T1/12.jpg", "T2/7.jpg", "T2/x.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"same")
    got = tables.list_pictures(spark, str(tmp_path)).orderBy("capture_id").collect()
    assert [(r.capture_id, r.cls, r.length) for r in got] == [(7, "T2", 4), (12, "T1", 4)]
    assert tables.digest_pictures(spark, str(tmp_path)).select("sha1").distinct().count() == 1
    assert tables.list_folder(spark, str(tmp_path / "T2")).count() == 2


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(struct.pack("<3f", 1, 2, 3))), (2, None)], "capture_id long, e binary")
    tables.overwrite(df, str(tmp_path / "v"))
    got = {r.capture_id: r.embedding for r in tables.read_vectors(spark, str(tmp_path / "v"), blob="e").collect()}
    assert got == {1: [1.0, 2.0, 3.0], 2: None}
    assert tables.read_vectors(spark, str(tmp_path / "v"), df.filter("capture_id = 2")).count() == 1


def test_keyed_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, sha string, x double")
    tables.append_new(one, path, "id")
    tables.append_new(one.unionAll(one.select((F.col("id") + 2).alias("id"), "sha", "x")), path, "id")
    assert spark.read.parquet(path).count() == 4
    tables.upsert_table(spark.createDataFrame([(1, "z"), (9, "q")], "id long, sha string"), path, "id", "sha", ("x",))
    got = {r.id: (r.sha, r.x) for r in spark.read.parquet(path).collect()}
    assert got[1] == ("z", None) and got[9] == ("q", None) and got[2] == ("b", 2.0) and len(got) == 5
    tables.replace_rows(one, path, "id")
    assert {r.id: r.x for r in spark.read.parquet(path).collect()}[1] == 1.0


def test_nested_answers(spark):
    body = '{"id": 5, "captures": [{"id": 1, "view": "front", "date": "", "original_filename": "IMG 2024-01-02.jpg", "encounter_id": 9}, {"id": 2, "view": "back"}], "encounters": [{"id": 9, "date": "2023-05-06"}]}'
    got = tables.flatten_captures(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.capture_id, str(r.captured_date), str(r.encounter_date)) for r in got] == [(1, "2024-01-02", "2023-05-06"), (2, "None", "None")]
