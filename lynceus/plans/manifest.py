"""Manifest, sighting and file queries over ``documents``, ``labels`` and ``pages``: class = source, category = lang."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.functions import boxes, decisions, text
from lynceus.operators import manifest as O
from lynceus.operators import sightings as S

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source NOT IN ('src0', 'src3') AND n_chars > 1000")
def manifest_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.col("lang").isin("en", "de") & ~F.col("source").isin("src0", "src3") & (F.col("n_chars") > 1000)).select("doc_id", "lang", "source")


@query("SELECT doc_id, source, lang FROM documents WHERE (source, lang) IN (SELECT (source, lang) FROM documents GROUP BY source, lang HAVING count(*) >= 4)")
def class_min4(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "lang", F.concat_ws("|", "source", "lang").alias("cls"))
    return O.keep_large_classes(d, "cls", 4).select("doc_id", "source", "lang")


SPLIT = "c AS (SELECT source, count(*) AS n, greatest(1, round_even(count(*) * 0.15, 0)::INT) AS part FROM documents GROUP BY source)"


@query(f"WITH {SPLIT} SELECT source, n, CAST(n - 2 * part AS INTEGER) AS train, part AS valid, part AS test FROM c")
def split_counts(spark, sf_dir):
    return O.split_counts(docs(spark, sf_dir), "source")


@query(f"""WITH {SPLIT}, p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, source, CASE WHEN k <= part THEN 'test' WHEN k <= 2 * part THEN 'valid' ELSE 'train' END AS split FROM p JOIN c USING (source)""")
def split_assign(spark, sf_dir):
    digest = F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary"))
    return O.assign_splits(docs(spark, sf_dir).select("doc_id", "source"), "source", digest, F.col("doc_id"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS kept, count(*) FILTER (WHERE lang <> 'en') AS other, count(DISTINCT source) AS classes, count(DISTINCT lang) AS categories FROM documents")
def split_report(spark, sf_dir):
    return docs(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("kept"), F.count_if(F.col("lang") != "en").alias("other"),
        F.countDistinct("source").alias("classes"), F.countDistinct("lang").alias("categories"),
    )


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return O.not_done(docs(spark, sf_dir).select("doc_id", "n_chars"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1)")
def blocklist_anti(spark, sf_dir):
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1")
    return docs(spark, sf_dir).select("doc_id").join(bad.select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_manifest(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return docs(spark, sf_dir).select("doc_id", "lang").join(good.select("doc_id"), "doc_id", "left_semi")


OLD_NEW = """o AS (SELECT doc_id, source, n_chars AS version, lang AS model FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, source, n_chars + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS version FROM documents WHERE doc_id % 2 = 0)"""


def _old_new(spark, sf_dir):
    d = docs(spark, sf_dir)
    old = d.filter("doc_id % 3 <> 0").select("doc_id", "source", F.col("n_chars").alias("version"), F.col("lang").alias("model"))
    new = d.filter("doc_id % 2 = 0").select("doc_id", "source", (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("version"))
    return old, new


@query(f"""WITH {OLD_NEW} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.source, n.source) AS source,
CASE WHEN n.doc_id IS NOT NULL THEN n.version ELSE o.version END AS version,
CASE WHEN n.doc_id IS NULL OR (o.doc_id IS NOT NULL AND o.version = n.version) THEN o.model END AS model FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def upsert_merge(spark, sf_dir):
    return O.upsert(*_old_new(spark, sf_dir), "doc_id", "version", ("model",))


@query(f"WITH {OLD_NEW} SELECT doc_id, source, version FROM n UNION ALL SELECT doc_id, source, version FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def insert_or_replace(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return O.insert_or_replace(old.drop("model"), new, "doc_id")


@query(f"WITH {OLD_NEW} SELECT o.doc_id, o.source, coalesce(n.version, o.version) AS version, o.model FROM o LEFT JOIN n USING (doc_id)")
def update_where(spark, sf_dir):
    return O.update_where(*_old_new(spark, sf_dir), "doc_id", ("version",))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def alignment_check(spark, sf_dir):
    return O.misaligned(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@query("SELECT sha1(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


PHOTOS_SQL = """p AS (SELECT doc_id AS id, source AS cls, CASE WHEN doc_id % 3 = 0 THEN doc_id // 30 END AS encounter_id,
  CASE WHEN doc_id % 3 = 0 THEN (doc_id % 6000) // 30 END AS encounter_date, CASE WHEN doc_id % 4 <> 0 THEN doc_id // 17 END AS file_date,
  CASE WHEN doc_id % 5 = 0 THEN n_chars END AS filename, sha1(text) AS digest FROM documents)"""


def photos(spark, sf_dir):
    i = F.col("doc_id")
    return docs(spark, sf_dir).select(
        i.alias("id"), F.col("source").alias("cls"), F.when(i % 3 == 0, F.expr("doc_id div 30")).alias("encounter_id"), F.when(i % 3 == 0, F.expr("(doc_id % 6000) div 30")).alias("encounter_date"),
        F.when(i % 4 != 0, F.expr("doc_id div 17")).alias("file_date"), F.when(i % 5 == 0, F.col("n_chars")).alias("filename"), F.sha1(F.col("text").cast("binary")).alias("digest"),
    )


@query(f"""WITH RECURSIVE {PHOTOS_SQL}, e AS (
  SELECT id, 'e|' || cls || '|' || encounter_date AS k FROM p WHERE encounter_date IS NOT NULL
  UNION ALL SELECT p.id, 'd|' || p.cls || '|' || p.file_date FROM p JOIN (SELECT DISTINCT cls, file_date FROM p WHERE encounter_id IS NULL AND file_date IS NOT NULL) USING (cls, file_date)
  UNION ALL SELECT id, 'f|' || cls || '|' || filename FROM p WHERE filename IS NOT NULL UNION ALL SELECT id, 's|' || digest FROM p
  UNION ALL SELECT id, 'x|' || id FROM p WHERE id % 97 = 0 UNION ALL SELECT id + 1, 'x|' || id FROM p WHERE id % 97 = 0 AND id + 1 IN (SELECT id FROM p)
), m AS (SELECT k, min(id) AS b FROM e GROUP BY k), l AS (SELECT DISTINCT id AS a, b FROM e JOIN m USING (k) WHERE id <> b), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id AS node, id AS reach FROM p UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach)
SELECT node AS doc_id, min(reach) AS sighting FROM r GROUP BY node""")
def sighting_groups(spark, sf_dir):
    p = photos(spark, sf_dir)
    twice = p.filter("id % 97 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return S.sighting_groups(p, twice).select(F.col("id").alias("doc_id"), F.col("grp").alias("sighting"))


DATED = "p AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER) END AS date, source AS cls, lang AS view FROM documents)"


def dated(spark, sf_dir):
    d = docs(spark, sf_dir)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, day).alias("date"), F.col("source").alias("cls"), F.col("lang").alias("view"))


@query(f"""WITH {DATED}, l AS (SELECT id AS a, id + 4 AS b FROM p WHERE id % 6 = 0), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), g AS (SELECT a AS id, min(date) AS d FROM e JOIN p ON p.id = e.b GROUP BY a)
SELECT p.id AS doc_id, CAST(coalesce(date, d) AS VARCHAR) AS date FROM p LEFT JOIN g USING (id)""")
def date_propagation(spark, sf_dir):
    p = dated(spark, sf_dir)
    return S.spread_dates(p, p.filter("id % 6 = 0").select(F.col("id").alias("a"), (F.col("id") + 4).alias("b"))).select(F.col("id").alias("doc_id"), F.col("date").cast("string").alias("date"))


@query(f"""WITH {DATED}, j AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(a.view = b.view, false) DESC, coalesce(a.view = b.view AND a.date <> b.date, false) DESC, b.date DESC NULLS LAST, b.id) AS k FROM p a JOIN p b ON a.cls = b.cls AND a.id <> b.id)
SELECT id AS doc_id, other FROM j WHERE k = 1""")
def closest_comparable(spark, sf_dir):
    return S.closest_comparable(dated(spark, sf_dir)).select(F.col("id").alias("doc_id"), "other")


@query(f"""WITH {DATED}, e AS (SELECT DISTINCT cls, date AS day FROM p WHERE date IS NOT NULL),
g AS (SELECT a.cls, a.day, min(abs(a.day - b.day)) / 365.0 AS y FROM e a JOIN e b ON a.cls = b.cls AND a.day <> b.day GROUP BY ALL) SELECT cls AS source, CAST(day AS VARCHAR) AS day, round(y, 6) AS years FROM g""")
def nearest_gap(spark, sf_dir):
    e = dated(spark, sf_dir).filter("date is not null").select("cls", F.col("date").alias("day"))
    return S.nearest_gap(e).select(F.col("cls").alias("source"), F.col("day").cast("string").alias("day"), F.round("years", 6).alias("years"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source UNION ALL SELECT lang, NULL, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY lang")
def counts_by_key(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).filter("lang is not null")


@query("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source")
def confusion_pivot(spark, sf_dir):
    p = docs(spark, sf_dir).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1)))
    return p.select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("de", "en", "es", "fr")])


@query("SELECT source, max(n) AS most, round(max(n) / sum(n), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def mode_share(spark, sf_dir):
    c = docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source").agg(F.max("n").alias("most"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY source, lang) WHERE k <= 2")
def most_common(spark, sf_dir):
    c = docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source").orderBy(F.desc("n"), "lang")
    return c.withColumn("k", F.row_number().over(by)).filter("k <= 2").drop("k")


@query(r"""SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '(\d+)[^0-9/]*$', 1), '') AS BIGINT) AS number, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
nullif(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), '') AS utm, regexp_matches(url, '( \d+| copy( \d+)?| \(\d+\))$') AS is_copy, length(html) AS size FROM pages""")
def regex_extract(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(
        "page_id", F.regexp_extract("url", r"(\d+)[^0-9/]*$", 1).try_cast("long").alias("number"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        text.no_blank(F.regexp_extract("url", "[?&]utm_source=([^&#]+)", 1)).alias("utm"), text.is_copy_name(F.col("url")).alias("is_copy"), F.length("html").cast("long").alias("size"),
    )


BOXES = """b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1200 - 100 AS INTEGER) AS t, CAST(l_suppkey % 900 - 50 AS INTEGER) AS l, CAST(l_partkey % 1200 - 100 + l_quantity * 10 AS INTEGER) AS bo, CAST(l_suppkey % 900 - 50 + l_linenumber * 60 AS INTEGER) AS r FROM lineitem),
c AS (SELECT *, greatest(0, least(1000, t)) AS ct, greatest(0, least(1000, l)) AS cl, greatest(0, least(1000, bo)) AS cb, greatest(0, least(1000, r)) AS cr FROM b), v AS (SELECT * FROM c WHERE cb > ct AND cr > cl)"""


def _boxes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t, left = F.expr("cast(l_partkey % 1200 - 100 as int)"), F.expr("cast(l_suppkey % 900 - 50 as int)")
    box = boxes.valid_box(t, left, F.expr("cast(l_partkey % 1200 - 100 + l_quantity * 10 as int)"), F.expr("cast(l_suppkey % 900 - 50 + l_linenumber * 60 as int)"))
    return li.select("l_orderkey", "l_linenumber", box.alias("box")).filter("box is not null")


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(640, round_even((cl - (cr - cl) * 0.1) * 640 / 1000.0, 0))) AS INTEGER) AS x0, CAST(greatest(0, least(480, round_even((ct - (cb - ct) * 0.1) * 480 / 1000.0, 0))) AS INTEGER) AS y0,
CAST(greatest(0, least(640, round_even((cr + (cr - cl) * 0.1) * 640 / 1000.0, 0))) AS INTEGER) AS x1, CAST(greatest(0, least(480, round_even((cb + (cb - ct) * 0.1) * 480 / 1000.0, 0))) AS INTEGER) AS y1 FROM v""")
def box_crop(spark, sf_dir):
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", boxes.crop(F.col("box"), F.lit(640), F.lit(480), 0.1).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query(f"""WITH {BOXES}, j AS (SELECT l_orderkey, l_linenumber, ct, cl, cb, cr, greatest(0, least(cb, 700) - greatest(ct, 200)) AS h, greatest(0, least(cr, 800) - greatest(cl, 100)) AS w FROM v)
SELECT l_orderkey, l_linenumber, round(CASE WHEN h * w = 0 THEN 0 ELSE h * w / ((cb - ct) * (cr - cl) + 500 * 700 - h * w) END, 6) AS iou FROM j""")
def box_iou(spark, sf_dir):
    fixed = F.struct(F.lit(200).alias("top"), F.lit(100).alias("left"), F.lit(700).alias("bottom"), F.lit(800).alias("right"))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(boxes.iou(F.col("box"), fixed), 6).alias("iou"))


@query(f"""WITH {BOXES}, j AS (SELECT ct, cl, cb, cr, l_linenumber, greatest(0, least(cb, 700) - greatest(ct, 200)) AS h, greatest(0, least(cr, 800) - greatest(cl, 100)) AS w FROM v),
i AS (SELECT l_linenumber, CASE WHEN h * w = 0 THEN 0 ELSE h * w / ((cb - ct) * (cr - cl) + 500 * 700 - h * w) END AS iou FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY iou) AS k, count(*) OVER (PARTITION BY l_linenumber) AS n FROM i)
SELECT l_linenumber, max(n) AS n, round(max(iou) FILTER (WHERE k = n // 2 + 1), 6) AS upper_median, count(*) FILTER (WHERE iou >= 0.2) AS good, count(*) FILTER (WHERE iou < 0.05) AS poor FROM k GROUP BY l_linenumber""")
def iou_summary(spark, sf_dir):
    """The upper median by counting distinct values up to the middle: no list of all values is gathered."""
    fixed = F.struct(F.lit(200).alias("top"), F.lit(100).alias("left"), F.lit(700).alias("bottom"), F.lit(800).alias("right"))
    i = _boxes(spark, sf_dir).select("l_linenumber", boxes.iou(F.col("box"), fixed).alias("iou"))
    per = i.groupBy("l_linenumber", "iou").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("l_linenumber").orderBy("iou")
    per = per.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy("l_linenumber")))
    return per.groupBy("l_linenumber").agg(
        F.max("n").alias("n"), F.round(F.min(F.when(F.col("upto") > F.expr("n div 2"), F.col("iou"))), 6).alias("upper_median"),
        F.sum(F.when(F.col("iou") >= 0.2, F.col("c")).otherwise(0)).alias("good"), F.sum(F.when(F.col("iou") < 0.05, F.col("c")).otherwise(0)).alias("poor"),
    )


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'bad' WHEN toxic = 1 THEN 'new' ELSE 'known' END AS kind FROM labels")
def verdict_case(spark, sf_dir):
    v = F.when(F.col("quality") == 0, "bad_photo").when(F.col("toxic") == 1, "new_turtle").otherwise("known")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", decisions.verdict_kind(v).alias("kind"))
