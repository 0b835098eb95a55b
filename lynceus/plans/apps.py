"""Front-end and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators import gallery as G
from lynceus.operators import identify as I
from lynceus.operators import metrics as M
from lynceus.operators.projection import logistic_scores
from lynceus.plans.reid import BASE, SIGHTINGS, SPOTS, best, load, r6, ranked, spots, truth
from lynceus.sources.scratch import cut

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$BASE", BASE).replace("$SPOTS", SPOTS)
        return f

    return add


@query("""WITH $BASE $SPOTS, sims AS (SELECT q, max(score) AS sim FROM best GROUP BY q), t AS (SELECT f.q, f.cls, f.f, coalesce(sp.sp, 0) AS spot FROM frank f LEFT JOIN sp ON sp.q = f.q AND sp.cls = f.cls WHERE rank = 1)
SELECT t.q AS vec_id, cls AS pick, round(f, 6) AS score, round(spot, 6) AS spot, CASE WHEN spot >= 2 THEN 'match' WHEN spot >= 1.2 THEN 'check' ELSE 'possibly new' END AS band,
CASE WHEN spot >= 3 THEN 98 WHEN spot >= 2 THEN 97 WHEN spot >= 1.5 THEN 95 WHEN spot >= 1.2 THEN 45 WHEN spot >= 1 THEN 30 WHEN spot >= 0.8 THEN 15 ELSE 5 END AS likelihood, sim < 0.3 AS likely_new FROM t JOIN sims USING (q)""")
def identify_decisions(spark, sf_dir):
    g = load(spark, sf_dir)
    return I.identify(spots(g), best(g), 0.3).select(F.col("q").alias("vec_id"), "pick", r6("score"), r6("spot"), "band", "likelihood", "likely_new")


@query("""WITH $BASE, five AS (SELECT q, qcls, q % 7 AS grp, cls, score FROM ranked WHERE rank <= 5), fl AS (SELECT q, qcls, grp, min(score) AS f FROM five GROUP BY ALL),
names AS (SELECT DISTINCT qcls, grp, cls FROM five), x AS (SELECT n.qcls, n.grp, n.cls, coalesce(five.score, fl.f) AS s FROM names n JOIN fl USING (qcls, grp) LEFT JOIN five ON five.q = fl.q AND five.cls = n.cls)
SELECT qcls AS label, grp AS sighting, cls AS pick, round(sum(s), 6) AS score FROM x GROUP BY ALL""")
def floor_combine(spark, sf_dir):
    g = load(spark, sf_dir)
    sets = g.select(F.col("id").alias("q"), F.struct("cls", "grp").alias("grp"))
    out = I.combine_with_floor(ranked(g), sets)
    return out.select(F.col("grp.cls").alias("label"), F.col("grp.grp").alias("sighting"), F.col("cls").alias("pick"), r6("score"))


@query("""WITH $BASE, l AS (SELECT q, list(cls ORDER BY rank) AS b FROM ranked WHERE rank <= 5 GROUP BY q)
SELECT q AS vec_id, b[3] AS first, b[1] AS second, b[2] AS third FROM l""")
def rerank_merge(spark, sf_dir):
    """An outside answer that names the third twice and a stranger: the others follow in their own order."""
    r = ranked(load(spark, sf_dir))
    lists = r.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cls"))), lambda x: x.cls).alias("b"))
    merged = I.merge_answer(F.array(F.col("b")[2], F.lit(-9), F.col("b")[2]), F.col("b")).alias("m")
    return lists.select("q", merged).select(F.col("q").alias("vec_id"), F.col("m")[0].alias("first"), F.col("m")[1].alias("second"), F.col("m")[2].alias("third"))


@query("""WITH f AS (SELECT doc_id, text, n_chars, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first FROM documents)
SELECT 'd' || doc_id AS name, CASE WHEN first <> doc_id THEN 'duplicates' WHEN n_chars < 200 THEN 'no_turtle' ELSE 'turtles' END AS folder, CASE WHEN first <> doc_id THEN 'same as d' || first WHEN n_chars < 200 THEN 'nothing found' ELSE '' END AS reason FROM f""")
def sort_report(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.sha1(F.col("text").cast("binary")).alias("digest"), F.col("doc_id").alias("seq"), "n_chars")
    return I.sort_plan(files, F.col("n_chars") >= 200)


@query("SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return I.sample(d, F.struct(F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string")).cast("binary")), F.col("doc_id")), 100)


@query("""WITH v AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS roles, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, n, list_has_any(roles, ['system']) AS any_system, list_has_all(roles, ['user', 'assistant']) AS both, len(list_intersect(roles, ['user', 'system'])) AS shared FROM v""")
def side_sets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.count(F.lit(1)).alias("n"))
    pair = F.array(F.lit("user"), F.lit("assistant"))
    return c.select(
        "conv_id", "n", F.arrays_overlap("roles", F.array(F.lit("system"))).alias("any_system"), (F.size(F.array_intersect("roles", pair)) == 2).alias("both"),
        F.size(F.array_intersect("roles", F.array(F.lit("user"), F.lit("system")))).cast("long").alias("shared"),
    )


@query("""WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS name FROM events) SELECT event_id, strftime(strptime(name, '%Y-%m-%d'), '%d %b %Y') AS pretty, CAST(year(strptime(name, '%Y-%m-%d')) AS INTEGER) AS year, name >= '2024' AS recent FROM e""")
def pretty_dates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("name"))
    day = F.to_date("name")
    return e.select("event_id", F.date_format(day, "dd MMM yyyy").alias("pretty"), F.year(day).alias("year"), (day >= F.lit("2024-01-01").cast("date")).alias("recent"))


@query("""WITH $BASE, h AS (SELECT q, qcls, h1, q % 7 AS grp FROM hits), v AS (SELECT 'query' AS level, avg(h1::INT) AS acc, count(*) AS n FROM h), e AS (SELECT qcls, grp, avg(h1::INT) AS a FROM h GROUP BY ALL)
SELECT level, round(acc, 6) AS acc, n FROM v UNION ALL SELECT 'sighting', round(avg(a), 6), count(*) FROM e""")
def accuracy_levels(spark, sf_dir):
    """Accuracy over photos and over sightings, each with its own n."""
    g = load(spark, sf_dir)
    flags = M.hits(ranked(g), truth(G.with_other_sighting(g))).select("true_cls", (F.col("q") % SIGHTINGS).alias("grp"), F.col("hit1").cast("int").alias("h"))
    each = flags.groupBy("true_cls", "grp").agg(F.avg("h").alias("a"))
    photos = flags.agg(F.lit("query").alias("level"), F.round(F.avg("h"), 6).alias("acc"), F.count(F.lit(1)).alias("n"))
    return photos.unionAll(each.agg(F.lit("sighting").alias("level"), F.round(F.avg("a"), 6).alias("acc"), F.count(F.lit(1)).alias("n")))


@query(None)
def model_comparison(spark, sf_dir):
    """Centroid, 1-, 3-, 5-nearest votes and a logistic regression, chosen on one sighting's queries and reported on another's."""
    from functools import reduce

    g = load(spark, sf_dir)
    train, ask = g.filter("grp > 1"), g.filter("grp <= 1")
    runs = {"centroid": G.score(ask, G.centroids(train), "none", "class", 1)}
    # The fewer nearest are the first of the five, which are compared once.
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ref"))
    five = cut(G.score(ask, train, "none", "overall", 5).withColumn("place", place))
    for k in (1, 3, 5):
        runs[f"nearest {k}"] = G.knn_votes(five.filter(F.col("place") <= k))
    runs["logistic"] = logistic_scores(train, ask)
    rows = []
    for name, scores in runs.items():
        flags = M.hits(G.top_classes(scores), truth(ask)).withColumn("part", F.when(F.col("q") % SIGHTINGS == 0, "valid").otherwise("test"))
        acc = M.accuracy(flags, "part").groupBy().pivot("part", ["valid", "test"]).agg(F.first("top1"))
        rows.append(acc.select(F.lit(name).alias("model"), r6("valid"), r6("test")))
    return reduce(lambda a, b: a.unionAll(b), rows).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("valid"), "model")))


PHOTOS = """, ph AS (SELECT q, qcls * 7 + q % 7 AS grp, q % 2 = 0 AS side, cls, coalesce(sp.sp, 0) AS spot, coalesce(b.score, -1) AS emb FROM best b LEFT JOIN sp USING (q, qcls, cls)),
pf AS (SELECT *, ln(1 + greatest(spot, 0)) + emb AS f FROM ph)"""


@query("WITH $BASE $SPOTS" + PHOTOS + """, has AS (SELECT grp, bool_or(side) AS h FROM pf GROUP BY grp),
top AS (SELECT q, cls FROM (SELECT q, cls, row_number() OVER (PARTITION BY q ORDER BY f DESC, cls) AS k FROM pf) WHERE k = 1),
a AS (SELECT 'sum' AS how, grp, cls, sum(f) AS s FROM pf GROUP BY ALL UNION ALL SELECT 'sides', grp, cls, sum(f) FROM pf JOIN has USING (grp) WHERE side OR NOT h GROUP BY ALL
  UNION ALL SELECT 'best spot, mean vector', grp, cls, ln(1 + greatest(max(spot), 0)) + avg(emb) FROM pf GROUP BY ALL
  UNION ALL SELECT 'sum of spots, best vector', grp, cls, sum(ln(1 + greatest(spot, 0))) + max(emb) FROM pf GROUP BY ALL
  UNION ALL SELECT 'vote', pf.grp, pf.cls, sum(CASE WHEN top.cls = pf.cls THEN 1 + 1e-3 * f ELSE 0 END) + 1e-6 * sum(f) FROM pf JOIN top USING (q) GROUP BY ALL)
SELECT how, grp AS "set", cls AS pick, round(s, 6) AS score FROM a""")
def combine_variants(spark, sf_dir):
    from functools import reduce

    g = load(spark, sf_dir)
    one = best(g).select("q", "cls", F.col("score").alias("emb"))
    p = one.join(spots(g).select("q", "cls", F.col("score").alias("spot")), ["q", "cls"], "left").join(truth(g), "q")
    p = p.select("q", (F.col("true_cls") * 7 + F.col("q") % 7).alias("grp"), (F.col("q") % 2 == 0).alias("side"), "cls", F.coalesce("spot", F.lit(0.0)).alias("spot"), "emb")
    parts = [I.combine(p, how).select(F.lit(how).alias("how"), F.col("grp").alias("set"), F.col("cls").alias("pick"), r6("score")) for how in I.COMBINERS]
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT source FROM documents)")
def label_codes(spark, sf_dir):
    from lynceus.operators.manifest import encode_labels

    return encode_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS skipped, count(*) FILTER (WHERE quality = 0) AS failed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def batch_report(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("done", F.lit(True)), "doc_id", "left")
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("matched"), F.count_if(F.col("done").isNull()).alias("skipped"), F.count_if(F.col("quality") == 0).alias("failed")
    )
