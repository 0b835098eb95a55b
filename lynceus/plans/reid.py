"""Re-identification queries over ``embeddings``: class = label, sighting = vec_id % 7."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators import gallery as G
from lynceus.operators import metrics as M

SIGHTINGS = 7


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label is not null and embedding is not null")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("cls"), (F.col("vec_id") % SIGHTINGS).alias("grp"), F.col("embedding").alias("v"))


def truth(g: DataFrame) -> DataFrame:
    return g.select(F.col("id").alias("q"), F.col("cls").alias("true_cls"))


def best(g: DataFrame, exclude="sighting", k: int = 1, keep: str = "class") -> DataFrame:
    return G.score(G.with_other_sighting(g), g, exclude, keep, k)


def ranked(g: DataFrame) -> DataFrame:
    return G.top_classes(best(g))


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


BASE = f"""
g AS (SELECT vec_id AS id, label AS cls, vec_id % {SIGHTINGS} AS grp, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
m AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-12 AS n FROM g),
qs AS (SELECT * FROM m WHERE cls IN (SELECT cls FROM g GROUP BY cls HAVING count(DISTINCT grp) > 1)),
pairs AS (SELECT q.id AS q, q.cls AS qcls, q.grp AS qgrp, r.id AS ref, r.cls, r.grp AS rgrp, list_dot_product(q.v, r.v) / (q.n * r.n) AS s FROM qs q JOIN m r ON q.grp <> r.grp),
best AS (SELECT q, qcls, cls, max(s) AS score FROM pairs GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cls) AS rank FROM best),
hits AS (SELECT q, qcls, bool_or(cls = qcls AND rank <= 1) AS h1, bool_or(cls = qcls AND rank <= 5) AS h5 FROM ranked GROUP BY ALL)
"""
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$BASE", BASE)
        return f

    return add


@query("WITH $BASE SELECT q AS vec_id, CAST(rank AS INTEGER) AS rank, cls AS label, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def reid_other_sighting_topk(spark, sf_dir):
    return ranked(load(spark, sf_dir)).select(F.col("q").alias("vec_id"), "rank", F.col("cls").alias("label"), r6("score"))


@query("WITH $BASE SELECT count(*) AS n, round(avg(h1::INT), 6) AS top1, round(avg(h5::INT), 6) AS top5 FROM hits")
def reid_topk_accuracy(spark, sf_dir):
    g = load(spark, sf_dir)
    return M.accuracy(M.hits(ranked(g), truth(G.with_other_sighting(g)))).select("n", r6("top1"), r6("top5"))


@query("WITH $BASE SELECT qcls AS label, count(*) AS n, CAST(sum(h1::INT) AS BIGINT) AS hits, round(avg(h1::INT), 6) AS top1 FROM hits GROUP BY qcls")
def reid_per_class_accuracy(spark, sf_dir):
    g = load(spark, sf_dir)
    flags = M.hits(ranked(g), truth(G.with_other_sighting(g)))
    return flags.groupBy(F.col("true_cls").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit1").alias("hits"), F.round(F.avg(F.col("hit1").cast("int")), 6).alias("top1"))


@query("""WITH $BASE, refs AS (SELECT p.q, p.cls, ref, s, row_number() OVER (PARTITION BY p.q, p.cls ORDER BY s DESC, ref) AS ref_rank FROM pairs p)
SELECT r.q AS vec_id, CAST(r.rank AS INTEGER) AS rank, r.cls AS label, CAST(ref_rank AS INTEGER) AS ref_rank, ref, round(s, 6) AS score
FROM ranked r JOIN refs USING (q, cls) WHERE r.rank <= 5 AND ref_rank <= 3""")
def rank_classes_with_refs(spark, sf_dir):
    refs = best(load(spark, sf_dir), k=3)
    refs = refs.withColumn("ref_rank", F.row_number().over(Window.partitionBy("q", "cls").orderBy(F.desc("score"), "ref")))
    top = refs.filter("ref_rank = 1")
    ranks = G.top_classes(top).select("q", "cls", "rank")
    return refs.join(ranks, ["q", "cls"]).select(F.col("q").alias("vec_id"), "rank", F.col("cls").alias("label"), "ref_rank", "ref", r6("score"))


def _knn(k: int):
    def run(spark, sf_dir):
        g = load(spark, sf_dir)
        votes = G.knn_votes(G.score(G.with_other_sighting(g), g, "sighting", "overall", k))
        return G.top_classes(votes.withColumn("score", F.round("score", 9))).select(F.col("q").alias("vec_id"), "rank", F.col("cls").alias("label"), r6("score"))

    run.__name__ = f"knn_vote_k{k}"
    return query(f"""WITH $BASE, nn AS (SELECT q, cls, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, ref) AS k FROM pairs),
v AS (SELECT q, cls, round(sum(s), 9) AS score FROM nn WHERE k <= {k} GROUP BY ALL HAVING sum(s) > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cls) AS rank FROM v)
SELECT q AS vec_id, CAST(rank AS INTEGER) AS rank, cls AS label, round(score, 6) AS score FROM t WHERE rank <= 5""")(run)


for _k in (1, 3, 5):
    _knn(_k)


@query("""WITH $BASE, u AS (SELECT cls, generate_subscripts(v, 1) AS i, unnest(v) / n AS x FROM m),
c AS (SELECT cls, i, avg(x) AS x FROM u GROUP BY ALL), cv AS (SELECT cls, list(x ORDER BY i) AS v FROM c GROUP BY cls),
s AS (SELECT m.id, cv.cls, list_dot_product(m.v, cv.v) / (m.n * (sqrt(list_dot_product(cv.v, cv.v)) + 1e-12)) AS score FROM m, cv),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cls) AS rank FROM s)
SELECT id AS vec_id, cls AS label, round(score, 6) AS score FROM t WHERE rank = 1""")
def centroid_classify(spark, sf_dir):
    g = load(spark, sf_dir)
    top = G.top_classes(G.score(g, G.centroids(g), "none", "class", 1), 1)
    return top.select(F.col("q").alias("vec_id"), F.col("cls").alias("label"), r6("score"))


@query("""WITH $BASE, n2 AS (SELECT q, cls, s, row_number() OVER (PARTITION BY q, cls ORDER BY s DESC, ref) AS k FROM pairs),
v AS (SELECT q, cls, sum(s) AS score FROM n2 WHERE k <= 2 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cls) AS rank FROM v)
SELECT q AS vec_id, cls AS label, round(score, 6) AS score FROM t WHERE rank = 1""")
def top2_sum_class(spark, sf_dir):
    two = best(load(spark, sf_dir), k=2).groupBy("q", "cls").agg(F.sum("score").alias("score"))
    return G.top_classes(two, 1).select(F.col("q").alias("vec_id"), F.col("cls").alias("label"), r6("score"))


def _known_new(spark, sf_dir):
    g = load(spark, sf_dir)
    return M.known_and_new(G.score(g, g, "sighting", "class", 1), truth(g))


CALIBRATE = """, allp AS (SELECT q.id AS q, q.cls AS qcls, r.cls, list_dot_product(q.v, r.v) / (q.n * r.n) AS s FROM m q JOIN m r ON q.grp <> r.grp),
kn AS (SELECT q, max(s) FILTER (WHERE cls = qcls) AS s_known, max(s) FILTER (WHERE cls <> qcls) AS s_new FROM allp GROUP BY q),
cand AS (SELECT DISTINCT t FROM (SELECT s_known AS t FROM kn UNION ALL SELECT s_new FROM kn) WHERE t IS NOT NULL),
cal AS (SELECT t, (SELECT avg((s_known >= t)::INT) FROM kn WHERE s_known IS NOT NULL) AS kept, (SELECT avg((s_new < t)::INT) FROM kn WHERE s_new IS NOT NULL) AS caught FROM cand)"""


@query("WITH $BASE" + CALIBRATE + " SELECT round(t, 6) AS cutoff, round(kept, 6) AS kept, round(caught, 6) AS caught FROM cal ORDER BY round(cal.kept + cal.caught, 12) DESC, t LIMIT 1")
def calibrate_balanced(spark, sf_dir):
    return M.calibrate(_known_new(spark, sf_dir)).select(F.round("t", 6).alias("cutoff"), r6("kept"), r6("caught"))


@query("WITH $BASE" + CALIBRATE + " SELECT round(t, 6) AS cutoff, round(kept, 6) AS kept, round(caught, 6) AS caught FROM cal WHERE round(cal.kept, 12) >= 0.8 ORDER BY t DESC LIMIT 1")
def calibrate_keep80(spark, sf_dir):
    return M.calibrate(_known_new(spark, sf_dir), 0.8).select(F.round("t", 6).alias("cutoff"), r6("kept"), r6("caught"))


@query("WITH $BASE" + CALIBRATE + ", k AS (SELECT s_known AS a FROM kn WHERE s_known IS NOT NULL), w AS (SELECT s_new AS b FROM kn WHERE s_new IS NOT NULL) SELECT round(avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0 END), 6) AS auc FROM k, w")
def auc_known_new(spark, sf_dir):
    kn = _known_new(spark, sf_dir)
    both = kn.select(F.explode(F.array(F.struct(F.col("s_known").alias("score"), F.lit(True).alias("known")), F.struct(F.col("s_new").alias("score"), F.lit(False).alias("known")))).alias("x")).select("x.*")
    return M.auc(both.filter("score is not null")).select(r6("auc"))


def spots(g: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """A second evidence from the first half of each vector; every third reference has none.  With ``picks(q, pick)`` a query meets the references of its pick only."""
    half = g.withColumn("v", F.slice("v", 1, 32))
    refs, queries, exclude = half.filter("id % 3 <> 0"), G.with_other_sighting(half), "sighting"
    if picks is not None:
        queries, exclude = half.drop("cls").join(picks.select(F.col("q").alias("id"), F.col("pick").alias("cls")), "id"), "sighting_or_other_class"
    return G.score(queries, refs, exclude, "class", 1).withColumn("score", F.col("score") * 10)


SPOTS = """, h AS (SELECT id, cls, grp, v[1:32] AS v FROM g), hm AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-12 AS n FROM h),
sp AS (SELECT q.id AS q, q.cls AS qcls, r.cls, max(list_dot_product(q.v, r.v) / (q.n * r.n) * 10) AS sp FROM hm q JOIN hm r ON q.grp <> r.grp WHERE r.id % 3 <> 0 AND q.id IN (SELECT id FROM qs) GROUP BY ALL),
fused AS (SELECT coalesce(b.q, sp.q) AS q, coalesce(b.qcls, sp.qcls) AS qcls, coalesce(b.cls, sp.cls) AS cls, ln(1 + greatest(coalesce(sp, 0), 0)) + coalesce(score, -1) AS f FROM best b FULL JOIN sp ON b.q = sp.q AND b.cls = sp.cls),
frank AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY f DESC, cls) AS rank FROM fused)"""


@query("WITH $BASE" + SPOTS + " SELECT q AS vec_id, CAST(rank AS INTEGER) AS rank, cls AS label, round(f, 6) AS score FROM frank WHERE rank <= 5")
def fuse_scores(spark, sf_dir):
    g = load(spark, sf_dir)
    return G.top_classes(G.fuse(spots(g), best(g))).select(F.col("q").alias("vec_id"), "rank", F.col("cls").alias("label"), r6("score"))


@query("WITH $BASE, r AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY score DESC) AS k FROM best) SELECT q AS vec_id, CAST(k AS INTEGER) AS rank FROM r WHERE cls = qcls")
def right_class_rank(spark, sf_dir):
    g = load(spark, sf_dir)
    return M.right_rank(best(g), truth(g)).select(F.col("q").alias("vec_id"), "rank")


@query("WITH $BASE" + SPOTS + """, a AS (SELECT q, cls = qcls AS ok FROM ranked WHERE rank = 1), b AS (SELECT q, cls = qcls AS ok FROM frank WHERE rank = 1)
SELECT count(*) FILTER (WHERE b.ok AND NOT a.ok) AS fixed, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS broken, count(*) AS n FROM a JOIN b USING (q)""")
def paired_fixed_broken(spark, sf_dir):
    g = load(spark, sf_dir)
    one = best(g)
    ok = lambda top, name: G.top_classes(top, 1).join(truth(g), "q").select("q", (F.col("cls") == F.col("true_cls")).alias(name))
    both = ok(one, "a").join(ok(G.fuse(spots(g), one), "b"), "q")
    return both.agg(F.count_if(F.expr("b and not a")).alias("fixed"), F.count_if(F.expr("a and not b")).alias("broken"), F.count(F.lit(1)).alias("n"))


@query("WITH $BASE" + SPOTS + """, st AS (SELECT qcls, q % 7 AS grp, cls, sum(f) AS f FROM fused GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY qcls, grp ORDER BY round(f, 9) DESC, cls) AS rank FROM st)
SELECT qcls AS label, grp AS sighting, cls AS pick, round(f, 6) AS score FROM t WHERE rank = 1""")
def sighting_combine(spark, sf_dir):
    g = load(spark, sf_dir)
    each = G.fuse(spots(g), best(g)).join(truth(g), "q")
    total = each.groupBy("true_cls", (F.col("q") % SIGHTINGS).alias("sighting"), "cls").agg(F.sum("score").alias("score"))
    by = Window.partitionBy("true_cls", "sighting").orderBy(F.desc(F.round("score", 9)), "cls")
    return total.withColumn("k", F.row_number().over(by)).filter("k = 1").select(F.col("true_cls").alias("label"), "sighting", F.col("cls").alias("pick"), r6("score"))


#: How sighting scores are combined: name, SQL over fused rows (alternatives to the vector sum).
@query("WITH $BASE" + SPOTS + """, v AS (SELECT q, qcls, cls FROM frank WHERE rank = 1), n AS (SELECT qcls, q % 7 AS grp, cls, count(*) AS votes FROM v GROUP BY ALL),
s AS (SELECT qcls, q % 7 AS grp, cls, sum(f) AS f FROM fused GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY qcls, grp ORDER BY votes DESC, round(f, 9) DESC, cls) AS k FROM n JOIN s USING (qcls, grp, cls))
SELECT qcls AS label, grp AS sighting, cls AS pick, votes FROM t WHERE k = 1""")
def sighting_vote(spark, sf_dir):
    g = load(spark, sf_dir)
    each = G.fuse(spots(g), best(g)).join(truth(g), "q").withColumn("sighting", F.col("q") % SIGHTINGS)
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls")))
    total = first.groupBy("true_cls", "sighting", "cls").agg(F.count_if(F.col("k") == 1).alias("votes"), F.sum("score").alias("f")).filter("votes > 0")
    by = Window.partitionBy("true_cls", "sighting").orderBy(F.desc("votes"), F.desc(F.round("f", 9)), "cls")
    return total.withColumn("k", F.row_number().over(by)).filter("k = 1").select(F.col("true_cls").alias("label"), "sighting", F.col("cls").alias("pick"), "votes")


SUPPORT_LEAST = 0.2


def support(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each reference shares with each other sighting of its class, and its support: sightings with a strong match, and the sum of all."""
    from lynceus.operators.audit import support_of
    from lynceus.sources.scratch import cut

    met = cut(G.by_sighting(g, SUPPORT_LEAST))
    return met, support_of(met, g)


SUPPORT = f""", met AS (SELECT q.id, r.grp AS rgrp, count(*) FILTER (WHERE list_dot_product(q.v, r.v) / (q.n * r.n) >= {SUPPORT_LEAST}) AS strong, sum(list_dot_product(q.v, r.v) / (q.n * r.n)) AS total FROM m q JOIN m r ON q.cls = r.cls AND q.grp <> r.grp GROUP BY ALL),
sup AS (SELECT id, count(*) FILTER (WHERE strong > 0) AS sightings, sum(total) AS total FROM met GROUP BY id),
supp AS (SELECT m.id, m.cls, m.grp, coalesce(sightings, 0) AS sightings, coalesce(total, 0) AS total FROM m LEFT JOIN sup ON sup.id = m.id)"""


@query("WITH $BASE" + SUPPORT + """, t AS (SELECT *, row_number() OVER (PARTITION BY cls, id % 2 ORDER BY sightings DESC, round(total, 9) DESC, id) AS k FROM supp)
SELECT cls AS label, id % 2 AS side, CAST(k AS INTEGER) AS rank, id AS vec_id, sightings, round(total, 6) AS total FROM t WHERE k <= 3""")
def index_support_topk(spark, sf_dir):
    s = support(load(spark, sf_dir))[1].withColumn("side", F.col("id") % 2)
    by = Window.partitionBy("cls", "side").orderBy(F.desc("sightings"), F.desc(F.round("total", 9)), "id")
    top = s.withColumn("rank", F.row_number().over(by)).filter("rank <= 3")
    return top.select(F.col("cls").alias("label"), "side", "rank", F.col("id").alias("vec_id"), "sightings", r6("total"))


@query("WITH $BASE" + SUPPORT + """, b AS (SELECT q, qcls, qgrp, cls, ref, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, cls, ref) AS k FROM pairs),
u AS (SELECT b.*, sightings - CASE WHEN b.cls = qcls AND coalesce(met.strong, 0) > 0 THEN 1 ELSE 0 END AS left_ FROM b JOIN supp ON supp.id = b.ref LEFT JOIN met ON met.id = b.ref AND met.rgrp = b.qgrp WHERE k = 1)
SELECT q AS vec_id, cls AS pick, left_ AS support, CASE WHEN s < 0.2 THEN 'possibly new' WHEN s < 0.3 OR left_ < 1 THEN 'check' ELSE 'match' END AS band FROM u""")
def two_tier_downgrade(spark, sf_dir):
    from lynceus.operators.audit import two_tier

    g = load(spark, sf_dir)
    met, support_ = support(g)
    queries = g.select(F.col("id").alias("q"), F.col("cls").alias("true_cls"), "grp")
    out = two_tier(G.top_classes(best(g), 1), queries, met, support_, 0.3, 0.2)
    return out.select(F.col("q").alias("vec_id"), F.col("cls").alias("pick"), "support", "band")


@query("WITH $BASE" + """, ownb AS (SELECT q, max(s) AS own, arg_max(ref, (s, -ref)) AS own_ref FROM pairs WHERE cls = qcls GROUP BY q),
oth AS (SELECT q, max(s) AS other, arg_max(ref, (s, -ref)) AS other_ref FROM pairs WHERE cls <> qcls GROUP BY q)
SELECT qs.id AS vec_id, own_ref, other_ref, round(own, 6) AS own, round(other, 6) AS other,
CASE WHEN other >= 0.35 AND other > coalesce(own, -1) THEN 'misfiled' WHEN coalesce(own, -1) < 0.1 THEN 'no match' ELSE '' END AS flag
FROM qs LEFT JOIN ownb ON ownb.q = qs.id LEFT JOIN oth ON oth.q = qs.id""")
def audit_flags(spark, sf_dir):
    from lynceus.operators.audit import flags

    g = load(spark, sf_dir)
    out = flags(best(g), truth(G.with_other_sighting(g)), 0.35, 0.1)
    return out.select(F.col("q").alias("vec_id"), "own_ref", "other_ref", r6("own"), r6("other"), "flag")


@query("""WITH RECURSIVE g AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
m AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-12 AS n FROM g), l AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.4),
r AS (SELECT id AS node, id AS reach FROM g UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach), c AS (SELECT node, min(reach) AS cluster FROM r GROUP BY node)
SELECT node AS vec_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c""")
def pair_links_components(spark, sf_dir):
    """Clusters of photos that may be one new individual: linked from 0.4 on."""
    from lynceus.operators.components import connected

    g = load(spark, sf_dir)
    links = G.score(g, g, "not_before", "over", 0.4).select(F.col("q").alias("a"), F.col("ref").alias("b"))
    c = connected(links, g.select(F.col("id").alias("node")))
    return c.select(F.col("node").alias("vec_id"), F.col("component").alias("cluster"), F.count(F.lit(1)).over(Window.partitionBy("component")).alias("size"))


#: The index over all sightings (``oth``) and, of the query's class, without its own sighting (``own``); ``{keep}`` says which rows stay.
INDEX = """, side AS (SELECT id, cls, grp, id % 2 AS side FROM m),
cand AS (SELECT side.cls, met.rgrp AS gone, side.grp, side.id, side.side, sightings - (strong > 0)::INT AS n, supp.total - met.total AS total FROM met JOIN side USING (id) JOIN supp USING (id)),
own AS (SELECT *, row_number() OVER (PARTITION BY cls, gone, side ORDER BY n DESC, round(total, 9) DESC, id) AS k, (min(grp) OVER w = max(grp) OVER w) AS single FROM cand WINDOW w AS (PARTITION BY cls, gone)),
oth AS (SELECT *, sightings AS n, row_number() OVER (PARTITION BY cls, id % 2 ORDER BY sightings DESC, round(total, 9) DESC, id) AS k, (min(grp) OVER w = max(grp) OVER w) AS single FROM supp WINDOW w AS (PARTITION BY cls)),
ok AS (SELECT p.q, p.qcls, p.cls, s FROM pairs p JOIN own ON own.cls = qcls AND own.gone = qgrp AND own.id = ref WHERE p.cls = qcls AND ({keep})
  UNION ALL SELECT p.q, p.qcls, p.cls, s FROM pairs p JOIN oth ON oth.id = ref WHERE p.cls <> qcls AND ({keep})),
b2 AS (SELECT q, qcls, cls, max(s) AS score FROM ok GROUP BY ALL), r2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cls) AS k FROM b2)
SELECT count(*) AS n, round(avg((cls = qcls)::INT), 6) AS top1 FROM r2 WHERE k = 1"""


def _not_chosen(q: dict, r: dict) -> np.ndarray:
    """References of other classes, and those that aren't chosen without the query's sighting, which are in ``gone``."""
    sightings, code = np.unique(q["grp"], return_inverse=True)
    lists = [np.asarray(x) for x in r["gone"]]
    row, value = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    at = np.minimum(np.searchsorted(sightings, value), len(sightings) - 1)
    met = sightings[at] == value
    member = np.zeros((len(sightings), len(lists)), bool)
    member[at[met], row[met]] = True
    return ~(member[code] & G.EXCLUSIONS["own_class"](q, r))


_not_chosen.own_class = True


def _accuracy_with_index(g: DataFrame, k: int | None) -> DataFrame:
    from lynceus.operators.audit import index_choice

    met, _ = support(g)
    general, own = index_choice(met, g.withColumn("side", F.col("id") % 2), k)
    queries = G.with_other_sighting(g)
    others = G.score(queries, g.join(general, "id", "left_semi"), "sighting", "class", 1).join(truth(g), "q").filter("cls <> true_cls")
    # A reference of the own class counts for the sightings without which it is chosen; a block leaves a row a query.
    chosen = g.join(own.groupBy("id").agg(F.collect_set("gone").alias("gone")), "id")
    mine = G.score(queries, chosen, _not_chosen, "class", 1).select("q", "cls", "score")
    top = G.top_classes(others.select("q", "cls", "score").unionByName(mine), 1).join(truth(g), "q")
    return top.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("cls") == F.col("true_cls")).cast("int")), 6).alias("top1"))


@query("WITH $BASE" + SUPPORT + INDEX.replace("{keep}", "k <= 3"))
def restricted_index_accuracy(spark, sf_dir):
    """Three photos of each class and side are the index; a query's own class is chosen anew without its sighting."""
    return _accuracy_with_index(load(spark, sf_dir), 3)


@query("WITH $BASE" + SUPPORT + INDEX.replace("{keep}", "n > 0 OR single"))
def supported_index_accuracy(spark, sf_dir):
    """All photos but those that no other sighting supports."""
    return _accuracy_with_index(load(spark, sf_dir), None)
