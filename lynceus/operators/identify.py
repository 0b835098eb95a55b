"""Decisions on photos and sets: what a front end asks for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.decisions import band, likelihood
from lynceus.operators import gallery as G


def identify(spot: DataFrame, emb: DataFrame, cutoff: float, weight: float = 1.0, photos: DataFrame | None = None) -> DataFrame:
    """One row a query: the best fused class, its score, its spot score with band and likelihood, the top five, and whether the individual is likely new.

    ``spot`` and ``emb`` are ``(q, cls, score)``, best of each class.  The likely-new
    flag compares the best unrounded similarity with a calibrated cut-off.  Where a query
    stands for several photos, ``photos(q, n)`` tells how many.
    """
    five = G.top_classes(G.fuse(spot, emb, weight), 5)
    top = five.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cls", "score"))), lambda x: F.struct(x.cls, x.score)).alias("top"))
    best = emb.groupBy("q").agg(F.max("score").alias("sim"))
    s = spot.select(F.col("q").alias("sq"), F.col("cls").alias("sc"), F.col("score").alias("spot"))
    out = top.select("q", F.col("top")[0]["cls"].alias("pick"), F.col("top")[0]["score"].alias("score"), "top").join(best, "q", "left")
    out = out.join(s, (F.col("q") == F.col("sq")) & (F.col("pick") == F.col("sc")), "left").withColumn("spot", F.coalesce("spot", F.lit(0.0)))
    n = None
    if photos is not None:
        out, n = out.join(photos.select("q", F.col("n").alias("photos_")), "q", "left"), F.coalesce("photos_", F.lit(1))
    return out.select("q", "pick", "score", "spot", band(F.col("spot"), n).alias("band"), likelihood(F.col("spot"), n).alias("likelihood"), (F.coalesce("sim", F.lit(-1.0)) < cutoff).alias("likely_new"), "top")


def decide(scores: dict[str, tuple[DataFrame, float | None]], similarity: DataFrame, cutoff: float, asked: Callable[[Column], Column] | None = None, best: str = "best") -> DataFrame:
    """``(method, q, pick, five, likely_new)``: what each method says of each photo.

    ``scores`` has each method's ``(q, cls, score)`` and the least score of a known
    individual; a method without one is judged by the best similarity against ``cutoff``.
    ``asked`` makes an outside order of the ``best`` method's five, which is a method of
    its own, ``asked``, judged like it.  A photo that a method has no score for has no row.
    """
    new = similarity.groupBy("q").agg((F.max("score") < cutoff).alias("new"))
    parts = []
    for name, (rows, least) in scores.items():
        five = G.top_classes(rows, 5).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "cls"))).alias("x"), F.max("score").alias("top"))
        five = five.join(new, "q").select("q", F.transform("x", lambda r: r.cls).alias("five"), F.col("new") if least is None else (F.col("top") < least).alias("new"))
        parts.append(five.select(F.lit(name).alias("method"), "q", F.get("five", 0).alias("pick"), "five", F.col("new").alias("likely_new")))
        if name == best and asked is not None:
            order = five.withColumn("five", merge_answer(asked(F.col("five")), F.col("five")))
            parts.append(order.select(F.lit("asked").alias("method"), "q", F.get("five", 0).alias("pick"), "five", F.col("new").alias("likely_new")))
    return reduce(DataFrame.unionAll, parts)


def recheck(refs: DataFrame, picks: DataFrame) -> DataFrame:
    """The spot score of a pick from elsewhere: the best reference of that class, 0 without one."""
    best = refs.join(picks, "q").filter(F.col("cls") == F.col("pick")).groupBy("q").agg(F.max("score").alias("spot"))
    return picks.join(best, "q", "left").withColumn("spot", F.coalesce("spot", F.lit(0.0)))


def merge_answer(answer: Column, base: Column) -> Column:
    """An outside order of names, without repeats, then the names it left out in their own order; names that aren't in the base are dropped."""
    known = F.filter(F.array_distinct(answer), lambda x: F.array_contains(base, x))
    return F.concat(known, F.array_except(base, known))


def combine_with_floor(ranked: DataFrame, photos: DataFrame, k: int = 5) -> DataFrame:
    """Sets from logged top lists: a name outside a photo's list takes that photo's last listed score.

    ``ranked(q, rank, cls, score)`` and ``photos(q, grp)``; returns ``(grp, cls, score)``.
    The sum over photos is the sum of floors plus what listed names have above them, so
    names and photos are never multiplied out.
    """
    r = ranked.filter(F.col("rank") <= k).join(photos, "q")
    floor = r.groupBy("grp", "q").agg(F.min("score").alias("floor"))
    base = floor.groupBy("grp").agg(F.sum("floor").alias("base"))
    above = r.join(floor.select("q", "floor"), "q").groupBy("grp", "cls").agg(F.sum(F.col("score") - F.col("floor")).alias("above"))
    return above.join(base, "grp").select("grp", "cls", (F.col("above") + F.col("base")).alias("score"))


def sort_plan(files: DataFrame, found: Column) -> DataFrame:
    """``(name, folder, reason, twin)`` for files in name order: byte-equal to an earlier file, without a subject, or kept.

    ``files(name, digest, seq)``; originals come before copies in ``seq``.
    """
    first = files.groupBy("digest").agg(F.min(F.struct("seq", "name")).alias("f")).select(F.col("digest").alias("d"), F.col("f.name").alias("first"))
    folder = F.when(F.col("first") != F.col("name"), "duplicates").when(~found, "no_turtle").otherwise("turtles")
    rows = files.join(first, F.col("digest") == F.col("d")).withColumn("folder", folder)
    reason = F.when(F.col("folder") == "duplicates", F.concat(F.lit("same as "), "first")).when(F.col("folder") == "no_turtle", "nothing found").otherwise("")
    return rows.select("name", "folder", reason.alias("reason"))


def sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """A seeded sample: the n rows with the smallest hash; a sampling operator, so the limit is its purpose."""
    return rows.orderBy(key).limit(n)


def info(gallery: DataFrame, log: DataFrame) -> DataFrame:
    """What a front page shows: references, classes, uploads, and the last verdict's counts."""
    g = gallery.agg(F.count(F.lit(1)).alias("photos"), F.countDistinct("cls").alias("classes"))
    u = log.agg(F.countDistinct("upload_id").alias("uploads"), F.count_if(F.col("verdict").isNotNull()).alias("verdicts"))
    return g.crossJoin(u)


#: How photos of a set make one score for each class.
COMBINERS = ("sum", "sides", "best spot, mean vector", "sum of spots, best vector", "vote")


def combine(photos: DataFrame, how: str = "sum") -> DataFrame:
    """``(grp, cls, score)`` from ``photos(q, grp, side, cls, spot, emb)``, one row a photo and class.

    ``sum`` adds the fused scores; ``sides`` adds those of side views, or of all photos
    where a set has none; the next two take the best of one kind of evidence and the mean,
    or the sum over photos, of the other; in a ``vote`` each photo gives its best class one
    and a thousandth of that score, and a millionth of all scores breaks ties.
    """
    fused = F.log1p(F.greatest("spot", F.lit(0.0))) + F.col("emb")
    rows = photos.withColumn("f", fused)
    by = rows.groupBy("grp", "cls")
    if how == "sum":
        return by.agg(F.sum("f").alias("score"))
    if how == "sides":
        has = rows.groupBy("grp").agg(F.max("side").alias("any_side"))
        own = rows.join(has, "grp").filter(F.col("side") | ~F.col("any_side"))
        return own.groupBy("grp", "cls").agg(F.sum("f").alias("score"))
    if how == "best spot, mean vector":
        return by.agg((F.log1p(F.greatest(F.max("spot"), F.lit(0.0))) + F.avg("emb")).alias("score"))
    if how == "sum of spots, best vector":
        return by.agg((F.sum(F.log1p(F.greatest("spot", F.lit(0.0)))) + F.max("emb")).alias("score"))
    if how == "vote":
        best = rows.groupBy("q").agg(F.max(F.struct("f", (-F.col("cls")).alias("c"))).alias("b")).select("q", (-F.col("b.c")).alias("top"))
        given = F.when(F.col("cls") == F.col("top"), 1 + F.col("f") * 1e-3).otherwise(0.0)
        return rows.join(best, "q").groupBy("grp", "cls").agg((F.sum(given) + F.sum("f") * 1e-6).alias("score"))
    raise ValueError(f"one of {COMBINERS}")
