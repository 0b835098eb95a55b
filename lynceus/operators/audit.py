"""Label audits and reference support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators.manifest import adjacency


def support_of(met: DataFrame, gallery: DataFrame) -> DataFrame:
    """``(id, cls, grp, sightings, total)`` from ``met(id, rgrp, strong, total)``: distinct other sightings of the class with a strong match, and the sum of all matches with other sightings, weak ones too."""
    per = met.groupBy("id").agg(F.count_if(F.col("strong") > 0).alias("sightings"), F.sum("total").alias("total"))
    out = gallery.select("id", "cls", "grp").join(per, "id", "left")
    return out.select("id", "cls", "grp", F.coalesce("sightings", F.lit(0)).alias("sightings"), F.coalesce("total", F.lit(0.0)).alias("total"))


def without_sighting(met: DataFrame, support: DataFrame) -> DataFrame:
    """``(id, cls, grp, gone, sightings, total)``: what is left of a photo's support without each other sighting of its class, by subtraction."""
    gone = met.select("id", F.col("rgrp").alias("gone"), (F.col("strong") > 0).cast("int").alias("s"), F.col("total").alias("t"))
    return support.join(gone, "id").select("id", "cls", "grp", "gone", (F.col("sightings") - F.col("s")).alias("sightings"), (F.col("total") - F.col("t")).alias("total"))


def two_tier(top: DataFrame, queries: DataFrame, met: DataFrame, support: DataFrame, match: float, check: float) -> DataFrame:
    """``top(q, cls, ref, score)`` with its band; a match becomes a check if no other sighting supports the best reference.

    A query's own sighting, ``queries(q, true_cls, grp)``, doesn't count as support of a
    reference of its own class.
    """
    known = support.select(F.col("id").alias("ref"), "sightings")
    mine = met.filter(F.col("strong") > 0).select(F.col("id").alias("ref"), F.col("rgrp").alias("grp"), F.lit(1).alias("mine"))
    rows = top.join(queries.select("q", "true_cls", "grp"), "q").join(known, "ref").join(mine, ["ref", "grp"], "left")
    left = F.col("sightings") - F.when(F.col("cls") == F.col("true_cls"), F.coalesce("mine", F.lit(0))).otherwise(0)
    band = F.when(F.col("score") < check, "possibly new").when((F.col("score") < match) | (left < 1), "check").otherwise("match")
    return rows.select(*top.columns, left.alias("support"), band.alias("band"))


def flags(best: DataFrame, truth: DataFrame, misfiled: float, unmatched: float, duplicates: DataFrame | None = None, photos: DataFrame | None = None) -> DataFrame:
    """Best of the own and of other classes with their references (smaller id on ties), and what they say about the label.

    ``duplicates(a, b)`` are pairs of the same picture: they don't count as each other's
    reference, and a column ``duplicate`` marks their rows.  ``best`` must then hold more
    references of a class than a row has duplicates.  With ``photos(id, cls, view, date,
    side)`` only a side view can be 'no match', and only if its class has the same view
    on another date, a duplicate's aside.
    """
    if duplicates is not None:
        twins = adjacency(duplicates, "a", "b").withColumnsRenamed({"a": "q", "b": "ref"})
        best = best.join(twins, ["q", "ref"], "left_anti")
    own = F.col("cls") == F.col("true_cls")
    pick = lambda cond: F.max(F.when(cond, F.struct("score", (-F.col("ref")).alias("r"))))
    rows = best.join(truth, "q").groupBy("q").agg(pick(own).alias("o"), pick(~own).alias("x"))
    rows = truth.select("q").join(rows, "q", "left")
    comparable = F.lit(True)
    if photos is not None:
        # Photos of the class and view on another date: all of them less those of the own date, duplicates on other dates taken off.
        days = photos.filter("date is not null").groupBy("cls", "view", "date").agg(F.count(F.lit(1)).alias("own_day"))
        every = days.groupBy("cls", "view").agg(F.sum("own_day").alias("every"))
        side = photos.filter("side").select(F.col("id").alias("q"), "cls", "view", "date")
        same = side.join(every, ["cls", "view"]).join(days, ["cls", "view", "date"]).select("q", (F.col("every") - F.col("own_day")).alias("n"))
        if duplicates is not None:
            other = photos.select(F.col("id").alias("ref"), F.col("cls").alias("c"), F.col("view").alias("w"), F.col("date").alias("d"))
            off = side.join(twins, "q").join(other, "ref").filter("cls = c and view = w and date <> d").groupBy("q").agg(F.count(F.lit(1)).alias("off"))
            same = same.join(off, "q", "left").withColumn("n", F.col("n") - F.coalesce("off", F.lit(0)))
        rows = rows.join(same.filter("n > 0").select("q", F.lit(True).alias("comparable")), "q", "left")
        comparable = F.col("comparable").isNotNull()
    none = F.lit(-1.0)
    flag = (
        F.when((F.col("x.score") >= misfiled) & (F.col("x.score") > F.coalesce("o.score", none)), "misfiled")
        .when((F.coalesce("o.score", none) < unmatched) & comparable, "no match")
        .otherwise("")
    )
    out = ["q", (-F.col("o.r")).alias("own_ref"), (-F.col("x.r")).alias("other_ref"), F.col("o.score").alias("own"), F.col("x.score").alias("other"), flag.alias("flag")]
    if duplicates is not None:
        rows = rows.join(twins.select("q").distinct().withColumn("twin", F.lit(True)), "q", "left")
        out.append(F.col("twin").isNotNull().alias("duplicate"))
    return rows.select(*out)


def _kept(rows: DataFrame, by: list[str], k: int | None, of_class: list[str]) -> DataFrame:
    """The k best supported of each class and side; or, without k, all that another sighting supports and all of classes with one sighting."""
    if k is not None:
        order = Window.partitionBy(*by, "side").orderBy(F.desc("sightings"), F.desc(F.round("total", 9)), "id")
        return rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k)
    single = rows.groupBy(*of_class).agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo = hi").select(*of_class, F.lit(True).alias("single"))
    return rows.join(single, of_class, "left").filter((F.col("sightings") > 0) | F.coalesce("single", F.lit(False)))


def index_choice(met: DataFrame, gallery: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
    """The references of an index: chosen over all sightings ``(id)``, and chosen anew for a class without each of its sightings ``(cls, gone, id)``.

    ``k`` of each class and side by support, or all but unsupported ones where ``k`` is
    None.  ``gallery(id, cls, grp, side)``; ``met`` as in :func:`support_of`.
    """
    support, side = support_of(met, gallery), gallery.select("id", "side")
    general = _kept(support.join(side, "id"), ["cls"], k, ["cls"]).select("id")
    left = without_sighting(met, support).join(side, "id")
    return general, _kept(left, ["cls", "gone"], k, ["cls", "gone"]).select("cls", "gone", "id")
