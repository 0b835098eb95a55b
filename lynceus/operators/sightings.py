"""Grouping photos into sightings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators.components import connected


def same_key(photos: DataFrame, *key: Column) -> DataFrame:
    """Edges from every photo to the first of its key; rows with a null in the key have none."""
    k = photos.select("id", F.struct(*key).alias("k")).filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in key]))
    first = k.groupBy("k").agg(F.min("id").alias("first"))
    return k.join(first, "k").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))


def sighting_groups(photos: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``(id, grp)`` with the smallest id of each sighting.

    ``photos(id, cls, encounter_id, encounter_date, file_date, filename, digest)``;
    ``duplicates(a, b)`` are pictures saved twice.  Photos join by class and encounter
    date; a photo without an encounter joins every photo of its class and file date;
    class and file name join, and so do equal bytes and duplicates, across classes
    too.  The relation is transitive; a photo with none of these is a group of its own.
    """
    c = F.col
    own = photos.filter(c("encounter_id").isNull() & c("file_date").isNotNull())
    days = own.groupBy("cls", "file_date").agg(F.min("id").alias("b"))
    by_file = photos.join(days, ["cls", "file_date"]).filter("id <> b").select(F.col("id").alias("a"), "b")
    edges = [
        same_key(photos, c("cls"), c("encounter_date")),
        by_file,
        same_key(photos, c("cls"), c("filename")),
        same_key(photos, c("digest")),
        duplicates.select("a", "b"),
    ]
    known = photos.select(F.col("id").alias("node"))
    both = reduce(DataFrame.unionAll, edges)
    both = both.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    return connected(both.select("a", "b"), known).select(F.col("node").alias("id"), F.col("component").alias("grp"))


def spread_dates(photos: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``(id, date)``: a photo without a date takes the earliest of its duplicates, one hop in either direction."""
    both = duplicates.select("a", "b").unionAll(duplicates.select(F.col("b").alias("a"), F.col("a").alias("b")))
    given = both.join(photos.select(F.col("id").alias("b"), F.col("date").alias("d")), "b").groupBy(F.col("a").alias("id")).agg(F.min("d").alias("d"))
    return photos.join(given, "id", "left").select("id", F.coalesce("date", "d").alias("date"))


def closest_comparable(photos: DataFrame) -> DataFrame:
    """For each photo another of its class: of its view and another date, else of its view, else any; of these the latest, then the smallest id.

    The answer is always among the two smallest ids of the two latest dates of the
    class and view, or the two latest photos of the class, so each photo meets six
    candidates at most, not its whole class.
    """
    group = ["cls", "view"]
    first = Window.partitionBy(*group, "date").orderBy("id")
    two = photos.withColumn("k", F.row_number().over(first)).filter("k <= 2")
    late = Window.partitionBy(*group).orderBy(F.desc_nulls_last("date"))
    of_view = two.withColumn("d", F.dense_rank().over(late)).filter("d <= 2")
    of_class = two.withColumn("d", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc_nulls_last("date"), "id"))).filter("d <= 2")
    met = lambda rows, on, view: photos.join(rows.select(*on, F.col("id").alias("other"), F.col("date").alias("od")), list(on)).filter("id <> other").select("id", "date", "other", "od", F.lit(view).alias("same"))
    both = met(of_view, ("cls", "view"), True).unionAll(met(of_class, ("cls",), False))
    apart = F.col("same") & F.coalesce(F.col("date") != F.col("od"), F.lit(False))
    best = F.max(F.struct("same", apart.alias("p"), F.coalesce(F.col("od"), F.lit("0001-01-01").cast("date")).alias("d"), (-F.col("other")).alias("o")))
    return both.groupBy("id").agg(best.alias("x")).select("id", (-F.col("x.o")).alias("other"))


def nearest_gap(encounters: DataFrame) -> DataFrame:
    """``(cls, day, years)``: years to the nearest other encounter of the class.

    The nearest day is the one before or behind in order, so no class is joined with itself.
    """
    by = Window.partitionBy("cls").orderBy("day")
    days = encounters.select("cls", "day").distinct()
    gap = F.least(F.datediff("day", F.lag("day").over(by)), F.datediff(F.lead("day").over(by), F.col("day")))
    return days.withColumn("years", gap / F.lit(365.0)).filter("years is not null")
