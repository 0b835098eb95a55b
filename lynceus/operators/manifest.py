"""Manifests: filters, splits, resuming and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.functions.decisions import share_count
from lynceus.operators.prefix import running_before


def keep_large_classes(rows: DataFrame, cls: str, least: int) -> DataFrame:
    """Rows whose class has ``least`` rows: a combined count and a semi join, so that a large class isn't one window."""
    large = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return rows.join(large, cls, "left_semi")


def split_counts(rows: DataFrame, cls: str, share: float = 0.15) -> DataFrame:
    """``(cls, n, train, valid, test)``: at least one row each for valid and test, half-even shares."""
    per = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    part = share_count(F.col("n"), share)
    return per.select(cls, "n", (F.col("n") - 2 * part).cast("int").alias("train"), part.alias("valid"), part.alias("test"))


#: Rows that share a bucket of a class in :func:`assign_splits`, as the mean.
BUCKET = 4096


def assign_splits(rows: DataFrame, cls: str, digest: Column, tie: Column, share: float = 0.15) -> DataFrame:
    """Rows with ``split``: the first of each class in the order of ``digest`` (a seeded hash in hex digits) and ``tie`` are test, the next valid, the rest train.

    A class is cut into buckets by the leading digits of the hash; bucket counts give the
    place of a bucket's first row, so no task sorts a class.
    """
    part = split_counts(rows, cls, share).select(F.col(cls).alias("c"), F.col("test").alias("part"), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).alias("buckets"))
    lead = F.conv(F.substring("digest_", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    dealt = rows.withColumn("digest_", digest).withColumn("tie_", tie).join(part, F.col(cls).eqNullSafe(F.col("c"))).withColumn("bucket", F.floor(lead * F.col("buckets")))
    counts = dealt.groupBy("c", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("c").alias("c_"), F.col("bucket").alias("bucket_"), before.alias("start"))
    placed = dealt.join(starts, F.col("c").eqNullSafe(F.col("c_")) & (F.col("bucket") == F.col("bucket_")))
    place = F.col("start") + F.row_number().over(Window.partitionBy("c", "bucket").orderBy("digest_", "tie_"))
    placed = placed.withColumn("place", place)
    split = F.when(F.col("place") <= F.col("part"), "test").when(F.col("place") <= 2 * F.col("part"), "valid").otherwise("train")
    return placed.select(*rows.columns, split.alias("split"))


def not_done(rows: DataFrame, done: DataFrame, *on: str) -> DataFrame:
    """Resuming: rows whose key isn't among the done ones."""
    return rows.join(done.select(*on), list(on), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, stale: tuple[str, ...] = ()) -> DataFrame:
    """Insert new keys and replace rows whose ``version`` changed; ``stale`` columns of replaced rows become null, as they describe the old content."""
    n = new.select([F.col(c).alias("n_" + c) for c in new.columns])
    both = old.join(n, F.col(key) == F.col("n_" + key), "full")
    fresh = F.col("n_" + key).isNotNull() & (F.col(key).isNull() | ~F.col(version).eqNullSafe(F.col("n_" + version)))
    value = lambda c: F.when(fresh, F.lit(None) if c in stale else F.col("n_" + c) if c in new.columns else F.lit(None)).otherwise(F.col(c))
    return both.select([value(c).alias(c) for c in old.columns])


def insert_or_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of ``new`` replace those of ``old``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def update_where(old: DataFrame, values: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Set columns where ``values`` has the key."""
    v = values.select(F.col(key).alias("k_"), *[F.col(c).alias("v_" + c) for c in columns])
    hit = F.col("k_").isNotNull()
    return old.join(v, F.col(key) == F.col("k_"), "left").select([F.when(hit, F.col("v_" + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def misaligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Integrity: keys that only one of two tables holds, with the side."""
    a, b = left.select(F.col(key).alias("a")), right.select(F.col(key).alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").filter("a is null or b is null").select(F.coalesce("a", "b").alias(key), F.when(F.col("a").isNull(), "right").otherwise("left").alias("side"))


def encode_labels(rows: DataFrame, cls: str) -> DataFrame:
    """``(cls, code)``: the place of each class among the sorted distinct ones, from 0, as a running count over ranges of classes."""
    each = running_before(rows.select(cls).distinct().withColumn("one", F.lit(1)), cls, ["one"])
    return each.select(cls, F.col("before_one").cast("int").alias("code"))


def seen_in(rows: DataFrame, train: DataFrame, cls: str) -> DataFrame:
    """Rows whose class the training rows have."""
    return rows.join(train.select(cls).distinct(), cls, "left_semi")


def adjacency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each pair, once."""
    return pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).unionAll(pairs.select(F.col(b), F.col(a))).distinct()
