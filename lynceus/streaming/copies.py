"""Near copies among pictures that arrive in a stream.

A picture is a copy of the first kept picture before it within the distance; only kept
ones count.  The order is that of arrival: micro-batches one after the other, rows of one
by their number.  A micro-batch is decided in two steps: first against what earlier ones
kept, then in itself, in rounds (:func:`lynceus.operators.greedy.first_kept`).

What is kept lies in a folder for each micro-batch, with a row a picture.  A micro-batch
is compared with them in blocks (:func:`lynceus.operators.greedy.near_old`) and adds a
folder for itself; a batch that is run again writes the same folder again, so a restart
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lynceus.operators.greedy import DISTANCE, first_kept, near_old
from lynceus.sources.scratch import cut
from lynceus.sources.tables import exists


def keep_first(prints: DataFrame, target: str, checkpoint: str, distance: int = DISTANCE) -> StreamingQuery:
    """Decide each of a stream of ``prints(id, h array<long>)``: ``target/decided`` gets ``(id, twin)``, null for kept ones.

    Ids are distinct.  A null print can't be compared: it is kept and no copy of it is found.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.select("id", "h"))
        sound = rows.filter("h is not null")
        twins = spark.createDataFrame([], "id long, twin long")
        if number and exists(spark, f"{target}/index"):
            index = spark.read.parquet(f"{target}/index").filter(F.col("batch") < number)
            twins = cut(near_old(sound, index.select("batch", F.col("id").alias("order"), "h"), distance).withColumnRenamed("order", "twin"))
        fresh = cut(first_kept(sound.join(twins, "id", "left_anti"), distance))
        kept = sound.join(fresh.filter("twin is null").select("id"), "id", "left_semi")
        kept.write.mode("overwrite").parquet(f"{target}/index/batch={number}")
        decided = fresh.unionByName(twins).unionByName(rows.filter("h is null").select("id", F.lit(None).cast("long").alias("twin")))
        decided.write.mode("overwrite").parquet(f"{target}/decided/batch={number}")

    return prints.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark: SparkSession, target: str) -> DataFrame:
    """``(id, twin)`` of all pictures seen."""
    return spark.read.parquet(f"{target}/decided").select("id", "twin")
