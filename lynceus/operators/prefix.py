"""Running sums over a whole table without a single task: ranges, one sum a range, sums within a range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.sources.scratch import cut


def running_before(rows: DataFrame, order: str, columns: list[str], keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``rows`` with ``before_<column>`` for each column: the sum over all rows that come earlier in ``order``, whose values are distinct.

    Rows are dealt to ranges of ``order`` and written once; each range has one row of
    sums, and only those (as many as there are partitions) are added up in one task.  ``keep``
    writes them, for callers whose tables go earlier than the process.
    """
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = keep(rows.repartitionByRange(int(parts), order).withColumn("part_", F.spark_partition_id()))
    sums = dealt.groupBy("part_").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part_", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"offset_{c}") for c in columns])
    within = Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({f"own_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).join(F.broadcast(offsets), "part_")
    return placed.select(*rows.columns, *[(F.col(f"own_{c}") + F.col(f"offset_{c}")).alias(f"before_{c}") for c in columns])
