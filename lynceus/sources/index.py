"""A reference gallery kept as an index: a table bucketed by block, so that searches don't move it.

The references are dealt to blocks once, when the index is written.  A search sends its
queries to the blocks; each block of references is read where its bucket lies, without an
exchange, and reduced as in :mod:`lynceus.operators.gallery`.  What a search may not see
(or is to see alone) is a mask of ids, which goes to the blocks as the queries do, so one
index serves every selection of its references.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators import gallery as G

#: References of a block, and queries that are sent to the blocks at a time.
BLOCK, QUERIES = 8192, 65536
#: Blocks a core that are enough to keep all cores busy.
BUCKETS = 2

_QUERY, _MASK = 0, 1


def _block(blocks: int):
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def write_index(refs: DataFrame, table: str, block: int = BLOCK, path: str | None = None) -> int:
    """Write ``refs(id, cls, grp, v)`` as a table, a bucket a block, in the warehouse or in ``path``; returns the number of blocks, which the table's properties tell too.

    A block has ``block`` rows or more: a query goes to each block, so there are no more
    than ``BUCKETS`` a core until blocks are as large as a gallery's.
    """
    n = refs.count()
    block = max(block, min(BLOCK, -(-n // (BUCKETS * refs.sparkSession.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n // block))
    dealt = refs.select(F.col("id").cast("long").alias("id"), F.col("cls").cast("int").alias("cls"), F.col("grp").cast("long").alias("grp"), "v").withColumn("rb", _block(blocks))
    writer = dealt.repartition(blocks, "rb").write.mode("overwrite").format("parquet").bucketBy(blocks, "rb").sortBy("rb")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    refs.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('lynceus.blocks' = '{blocks}')")
    return blocks


def blocks_of(spark: SparkSession, table: str) -> int:
    return int(next(r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r.key == "lynceus.blocks"))


def search(table: str, queries: DataFrame, exclude: str | Callable = "sighting", keep: str = "class", k: float = 1, without: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """``(q, cls, ref, score)`` as :func:`gallery.score` of the index's references, but those of ``without(id)``, or none but those of ``only(id)``."""
    if without is not None and only is not None:
        raise ValueError("a mask leaves ids out or names those that stay")
    spark = queries.sparkSession
    blocks, mask = blocks_of(spark, table), without if without is not None else only
    masked, stay = mask is not None, only is not None
    rule, kept = G.EXCLUSIONS[exclude] if isinstance(exclude, str) else exclude, G.REDUCTIONS[keep]
    right = spark.table(table).select("rb", *[F.col(c).alias("r_" + c) for c in ("id", "cls", "grp", "v")])
    parts = max(1, -(-queries.count() // QUERIES))
    schema = pa.schema([("q", pa.int64()), ("cls", pa.int32()), ("ref", pa.int64()), ("score", pa.float64())])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        is_query = a.column("kind").to_numpy() == _QUERY
        b = b.rename_columns([c.removeprefix("r_") for c in b.column_names]).drop_columns(["rb"])
        if masked:
            listed = np.isin(b.column("id").to_numpy(), a.column("id").to_numpy()[~is_query])
            b = b.filter(pa.array(listed if stay else ~listed))
        a = a.filter(pa.array(is_query)).drop_columns(["rb", "kind"])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        return G.block_of(a, b, rule, lambda s, q, r: kept(s, q, r, k), schema)

    # Single precision stays so on its way; products are in double.
    vector = queries.schema["v"].dataType if queries.schema["v"].dataType.elementType.typeName() == "float" else "array<double>"
    found = []
    for part in range(parts):
        asked = queries.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)) == part) if parts > 1 else queries
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb")
        left = asked.select(every, F.lit(_QUERY).alias("kind"), F.col("id").cast("long").alias("id"), F.col("cls").cast("int").alias("cls"), F.col("grp").cast("long").alias("grp"), F.col("v").cast(vector).alias("v"))
        if masked:
            empty = [F.lit(None).cast(t).alias(c) for c, t in (("cls", "int"), ("grp", "long"), ("v", vector))]
            left = left.unionAll(mask.select(_block(blocks).alias("rb"), F.lit(_MASK).alias("kind"), F.col("id").cast("long").alias("id"), *empty))
        found.append(left.groupBy("rb").cogroup(right.groupBy("rb")).applyInArrow(cell, "q long, cls int, ref long, score double"))
    out = reduce(DataFrame.unionAll, found)
    if keep == "over" or blocks == 1:
        return out
    by = Window.partitionBy(*(("q", "cls") if keep == "class" else ("q",))).orderBy(F.desc("score"), "ref")
    return out.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).drop("n")
