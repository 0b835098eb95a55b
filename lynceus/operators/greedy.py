"""Ordered near-duplicate pictures by Hamming distance.

An item is a twin of the first kept item before it within the distance; only kept
items count, so the relation isn't transitive and the order matters.

Equal prints are settled by their first.  The others are taken in ranges of the order
that double in size: a range is compared with what earlier ones kept, which leaves a row
an item, and only items that are near none of it are linked with each other and resolved
in rounds, in which an item is decided when all linked items before it are.  Prints are
compared in a grid of blocks by their bits: pieces of a few bits part nothing where many
pictures look alike, and links of all with all would be rows by the square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lynceus.operators.gallery import block_rows
from lynceus.sources.scratch import cut

DISTANCE = 10
#: Prints of the first range, and pairs of prints that a task compares at a time.
FIRST, PAIRS = 8192, 1 << 18


def _grid(prints: DataFrame, old: DataFrame, distance: int, reduce: Callable, schema: str) -> DataFrame:
    """``reduce(near, q, r)`` over a grid of blocks of ``prints(id, h)`` and ``old(batch, order, h)``: ``near`` marks the pairs within the distance of some prints and all old ones of a block, these in their order."""
    n, m = prints.count(), old.count()
    block = block_rows(n, m, 1, prints.sparkSession.sparkContext.defaultParallelism)
    nq, nr = max(1, -(-n // block)), max(1, -(-m // block))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = prints.select("id", "h", place("id", nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    right = old.select("batch", "order", F.col("h").alias("r_h"), place("order", nr).alias("r_rb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("r_qb"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    words = lambda c: c.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(c), -1).T

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        r = {c: b.column(c).to_numpy() for c in ("batch", "order")}
        first = np.lexsort((r["order"], r["batch"]))
        r = {c: x[first] for c, x in r.items()}
        own, theirs, ids = words(a.column("h")), np.ascontiguousarray(words(b.column("r_h"))[:, first]), a.column("id").to_numpy()
        parts, step = [], max(1, PAIRS // b.num_rows)
        for i in range(0, a.num_rows, step):
            gap = np.zeros((len(ids[i : i + step]), b.num_rows), np.uint16)
            for x, y in zip(own[:, i : i + step], theirs, strict=True):
                gap += np.bitwise_count(x[:, None] ^ y[None])
            parts.append(reduce(gap <= distance, ids[i : i + step], r).cast(arrow))
        return pa.concat_tables(parts)

    return left.groupBy("qb", "rb").cogroup(right.groupBy("r_qb", "r_rb")).applyInArrow(run, schema)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)`` with a before b, for ``prints(id, h array<long>)`` within the distance."""

    def pairs(near: np.ndarray, q: np.ndarray, r: dict) -> pa.Table:
        i, j = np.nonzero(near & (r["order"][None] < q[:, None]))
        return pa.table({"a": r["order"][j], "b": q[i]})

    return _grid(prints, prints.select(F.lit(0).alias("batch"), F.col("id").alias("order"), "h"), distance, pairs, "a long, b long")


def near_old(prints: DataFrame, old: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(id, order)`` for prints within the distance of one of ``old(order, h)``, the first of these; where old ones have a ``batch``, it goes before their order."""

    def first(near: np.ndarray, q: np.ndarray, r: dict) -> pa.Table:
        j = near.argmax(1)
        i = np.flatnonzero(near[np.arange(len(j)), j])
        return pa.table({"id": q[i], "batch": r["batch"][j[i]], "order": r["order"][j[i]]})

    old = old.select(F.col("batch").cast("long").alias("batch") if "batch" in old.columns else F.lit(0).cast("long").alias("batch"), "order", "h")
    met = _grid(prints, old, distance, first, "id long, batch long, `order` long")
    return met.groupBy("id").agg(F.min(F.struct("batch", "order")).alias("x")).select("id", F.col("x.order").alias("order"))


def _in_rounds(prints: DataFrame, distance: int) -> DataFrame:
    """:func:`first_kept` from all links of few prints."""
    e = cut(links(prints, distance))
    kept = cut(prints.select("id").join(e.select(F.col("b").alias("id")), "id", "left_anti"))
    dropped = None
    while True:
        # Twins of what is kept are dropped; items all of whose earlier links are dropped are kept.
        dropped = cut(e.join(kept.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min("a").alias("twin")))
        open_ = e.join(dropped.select("b"), "b", "left_anti").join(kept.withColumnRenamed("id", "b"), "b", "left_anti")
        live = open_.join(dropped.select(F.col("b").alias("a")), "a", "left_anti")
        new = cut(open_.select(F.col("b").alias("id")).distinct().join(live.select(F.col("b").alias("id")), "id", "left_anti"))
        if new.isEmpty():
            break
        kept = cut(kept.unionAll(new))
    return prints.select("id").join(dropped.withColumnRenamed("b", "id"), "id", "left")


def first_kept(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(id, twin)`` for ``prints(id, h array<long>)``: null for kept items, else the first kept item before within the distance; a null print is nobody's twin."""
    prints = cut(prints.select("id", "h"))
    own = cut(prints.filter("h is not null").groupBy("h").agg(F.min("id").alias("id")).select("id", "h"))
    n, size, ends = own.count(), FIRST, []
    while size < n:
        ends.append(size / n)
        size *= 2
    ends = own.agg(F.percentile_approx("id", F.array(*[F.lit(x) for x in ends]), F.lit(10000)).alias("x")).first().x if ends else []
    decided = kept = None
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = own.filter((F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high))
        twins = None
        if kept is not None:
            twins = cut(near_old(part, kept.withColumnRenamed("id", "order"), distance).withColumnRenamed("order", "twin"))
            part = part.join(twins, "id", "left_anti")
        part = cut(part)
        found = cut(_in_rounds(part, distance))
        new = part.join(found.filter("twin is null"), "id", "left_semi")
        kept = cut(new if kept is None else kept.unionAll(new))
        found = found if twins is None else found.unionByName(twins)
        decided = found if decided is None else decided.unionByName(found)
    first = own.select(F.col("h").alias("o_h"), F.col("id").alias("first")).join(decided.withColumnRenamed("id", "first"), "first")
    both = prints.join(first, F.col("h") == F.col("o_h"), "left")
    return both.select("id", F.when(F.col("id") == F.col("first"), F.col("twin")).otherwise(F.coalesce("twin", "first")).alias("twin"))
