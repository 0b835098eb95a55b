"""State by key in Spark's state store: one value a key, changed where a micro-batch has rows of the key.

A micro-batch costs what it holds, not what is kept: the store reads and writes the
values of the keys that come up, and its changes are what the checkpoint gets.  What is
kept is read back from the checkpoint as a table.  Before rows are shuffled to their key
each Arrow batch is combined, so a key that most of the log shares is a row a batch.

The values live in the RocksDB store, which spills to disk and is restored from the
checkpoint on whichever executor runs the partition next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of the value in the store.
VALUE = "kept"

#: What is kept of a key: from the kept value (None at first) and a row, each the fields of the state, to the new value.
Merge = Callable[[tuple | None, tuple], tuple]


class Keep(StatefulProcessor):
    """Holds one value a key and gives back the key's value where it changed."""

    def __init__(self, keys: list[str], state: StructType, merge: Merge):
        self.keys, self.schema, self.merge = keys, state, merge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState(VALUE, self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = tuple(self.value.get()) if self.value.exists() else None
        new = old
        for row in rows:
            new = self.merge(new, tuple(row[n] for n in self.schema.names))
        if new != old:
            self.value.update(new)
            yield Row(**dict(zip((*self.keys, *self.schema.names), (*key, *new), strict=True)))

    def close(self) -> None:
        pass


def keep(rows: DataFrame, keys: list[str], state: str, merge: Merge) -> DataFrame:
    """``(*keys, *state)`` of the keys that a micro-batch changed; ``state`` names the fields of a row and of the value, with their types."""
    fields = StructType.fromDDL(state)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.fields)])
    return rows.select(*keys, *fields.names).groupBy(*keys).transformWithState(Keep(keys, fields, merge), out, "Update", "None")


def start(changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run to the end of what is there now; the state is in the checkpoint, where the next start goes on from."""
    conf = changes.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)  # the query takes the setting with it when it starts
    try:
        return changes.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


#: What Spark's own aggregates call the counts and sums that they keep, and what they are called here.
SUMS = {"count": "n", "sum": "total"}


def kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(*keys, *state)`` as of the last finished micro-batch; of a streaming ``groupBy`` the counts and sums of :data:`SUMS`."""
    if not spark.read.format("state-metadata").load(checkpoint).filter("operatorName = 'stateStoreSave'").isEmpty():
        return spark.read.format("statestore").load(checkpoint).select("key.*", "value.*").withColumnsRenamed(SUMS)
    return spark.read.format("statestore").option("stateVarName", VALUE).load(checkpoint).select("key.*", "value.*")


def _last_of_batch(keys: list[str], order: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).sort_by([(order, "ascending")])
                at = t.select(keys).append_column("at", pa.array(range(t.num_rows))).group_by(keys).aggregate([("at", "max")]).column("at_max")
                yield from t.take(at).combine_chunks().to_batches()

    return run


def last_of_batch(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in each Arrow batch: what is left for the shuffle of rows of which the last wins."""
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_last_of_batch(keys, order), named)


def later(order: int) -> Merge:
    """The row with the larger number at place ``order``; a row that comes again changes nothing."""

    def merge(old: tuple | None, new: tuple) -> tuple:
        return new if old is None or new[order] > old[order] else old

    return merge


def added(old: tuple | None, new: tuple) -> tuple:
    """Sums field by field; a null adds nothing."""
    return new if old is None else tuple(b if a is None else a if b is None else a + b for a, b in zip(old, new, strict=True))


def _sums_of_batch(keys: list[str], sums: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).group_by(keys).aggregate([(c, "sum") for c in sums])
                yield from t.rename_columns([c.removesuffix("_sum") if c not in keys else c for c in t.column_names]).select([*keys, *sums]).combine_chunks().to_batches()

    return run


def sums_of_batch(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """A row for each key in each Arrow batch, with the sums of its columns: what is left for the shuffle of rows that are added up."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*keys, *sums).mapInArrow(_sums_of_batch(keys, sums), ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *sums]))
