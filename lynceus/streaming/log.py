"""The append-only log as a stream.

The log is a file source; what is kept of it is a value a key in the state store (see
:mod:`lynceus.streaming.keyed`), read back from the checkpoint as a table.  Feedback may
come late without bound and the last row in append order wins, so no watermark drops
anything.  Distinct users are exact: the summary's state has a row for each day, kind and
user, and the summary is an aggregate of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lynceus.operators.session import last_wins
from lynceus.streaming import keyed


def _per_user(log: DataFrame) -> DataFrame:
    rows = log.select(F.to_date("ts").alias("day"), "event_type", "user_id", "value")  # a stream's state has the names of plain columns
    return rows.groupBy("day", "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def summary_of(state: DataFrame) -> DataFrame:
    """A tumbling day of events, by kind, from a row for each user: rows, users, total."""
    return state.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"), F.round(F.sum("total"), 4).alias("total"))


def daily_summary(log: DataFrame) -> DataFrame:
    """The summary of a log that is at rest; :func:`keep_summary` keeps the same of one that grows."""
    return summary_of(_per_user(log))


def read_log(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _fields(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def keep_last(log: DataFrame, checkpoint: str, keys: list[str], order: str, values: list[str]) -> StreamingQuery:
    """Last-wins state of a streaming log; :func:`keyed.kept` reads it."""
    names = [*values, order]
    rows = keyed.last_of_batch(log.select(*keys, *names), keys, order)
    return keyed.start(keyed.keep(rows, keys, _fields(rows, names), keyed.later(len(values))), checkpoint)


def keep_summary(log: DataFrame, checkpoint: str) -> StreamingQuery:
    """The state of :func:`summary_of` of a streaming log: Spark's own counts and sums, since nearly every row may be of a key of its own and Python would be asked for each."""
    return keyed.start(_per_user(log.withColumn("value", F.col("value").cast("double"))), checkpoint)


#: Fixed value: how a log row of a set lists its members.
MEMBERS = "photos "


def _listed(log: DataFrame, set_id: str, method: str, notes: str, order: str) -> DataFrame:
    rows = log.filter((F.col(method) == "sighting") & F.col(notes).startswith(MEMBERS))
    return rows.select(set_id, F.split(F.substring(F.col(notes), len(MEMBERS) + 1, 1 << 30), ";", -1).alias("members"), order)


def members_in(log: DataFrame, set_id: str = "upload_id", method: str = "method", notes: str = "notes", order: str = "seq") -> DataFrame:
    """``(set_id, members, order)`` from rows of method ``sighting`` whose notes list the members; the last row of a set wins."""
    return last_wins(_listed(log, set_id, method, notes, order), [set_id], order, ["members", order])


def keep_members(log: DataFrame, checkpoint: str, set_id: str = "upload_id", method: str = "method", notes: str = "notes", order: str = "seq") -> StreamingQuery:
    """Set membership from a streaming log: the state of :func:`members_in`."""
    rows = keyed.last_of_batch(_listed(log, set_id, method, notes, order), [set_id], order)
    return keyed.start(keyed.keep(rows, [set_id], _fields(rows, ["members", order]), keyed.later(1)), checkpoint)


def set_of(members: DataFrame, set_id: str) -> DataFrame:
    """The inverse, ``(member, <set_id>)``: for spreading what is said of a set to its members."""
    return members.select(F.explode("members").alias("member"), set_id)


def count_windows(log: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Extension: event-time windows with a watermark, for sinks that can't be rewritten."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drop_seen(log: DataFrame, key: str) -> DataFrame:
    """Exact duplicates of anything seen so far are dropped; the state holds every key."""
    return log.dropDuplicates([key])


def append_to(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """A streaming frame appended to a Parquet table, each row once."""
    return log.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_to_end(log: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive a streaming frame to its end into memory: for checks on small inputs."""
    name = f"lynceus_{uuid.uuid4().hex}"
    q = log.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return log.sparkSession.table(name)
