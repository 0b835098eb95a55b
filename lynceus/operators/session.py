"""The append-only event log: last wins, fan-out, tidy summary, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(log: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of the last row of each key, by an explicit append number."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("x")).select(*keys, "x.*")


def fan_out(feedback: DataFrame, members: DataFrame, set_id: str, member: str) -> DataFrame:
    """Feedback on a set goes to the set and to each member."""
    own = feedback.select(F.col(set_id).alias("target"), *[c for c in feedback.columns if c != set_id])
    m = members.select(F.col(set_id).alias("s_"), F.col(member).alias("target"))
    copies = feedback.join(m, F.col(set_id) == F.col("s_")).select("target", *[c for c in feedback.columns if c != set_id])
    return own.unionByName(copies)


def tidy(predictions: DataFrame, truths: DataFrame, methods: list[str]) -> DataFrame:
    """One row for each upload: the last pick of each method, and the truth of the upload itself or else of its set."""
    picks = last_wins(predictions, ["upload_id", "set_id", "method"], "seq", ["pick"])
    wide = picks.groupBy("upload_id", "set_id").pivot("method", methods).agg(F.first("pick"))
    own = last_wins(truths, ["upload_id"], "seq", ["truth"])
    of_set = own.select(F.col("upload_id").alias("set_id"), F.col("truth").alias("set_truth"))
    return wide.join(own, "upload_id", "left").join(of_set, "set_id", "left").withColumn("truth", F.coalesce("truth", "set_truth")).drop("set_truth")
