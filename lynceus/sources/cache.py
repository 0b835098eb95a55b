"""Derived tables kept under the hash of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lynceus.sources.tables import append, exists, overwrite


def cached(spark: SparkSession, folder: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table for this configuration; built and written if it isn't there yet.  Another configuration is another table."""
    path = f"{folder}/{hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        overwrite(build(), path)
    return spark.read.parquet(path)


def top_up(spark: SparkSession, folder: str, config: dict, wanted: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table for this configuration, with the rows of ``wanted`` keys that it lacks built and appended."""
    path = f"{folder}/{hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()}"
    missing = wanted.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, f"{path}/_SUCCESS") else wanted
    if not missing.isEmpty():
        append(build(missing), path)
    return spark.read.parquet(path)
