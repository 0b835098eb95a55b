"""A service that answers one number at a time, as a source of rows.

Numbers are given out in ascending order and some are gone; behind the last there are
only misses, and ``MISSES`` of them in a row are taken as the end.  A batch plans ranges of
numbers that executors fetch; the end is found afterwards, from the gaps between answers.
A stream asks on from the last answer it had, ``AT_ONCE`` numbers a micro-batch at most.

The fetch is a function from a number to the answer's text, or None for a miss; other
failures are raised, and Spark runs the range again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

#: Fixed value: misses in a row that are the end.
MISSES = 25
#: Numbers of a range, of a micro-batch, and of a block in which gaps are looked for.
RANGE, AT_ONCE, BLOCK = 500, 1000, 4096

Fetch = Callable[[int], str | None]


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, options: dict):
        self.fetch = fetch
        self.first, self.last, self.range = int(options.get("first", 1)), int(options["last"]), int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        return [_Range(i, min(self.last, i + self.range - 1)) for i in range(self.first, self.last + 1, self.range)] or [_Range(1, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for number in range(partition.first, partition.last + 1):
            if (body := self.fetch(number)) is not None:
                yield number, body


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Fetch, options: dict):
        self.fetch, self.first, self.most = fetch, int(options.get("first", 1)), int(options.get("atonce", AT_ONCE))

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, number, misses = [], start["next"], 0
        while misses < MISSES and number < start["next"] + self.most:
            body = self.fetch(number)
            number, misses = number + 1, 0 if body is not None else misses + 1
            if body is not None:
                rows.append((number - 1, body))
        # At the end the next micro-batch asks again from behind the last answer: numbers given out since are found.
        after = rows[-1][0] + 1 if rows else start["next"]
        return iter(rows), {"next": after if misses >= MISSES else number}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        found = ((n, self.fetch(n)) for n in range(start["next"], end["next"]))
        return iter([(n, body) for n, body in found if body is not None])


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Make the service a format of this session: ``number long, body string``."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "number long, body string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, self.options)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Stream(fetch, self.options)

    spark.dataSource.register(Paged)


def up_to_the_end(answers: DataFrame, first: int = 1, misses: int = MISSES) -> DataFrame:
    """The answers before the first ``misses`` numbers in a row without one; gaps are found in blocks of numbers, and between blocks from a row a block."""
    block = F.floor(F.col("number") / BLOCK)
    per = answers.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list("number")).alias("n"))  # BLOCK numbers at most
    gap = F.filter(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.get("n", i) - F.get("n", i - 1) > misses)
    inner = F.when(F.size("n") > 1, F.get("n", F.get(gap, 0)))
    ends = per.select("block", F.get("n", 0).alias("lo"), F.element_at("n", -1).alias("hi"), inner.alias("inner"))
    before = F.coalesce(F.lag("hi").over(Window.orderBy("block")), F.lit(first - 1))
    stop = ends.withColumn("stop", F.when(F.col("lo") - before > misses, F.col("lo")).otherwise(F.col("inner"))).agg(F.min("stop").alias("stop"))
    return answers.crossJoin(stop).filter(F.col("stop").isNull() | (F.col("number") < F.col("stop"))).drop("stop")


def read_paged(spark: SparkSession, name: str, last: int, first: int = 1) -> DataFrame:
    """``(number, body)`` of the answers up to ``last`` or the end, whichever comes first."""
    return up_to_the_end(spark.read.format(name).option("first", first).option("last", last).load(), first)
