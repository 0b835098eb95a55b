"""Token ids as Parquet list columns: ordered shards that can be read by document, by position or by metadata alone.

A document becomes its token ids and an end id.  Documents are dealt to ranges of their
id, sorted within a range and tokenised in that order by the task that writes them, so
each text is shuffled once and no ids are.  A shard is one task's rows in the order of
the ids.  Its list column is encoded by dictionary (ids repeat, so they cost the bits of
the dictionary's indexes) or by delta; row groups and pages are small and have their own
minima and maxima, which are in the page index, so a reader that wants some documents,
or a span of positions, reads only their pages, and one that wants metadata reads no ids.

A row knows its place in its shard, and an index beside the shards has each shard's
first position, so positions in the whole corpus need no rewrite of any file.  Files are
written by Spark's own writer and committed by task: an executor that is lost leaves none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.llm.common import PREFIX, RID, Scratch, without
from lynceus.llm.packing import packed_ids, vocabulary
from lynceus.sources.scratch import delete_at_end

END_ID = 2
#: Bytes of a row group and of a page, most rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 1000
#: Ids that a task encodes before it hands a batch over.
BATCH_IDS = 1 << 20
#: Writer options of the two encodings of the list column.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "true", "parquet.enable.dictionary#tokens.list.element": "false", "parquet.writer.version": "PARQUET_2_0"},
}

_TIE, _FIRST, _LAST = (PREFIX + x for x in ("tie", "first", "last"))
#: Columns of a shard beside the documents' own; ``offset`` and ``upto`` are the numbers of ids in the shard before a document and with it.
OUTPUTS = ("shard", "offset", "upto", "n_tokens", "tokens")


def _encode(names: list[str], text_at: int, keep: list[int], path: str, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, offset = TaskContext.get().partitionId(), 0

        def rows(b: pa.RecordBatch, first: int, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal offset
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            own = [pa.array(np.full(len(n), shard, np.int32)), pa.array(offset + ends - n), pa.array(offset + ends), pa.array(n), tokens]
            offset += int(ends[-1])
            return pa.RecordBatch.from_arrays([*(b.column(i).slice(first, len(n)) for i in keep), *own], names=names)

        for b in batches:
            held, size, first = [], 0, 0
            for i, text in enumerate(b.column(text_at)):
                held.append(packed_ids(text.as_py(), path)[:-4] + end)
                size += len(held[-1]) // 4
                if size >= BATCH_IDS:
                    yield rows(b, first, held)
                    held, size, first = [], 0, i + 1
            if held:
                yield rows(b, first, held)

    return run


def write_tokens(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """Shards in ``folder/shards`` in ascending order of ``doc_id``, and ``folder/index`` with a row a shard.

    A row of a shard has the other columns of ``docs`` (not the text) and ``shard, offset,
    upto, n_tokens, tokens``; input columns of these names are left out.  Null and empty texts
    are the end id alone.  Null ids come first, rows of one id follow each other by a hash
    of their texts; repeated rows are written each, in several shards where they are many.
    An empty table makes an empty index and shards without rows.  ``encoding`` is
    ``dictionary`` or ``delta``.  The folder must not exist.
    """
    spark = docs.sparkSession
    rows = without(docs, *OUTPUTS)
    names = [c for c in rows.columns if c != text]
    dealt = rows.withColumn(_TIE, F.xxhash64(F.col(text).cast("string"))).withColumn(RID, F.monotonically_increasing_id())
    order = [F.col(doc_id), F.col(_TIE), F.col(RID)]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"`{c}`" for c in rows.columns])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    at = [rows.columns.index(c) for c in names]
    encoded = dealt.mapInArrow(_encode([*names, *OUTPUTS], rows.columns.index(text), at, path or vocabulary(), end_id), (kinds + ", " if kinds else "") + "shard int, offset long, upto long, n_tokens long, tokens array<int>")
    options = ENCODINGS[encoding] | {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "compression": "zstd"}
    encoded.write.mode("error").options(**options).parquet(f"{folder}/shards")
    sizes = spark.read.parquet(f"{folder}/shards").groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    index = sizes.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    index.coalesce(1).write.mode("error").parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of all shards with ``start``, the number of ids before each in the corpus.  A filter on ``doc_id`` reads its pages only; columns that aren't used aren't read."""
    index = spark.read.parquet(f"{folder}/index").select("shard", F.col("first").alias(_FIRST))
    shards = spark.read.parquet(f"{folder}/shards")
    return shards.join(index, "shard").withColumn("start", F.col(_FIRST) + F.col("offset")).drop(_FIRST)


def read_span(spark: SparkSession, folder: str, first: int, length: int) -> DataFrame:
    """``(start, tokens)`` of the documents' parts that lie in ``length`` ids from position ``first`` of the corpus.

    The index names the shards; of the first and the last of them only pages of documents
    that reach into the span are read.  A span of no ids, or behind the end, gives no rows.
    """
    last = first + max(0, length)
    index = spark.read.parquet(f"{folder}/index").select("shard", F.col("first").alias(_FIRST), (F.col("first") + F.col("n_tokens")).alias(_LAST))
    index = index.filter((F.col(_FIRST) < last) & (F.col(_LAST) > first)).drop(_LAST)
    ends = index.agg(F.min(F.struct("shard", _FIRST)).alias("a"), F.max(F.struct("shard", _FIRST)).alias("z")).first()
    (a, a_first), (z, z_first) = ends.a or (0, 0), ends.z or (0, 0)
    within = F.col("shard").between(a, z) & ((F.col("shard") > a) | (F.col("upto") > first - a_first)) & ((F.col("shard") < z) | (F.col("offset") < last - z_first))
    found = spark.read.parquet(f"{folder}/shards").filter(within).join(index, "shard")
    start = F.col(_FIRST) + F.col("offset")
    skip, stop = F.greatest(F.lit(0), F.lit(first) - start), F.least(F.col("n_tokens"), F.lit(last) - start)
    return found.filter(skip < stop).select((start + skip).alias("start"), F.slice("tokens", (skip + 1).cast("int"), (stop - skip).cast("int")).alias("tokens"))


def _crc(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            flat = memoryview(tokens.values.to_numpy()).cast("B")
            bounds = (tokens.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    return run


def with_checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` without the ids but with ``ids_crc32``, the unsigned crc32 of them as little-endian unsigned 32-bit numbers."""
    names = [c for c in tokens.columns if c not in ("tokens", "ids_crc32")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name in names)
    return tokens.select(*[f"`{c}`" for c in names], "tokens").mapInArrow(_crc(names), f"{kinds}, ids_crc32 long")


def op12(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs.select("doc_id", "text"), scratch.path)
    delete_at_end(docs.sparkSession, scratch.path)
    return with_checksums(read_tokens(docs.sparkSession, scratch.path)).select("doc_id", "start", "n_tokens", "ids_crc32")
