"""SimHash near-deduplication with pigeonhole blocks.

A 64-bit fingerprint is cut into B blocks.  Fingerprints that differ in at most K
bits agree in some B - K whole blocks, so each fingerprint is dealt once for every
choice of B - K blocks, by those blocks' bits, and only fingerprints of one bucket
are compared.  B follows from the number of distinct fingerprints: it is the
smallest with no more of them than buckets.

Equal fingerprints are one row before that (map-side aggregate), so copies cost
nothing.  A bucket yields a spanning forest of its links, not all pairs.  Buckets
over ``LARGEST_BUCKET`` are dealt again with ``FINE_BLOCKS`` blocks, where a bucket
can't hold more than 2 ** (K * 64 / FINE_BLOCKS) = 4096 different fingerprints; that
way is exact too, so no link is lost and no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import PREFIX, RID, Scratch, with_row_id, without
from lynceus.llm.components import components

WORDS = 3
SEED = 42
DISTANCE = 3
LARGEST_BUCKET = 4096
FINE_BLOCKS = 16
#: Shingles hashed at a time, so that a very long text needs no more memory than this many.
STEP = 1 << 15

FP = PREFIX + "fp"
_ROOT, _KEEPER, _LEAST, _TOP = (PREFIX + x for x in ("root", "keeper", "least", "top"))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority of the bits of XXH64 over the word shingles, repeats included; 0 without a word."""
    split = (text or "").encode("utf-8", "replace").lower().split()
    n = len(split)
    if not n:
        return 0
    joined = b" ".join(split)
    if n < words:
        starts, ends = [0], [len(joined)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))[: n - words + 1].tolist()
        ends = np.concatenate((gaps, [len(joined)]))[words - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), STEP):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS, keep_text: bool = True) -> DataFrame:
    """The rows with their fingerprint as a signed 64-bit column ``FP``."""
    rows = docs
    names = [c for c in rows.columns if keep_text or c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    at, keep = rows.columns.index(text), [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(fp)], names=[*names, FP])

    return rows.mapInArrow(run, (schema + ", " if schema else "") + f"`{FP}` long")


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """A 64-bit mask (signed) for each choice of ``blocks - distance`` whole blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(one, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(distinct: int, distance: int = DISTANCE) -> int:
    """The fewest blocks that give at least as many buckets as there are fingerprints."""
    bits = log2(max(2, distinct))
    return min(FINE_BLOCKS, max(distance + 2, ceil(64 * distance / max(1.0, 64 - bits))))


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``distance``: at most one a fingerprint."""
    rest, links = fps, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            hit = rest[near]
            links += [(int(x), int(y)) for y in hit]
            front += list(hit)
            rest = rest[~near]
    return links


def _bucket_links(distance: int, largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by mask and key.  A link from a fingerprint to itself says that its bucket was too large."""
        key, held, over = None, [], False
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                out.extend(forest(np.array(held, np.int64).view(np.uint64), distance))

        for b in batches:
            mask, bucket, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)], strict=True):
                if (now := (mask[s], bucket[s])) != key:
                    close()
                    key, held, over = now, [], False
                if over:
                    out.extend((x, x) for x in fp[s:e].view(np.uint64).tolist())
                    continue
                held.extend(fp[s:e].tolist())
                if len(held) > largest:
                    out.extend((x, x) for x in np.array(held, np.int64).view(np.uint64).tolist())
                    held, over = [], True
            if len(out) > 65536:
                yield _pairs(out)
                out.clear()
        close()
        yield _pairs(out)

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def links(scratch: Scratch, fingerprints: DataFrame, distance: int = DISTANCE, largest: int = LARGEST_BUCKET) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints within ``distance`` of each other.  ``fingerprints`` has distinct values ``FP``."""

    def deal(fps: DataFrame, blocks: int) -> DataFrame:
        masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks, distance)])
        dealt = fps.select(F.posexplode(masks).alias("mask", "bits"), F.col(FP).alias("fp"))
        dealt = dealt.select("mask", F.col("bits").bitwiseAND(F.col("fp")).alias("bucket"), "fp")
        return dealt.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")

    coarse = deal(fingerprints, blocks_for(fingerprints.count(), distance))
    found = scratch.save(coarse.mapInArrow(_bucket_links(distance, largest), "a long, b long"), "links")
    hot = scratch.save(found.filter("a = b").select(F.col("a").alias(FP)).distinct(), "hot")
    if not hot.isEmpty():
        fine = deal(hot, FINE_BLOCKS).mapInArrow(_bucket_links(distance, 1 << (distance * 64 // FINE_BLOCKS)), "a long, b long")
        found = found.unionAll(scratch.save(fine, "fine"))
    return found.filter("a <> b")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, distance: int = DISTANCE, keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (16 hex digits), ``component_id`` and ``kept``.

    ``component_id`` is the smallest id reachable over links of at most ``distance``
    bits, null where the component has no id; ``kept`` marks exactly one row of each
    component, one with that id.  Null and empty texts, and those without a word, have
    fingerprint zero and are linked like any other.  Repeated rows are copies.
    ``keep_text=False`` leaves the text out of all that is moved.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = without(docs, "fingerprint", "component_id", "kept")
    base = with_row_id(scratch, with_fingerprint(rows, text, words, keep_text))
    own = F.col(f"`{doc_id}`")
    keeper = F.coalesce(F.min_by(F.col(RID), own), F.min(RID))
    nodes = scratch.save(base.groupBy(FP).agg(F.min(own).alias(_LEAST), keeper.alias(_KEEPER)), "nodes")
    found = components(scratch, links(scratch, nodes.select(FP), distance))
    found = found.withColumnsRenamed({"node": FP, "component": _ROOT})
    labelled = nodes.join(found, FP, "left").withColumn(_ROOT, F.coalesce(_ROOT, FP))
    labelled = scratch.save(labelled, "labelled")
    top = labelled.groupBy(_ROOT).agg(F.min(_LEAST).alias(_TOP), F.coalesce(F.min_by(_KEEPER, _LEAST), F.min(_KEEPER)).alias(_KEEPER))
    label = labelled.select(F.col(FP).alias(FP + "_"), _ROOT).join(scratch.save(top, "top"), _ROOT).select(FP + "_", _TOP, _KEEPER)
    label = scratch.save(label, "label")
    joined = base.join(label, F.col(FP) == F.col(FP + "_"))
    names = [f"`{c}`" for c in rows.columns if keep_text or c != text]
    return joined.select(
        *names,
        F.lpad(F.lower(F.hex(FP)), 16, "0").alias("fingerprint"),
        F.col(_TOP).alias("component_id"),
        (F.col(RID) == F.col(_KEEPER)).alias("kept"),
    )


def op3(docs: DataFrame) -> DataFrame:
    return near_dedup(docs.select("doc_id", "text"), keep_text=False).select("doc_id", "fingerprint", "component_id")
