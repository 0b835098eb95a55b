"""Cross-site line deduplication by distinct-site spread.

Every line gets a 128-bit key and, per key, a HyperLogLog sketch of the sites it
occurs on; sketches merge by aggregation, map-side first, so a line that is on every
page costs one sketch a task.  Keys whose estimate is clearly over the threshold are
boilerplate, keys clearly under it are not, and those within the sketch's error of
the threshold get an exact distinct count.  Then each document loses its boilerplate
lines.  All of it is DataFrame operations.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import PREFIX, RID, Scratch, text_or_empty, with_row_id, without

MIN_SITES = 10
#: Shortest line that counts: every line with a character other than white space.
MIN_CHARS = 1
LOG_REGISTERS = 12
#: Standard errors of the sketch on either side of the threshold that are counted exactly.
BAND = 6.0

_LINES, _HITS = PREFIX + "lines", PREFIX + "hits"


def _key(line) -> list:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def line_dedup(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` with its lines of ``min_chars`` or more that occur on ``min_sites`` sites or more removed.

    Adds ``n_lines, n_removed``; the text is what remains, joined by line feeds.  Lines
    are compared without white space at either end.  Null text stays null and has no
    lines; a null site counts as no site; repeated rows add nothing to a line's sites.
    An empty table gives an empty table; input columns named like an output are
    replaced.  Lines are told apart by 128 bits of two hashes: among 10 ** 13 different
    lines two agree with a chance of 2e-13.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = without(docs, "n_lines", "n_removed")
    base = with_row_id(scratch, rows)
    trimmed = F.regexp_replace(F.col("line"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    split = base.select(RID, F.col(site).cast("string").alias("site"), F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("pos", "line"))
    split = split.withColumn("line", trimmed).filter(F.length("line") >= min_chars)
    lines = scratch.save(split.select(RID, "site", "pos", *_key(F.col("line"))), "lines")
    spread = lines.groupBy("k1", "k2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("n"), F.min("site").alias("least"), F.max("site").alias("most")
    )
    error = BAND * 1.04 / sqrt(1 << LOG_REGISTERS)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    # One site at least: the sketch isn't asked where the smallest and the largest agree.
    spread = spread.filter((F.col("n") >= low) & ((F.col("least") != F.col("most")) | F.lit(min_sites <= 1)))
    spread = scratch.save(spread.select("k1", "k2", (F.col("n") > high).alias("sure")), "spread")
    near = spread.filter(~F.col("sure")).select("k1", "k2")
    exact = lines.join(near, ["k1", "k2"], "left_semi").groupBy("k1", "k2", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("k1", "k2").agg(F.count("site").alias("n")).filter(F.col("n") >= min_sites)
    boilerplate = scratch.save(spread.filter("sure").select("k1", "k2").unionAll(exact.select("k1", "k2")), "boilerplate")
    hits = lines.join(boilerplate, ["k1", "k2"], "left_semi").groupBy(F.col(RID).alias(RID + "_")).agg(F.collect_list("pos").alias(_HITS))
    joined = base.join(scratch.save(hits, "hits"), F.col(RID) == F.col(RID + "_"), "left")
    joined = joined.withColumn(_LINES, F.split(F.col(text).cast("string"), "\n", -1))
    # The places that stay are a set difference, so a text of many lines is linear work; the list is bound once.
    kept = F.expr(f"element_at(transform(array({_LINES}), ls -> transform(array_except(sequence(0, size(ls) - 1), {_HITS}), i -> ls[i])), 1)")
    cleaned = F.when(F.col(_HITS).isNull(), F.col(text).cast("string")).otherwise(F.concat_ws("\n", kept))
    names = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns]
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return joined.select(*names, count(_LINES).alias("n_lines"), count(_HITS).alias("n_removed"))


def op7(docs: DataFrame) -> DataFrame:
    done = line_dedup(docs.select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), t AS (
  SELECT doc_id, source, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS trimmed FROM l
), b AS (
  SELECT trimmed FROM t WHERE length(trimmed) >= {MIN_CHARS} GROUP BY trimmed HAVING count(DISTINCT source) >= {MIN_SITES}
), m AS (
  SELECT t.*, b.trimmed IS NOT NULL AS gone FROM t LEFT JOIN b USING (trimmed)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
