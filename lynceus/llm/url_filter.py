"""URL filters over a sorted digest array.

Every listed string (a rule's host and path, or a blocked host) has one 64-bit xxhash
key.  The keys are sorted and written to one file with the full strings behind them;
the file is sent to each executor once and memory-mapped, so all workers of a machine
share its pages.  A batch of urls becomes a flat array of probes (each host suffix of a
listed number of labels with each path prefix of a listed length), which one vectorised
binary search looks up; hits are confirmed against the full strings, so a collision of
digests changes nothing.

A list over ``LARGEST_FILE`` bytes isn't sent: it is cut by ranges of the digests into
shards of that size at most, the probes are shuffled to the shard of their digest, and
each task searches the sorted array of one shard.  Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm.common import PREFIX, RID, Scratch, with_row_id, without

#: (verdict, host, path) of the query's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The query's list of hosts that are blocked, subdomains included, where no rule fits.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))
#: Verdict where nothing fits.
DEFAULT = "allow"
#: The array goes to every executor, so a larger list is searched in shards.
LARGEST_FILE = 256 << 20
#: Probes that a group searches, and those of a page, as the mean; the shards follow from them.
GROUP_PROBES, PROBES = 1 << 18, 8
SEED = 0

_ALLOW, _BLOCK, _HOST = 0, 1, 2
_BEST, _LISTED = PREFIX + "best", PREFIX + "listed"


def host_of(url: str) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one."""
    host = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def entries(rules, hosts) -> dict[str, int]:
    """Each listed string once with its kind; a rule goes before a listed host."""
    listed = {h.lower() + p: _ALLOW if v == "allow" else _BLOCK for v, h, p in rules}
    for h in hosts:
        listed.setdefault(h.lower(), _HOST)
    return listed


def array_bytes(listed: Iterable[tuple[str, int]]) -> bytes:
    """The sorted digest array: the number of entries, digests, ends of the strings, kinds, strings."""
    rows = sorted((xxhash.xxh64_intdigest(s.encode(), SEED), s.encode(), kind) for s, kind in listed)
    digests = np.array([r[0] for r in rows], "<u8")
    ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
    kinds = np.array([r[2] for r in rows], "u1")
    return np.uint64(len(rows)).tobytes() + digests.tobytes() + ends.tobytes() + kinds.tobytes() + b"".join(r[1] for r in rows)


def write_array(rules, hosts, folder: str) -> tuple[str, Shapes]:
    """The file of the digest array, named by its content, and what probes can be in it."""
    content = array_bytes(entries(rules, hosts).items())
    name = f"urls-{hashlib.sha256(content).hexdigest()[:24]}.digests"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(content)
    return os.path.join(folder, name), Shapes.of(rules, hosts)


@dataclass(frozen=True)
class Shapes:
    """The numbers of labels of listed hosts and the lengths of listed paths: no other probe can hit."""

    labels: tuple[int, ...]
    lengths: tuple[int, ...]

    @classmethod
    def of(cls, rules, hosts) -> Shapes:
        labels = {h.count(".") + 1 for _, h, _ in rules} | {h.count(".") + 1 for h in hosts}
        return cls(tuple(sorted(labels)), tuple(sorted({len(p) for _, _, p in rules} | ({0} if hosts else set()))))

    def probes(self, host: str, path: str) -> Iterator[tuple[bytes, int]]:
        """Each probe with the length of its host.  A host of any number of labels is cut once for each listed number."""
        starts = [path[:n] for n in self.lengths if n <= len(path)]
        for n in self.labels if host else ():
            parts = host.rsplit(".", n)
            if len(parts) < n:
                continue
            suffix = ".".join(parts[-n:])
            for start in starts:
                yield (suffix + start).encode("utf-8", "replace"), len(suffix)


class DigestArray:
    """The mapped file; ``find`` gives the place of each probe or -1."""

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.kinds = raw[16 + 16 * n : 16 + 17 * n]
        self.strings = raw[16 + 17 * n :]

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        return cls(np.memmap(path, np.uint8, "r"))

    def find(self, probes: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        keys = np.fromiter((digest(p, SEED) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.digests, keys)
        found = np.full(len(probes), -1, np.int64)
        n = len(self.digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, n - 1)] == keys) if n else ():
            j = int(at[i])
            while j < n and self.digests[j] == keys[i]:  # equal digests lie side by side
                if self.strings[int(self.ends[j]) : int(self.ends[j + 1])].tobytes() == probes[i]:
                    found[i] = j
                    break
                j += 1
        return found


@cache
def _driver_folder() -> str:
    """One folder of the driver's for all arrays: the same array is the same file again, which Spark accepts; executors get it from the driver."""
    return tempfile.mkdtemp(prefix="lynceus-urls-")


def _verdicts(best: list, blocked: list[bool], default: str) -> tuple[list, list]:
    """Rule and verdict of each row from ``(length, host length, kind, rule)`` of its best rule, or None."""
    rule = [x[3] if x else None for x in best]
    return rule, [("block" if x[2] == _BLOCK else "allow") if x else "block" if listed else default for x, listed in zip(best, blocked, strict=True)]


def judge(pages: DataFrame, rules=RULES, hosts=BLOCKED_HOSTS, url: str = "url", default: str = DEFAULT, largest: int | None = None) -> DataFrame:
    """Every row of ``pages`` with ``host, path, rule, verdict``.

    The rule is the longest that fits, host and path together; of equally long ones
    the one with the longer host.  Where none fits the rule is null and the verdict is
    ``block`` for a listed host or a subdomain of one, else ``default``.  Null urls and
    those without `://` have empty host and path and fit nothing.  Repeated rows get
    the same verdict; an empty table gives an empty table; input columns named like an
    output are replaced.  A list of more than ``largest`` bytes is searched in shards.
    """
    spark: SparkSession = pages.sparkSession
    listed = entries(rules, hosts)
    rows = without(pages, "host", "path", "rule", "verdict")
    rows = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    size, largest = sum(len(s.encode()) + 17 for s in listed), largest or LARGEST_FILE
    if size > largest:
        return _judge_in_shards(rows, listed, Shapes.of(rules, hosts), -(-size // largest), default)
    file, shapes = write_array(rules, hosts, _driver_folder())
    name = os.path.basename(file)
    spark.sparkContext.addFile(file)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    h_at, p_at = len(names) - 2, len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.mapped(SparkFiles.get(name))
        for b in batches:
            probes, owner, host_len = [], [], []
            for i, (host, path) in enumerate(zip(b.column(h_at).to_pylist(), b.column(p_at).to_pylist(), strict=True)):
                for probe, n in shapes.probes(host, path):
                    probes.append(probe)
                    owner.append(i)
                    host_len.append(n)
            best: list = [None] * b.num_rows
            blocked = [False] * b.num_rows
            at = array.find(probes)
            for k in np.flatnonzero(at >= 0).tolist():
                i, kind = owner[k], int(array.kinds[at[k]])
                if kind == _HOST:
                    blocked[i] = True
                elif best[i] is None or (len(probes[k]), host_len[k]) > best[i][:2]:
                    best[i] = (len(probes[k]), host_len[k], kind, probes[k].decode())
            rule, verdict = _verdicts(best, blocked, default)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*names, "rule", "verdict"])

    return rows.mapInArrow(run, f"{schema}, rule string, verdict string")


def _judge_in_shards(rows: DataFrame, listed: dict[str, int], shapes: Shapes, shards: int, default: str) -> DataFrame:
    """The list by ranges of the digests, the probes by the range of theirs; a row's hits meet by its number."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "urls")
    base = with_row_id(scratch, rows)
    # As many shards as the list or its probes need, whichever are more: the larger the table, the smaller the part of the list that a group searches.
    shards = max(shards, -(-base.count() * PROBES // GROUP_PROBES))
    shard_of = lambda digest: digest * shards >> 64
    table = [(shard_of(xxhash.xxh64_intdigest(s.encode(), SEED)), s, kind) for s, kind in listed.items()]
    entries_of = scratch.save(spark.createDataFrame(table, "shard int, entry string, kind int"), "list")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(shard_of(xxhash.xxh64_intdigest(p, SEED)), rid, p, n) for rid, host, path in zip(*(c.to_pylist() for c in b.columns), strict=True) for p, n in shapes.probes(host, path)]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "rid", "probe", "n"])

    # A shard with many probes, of a common host, is searched in several groups; the others in one.
    probes = scratch.save(base.select(RID, "host", "path").mapInArrow(probe, "shard int, rid long, probe binary, n int"), "probes")
    salts = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_PROBES)).cast("int").alias("salts"))
    salts = scratch.save(salts, "salts")
    probes = probes.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int")).drop("salts")
    salted = entries_of.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        array = DigestArray(np.frombuffer(array_bytes(zip(known.column("entry").to_pylist(), known.column("kind").to_pylist(), strict=True)), np.uint8))
        at = array.find(asked.column("probe").to_pylist())
        hit = np.flatnonzero(at >= 0)
        return asked.take(pa.array(hit)).select(["rid", "probe", "n"]).append_column("kind", pa.array(array.kinds[at[hit]].astype(np.int32)))

    hits = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(search, "rid long, probe binary, n int, kind int")
    rule = F.col("kind") != _HOST
    per = hits.groupBy(F.col("rid").alias(RID + "_")).agg(
        F.max(F.when(rule, F.struct(F.length("probe").alias("l"), "n", "kind", F.decode("probe", "UTF-8").alias("rule")))).alias(_BEST), F.max(~rule).alias(_LISTED)
    )
    joined = base.join(scratch.save(per, "hits"), F.col(RID) == F.col(RID + "_"), "left")
    verdict = F.when(F.col(_BEST).isNotNull(), F.when(F.col(_BEST)["kind"] == _BLOCK, "block").otherwise("allow")).when(F.coalesce(_LISTED, F.lit(False)), "block").otherwise(default)
    return joined.select(*[f"`{c}`" for c in rows.columns], F.col(_BEST)["rule"].alias("rule"), verdict.alias("verdict"))


def op10(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    rules = ", ".join(f"('{h + p}', '{h}', '{p}', '{v}')" for v, h, p in RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return f"""
WITH rules(rule, rh, rp, v) AS (VALUES {rules}), blocked(bh) AS (VALUES {hosts}),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), f AS (
  SELECT u.page_id, rule, v, row_number() OVER (PARTITION BY u.page_id ORDER BY length(rule) DESC, length(rh) DESC) AS k
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT u.page_id, host, path, rule,
  coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM blocked WHERE host = bh OR ends_with(host, '.' || bh)) THEN 'block' ELSE '{DEFAULT}' END) AS verdict
FROM u LEFT JOIN f ON f.page_id = u.page_id AND k = 1
"""
