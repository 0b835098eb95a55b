"""Accuracy, calibration and tables of decisions."""

from __future__ import annotations

from binascii import unhexlify
from collections.abc import Iterator
from math import ceil, exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.functions.decisions import likelihood_bin
from lynceus.operators.prefix import running_before


def hits(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """A row for each query of ``truth(q, true_cls)`` with a flag for each k; a query without a ranking misses."""
    own = ranked.join(truth, "q").filter(F.col("cls") == F.col("true_cls")).select("q", "rank")
    return truth.join(own, "q", "left").select("q", "true_cls", *[F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"hit{k}") for k in ks])


def accuracy(flags: DataFrame, *by: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    return flags.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"hit{k}").cast("int")).alias(f"top{k}") for k in ks])


def right_rank(best: DataFrame, truth: DataFrame) -> DataFrame:
    """1 + the number of classes that score strictly better than the right one."""
    by = Window.partitionBy("q").orderBy(F.desc("score"))
    return best.withColumn("rank", F.rank().over(by)).join(truth, "q").filter(F.col("cls") == F.col("true_cls")).select("q", "rank")


def auc(scores: DataFrame, positive: str = "known", value: str = "score") -> DataFrame:
    """Mann-Whitney, ties half, from average ranks: one aggregate by value and running sums over ranges of distinct values."""
    per = scores.groupBy(F.col(value).alias("t")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    run = running_before(per, "t", ["n"])
    wins = run.select("p", "n", (F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("w"))
    return wins.agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"))


def known_and_new(best: DataFrame, truth: DataFrame) -> DataFrame:
    """For each query the best score of its own class and of any other."""
    own = F.col("cls") == F.col("true_cls")
    return best.join(truth, "q").groupBy("q").agg(F.max(F.when(own, F.col("score"))).alias("s_known"), F.max(F.when(~own, F.col("score"))).alias("s_new"))


def calibrate(pairs: DataFrame, keep_known: float | None = None) -> DataFrame:
    """The cut-off: the first that maximises known kept plus new caught, or the highest that keeps a share of the known.

    Candidates are all scores; kept counts scores from the cut-off on, caught those
    under it.  Both are running sums over ranges of distinct scores.
    """
    each = pairs.select(F.explode(F.array(F.struct(F.col("s_known").alias("t"), F.lit(1).alias("k"), F.lit(0).alias("w")), F.struct(F.col("s_new").alias("t"), F.lit(0).alias("k"), F.lit(1).alias("w")))).alias("x"))
    per = each.select("x.*").filter(F.col("t").isNotNull()).groupBy("t").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))
    run = running_before(per, "t", ["k", "w"])
    total = per.agg(F.sum("k").alias("all_k"), F.sum("w").alias("all_w"))
    run = run.crossJoin(F.broadcast(total)).select("t", (1 - F.col("before_k") / F.col("all_k")).alias("kept"), (F.col("before_w") / F.col("all_w")).alias("caught"))
    if keep_known is None:
        return run.orderBy(F.desc(F.round(F.col("kept") + F.col("caught"), 12)), "t").limit(1)
    return run.filter(F.round("kept", 12) >= keep_known).orderBy(F.desc("t")).limit(1)


def sweep(scores: DataFrame, thresholds: list[float], known: str, right: str) -> DataFrame:
    """For each threshold: known kept, right ones among them, new caught.  One pass, a struct of counts for each threshold."""
    rows = scores.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t"), "score", known, right)
    over = F.col("score") >= F.col("t")
    return rows.groupBy("t").agg(
        F.count_if(F.col(known) & over).alias("kept"), F.count_if(F.col(known) & over & F.col(right)).alias("right"), F.count_if(~F.col(known) & ~over).alias("caught")
    )


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``(by, <a column for each share>)``: interpolated quantiles of each group, from running counts over ranges of distinct values.

    A quantile lies between the two values at the places around ``share * (n - 1)``; no
    group's values meet in one task.  Null values don't count.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = running_before(per.withColumn("o", F.struct(by, "v")), "o", ["c"]).select(by, "v", "c", "before_c")
    # Groups lie one behind another in the order, so a group's first place is its least running count.
    size = run.groupBy(F.col(by).alias("g_")).agg(F.sum("c").alias("n"), F.min("before_c").alias("start"))
    placed = run.join(size, F.col(by).eqNullSafe(F.col("g_"))).withColumn("lo", F.col("before_c") - F.col("start"))
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("n") - 1)
        holds = lambda p: (F.col("lo") <= p) & (p < F.col("lo") + F.col("c"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col("v"))), F.max(F.when(holds(F.ceil(at)), F.col("v")))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return placed.groupBy(by).agg(*out)


def with_log(rows: DataFrame) -> DataFrame:
    """``log1p`` of a score that isn't negative: what chances of right answers are fitted on."""
    return rows.withColumn("log1p", F.log1p(F.greatest("score", F.lit(0.0))))


def binned(rows: DataFrame, fit: dict[str, float] | None = None) -> DataFrame:
    """``(bin, n, right, observed)`` of ``rows(score, right)`` in the fixed score bins, and with coefficients of :func:`projection.logistic` on ``log1p`` the mean ``fitted`` chance.  Scores below all bins are left out."""
    chance = F.lit(None).cast("double") if fit is None else 1 / (1 + F.exp(-(F.col("log1p") * F.lit(fit["log1p"]) + F.lit(fit["constant"]))))
    binned = with_log(rows).select(likelihood_bin(F.col("score")).alias("bin"), F.col("right").cast("int").alias("r"), chance.alias("p")).filter("bin is not null")
    more = [] if fit is None else [F.avg("p").alias("fitted")]
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("right"), F.avg("r").alias("observed"), *more)


#: Chances of 0, 1, ... occurrences of a row in a drawing with replacement from many rows, as running sums; more than nine occur once in ten million.
OCCURRENCES = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(10)]


def occurrences(row: Column, replicates: int, seed: int) -> Column:
    """How often each replicate's drawing has this row: an array from four digits groups of a hash of seed, row and replicate, so reruns and other layouts draw the same."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1)), lambda j: F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), j.cast("string")).cast("binary")))
    share = lambda h, p: F.conv(F.substring(h, 1 + 8 * p, 8), 16, 10).cast("double") / float(1 << 32)
    count = lambda u: sum(((u >= c).cast("int") for c in OCCURRENCES), F.lit(0))
    each = F.flatten(F.transform(parts, lambda h: F.array(*[count(share(h, p)) for p in range(4)])))
    return F.slice(each, 1, replicates)


def _drawn_sums(by: list[str], replicates: int):
    """Of a batch with flags ``f_`` and hashes ``h_`` of its rows: for each group and replicate the rows drawn and those of them with the flag (null where no flag is known)."""
    steps = [ceil(c * (1 << 32)) for c in OCCURRENCES if c * (1 << 32) <= (1 << 32) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("h_")
            ends = np.frombuffer(h.buffers()[1], np.int32)[h.offset : h.offset + len(h) + 1]
            share = np.frombuffer(unhexlify(memoryview(h.buffers()[2])[ends[0] : ends[-1]]), ">u4").reshape(len(h), -1)[:, :replicates].astype(np.uint32)
            drawn = np.zeros(share.shape, np.int64)
            for c in steps:
                drawn += share >= c
            seen: dict = {}
            code = np.array([seen.setdefault(k, len(seen)) for k in zip(*(b.column(c).to_pylist() for c in by), strict=True)] if by else np.zeros(len(h)), np.int64)
            order = np.argsort(code, kind="stable")
            first = np.unique(code[order], return_index=True)[1]
            flag = b.column("f_").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[order, None]
            known = np.add.reduceat(b.column("f_").is_valid().to_numpy(zero_copy_only=False)[order].astype(np.int64), first) > 0
            drawn = drawn[order]
            sums = [np.add.reduceat(x, first, axis=0) for x in (drawn, drawn * flag)]
            offsets = pa.array(np.arange(0, sums[0].size + 1, replicates, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), mask=m)) for x, m in zip(sums, (None, np.repeat(~known, replicates)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(order[first])) for c in by), *lists], names=[*by, "w_", "f_"])

    return run


def bootstrap(rows: DataFrame, row: Column, by: list[str], flag: Column, statistic, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """``(*by, n, estimate, low, high)``: a statistic of the share of rows with a flag, and the interval of its replicates.

    ``statistic`` makes a column from the share.  Every replicate draws each row as often
    as :func:`occurrences` says; all replicates are one aggregate, whose size is that of
    the groups times the replicates, whatever the rows.  Rows are drawn and added up batch
    by batch, so no row is multiplied by the replicates.  Replicates that draw nothing of
    a group don't count.
    """
    start = F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit("")).alias("start_")
    hashes = F.concat(*[F.md5(F.concat("start_", F.lit(str(j))).cast("binary")) for j in range(-(-replicates // 4))])
    hashed = rows.select(*by, flag.cast("int").alias("f_"), start).select(*by, "f_", hashes.alias("h_"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in hashed.schema.fields if f.name in by)
    drawn = hashed.mapInArrow(_drawn_sums(by, replicates), kinds + "w_ array<long>, f_ array<long>").select(*by, F.posexplode(F.arrays_zip("w_", "f_")).alias("r_", "x_"))
    each = drawn.groupBy(*by, "r_").agg((F.sum("x_.f_") / F.nullif(F.sum("x_.w_"), F.lit(0))).alias("p_"))
    tail = (1 - level) / 2
    spread = each.filter("p_ is not null").groupBy(*by).agg(*[F.percentile(statistic(F.col("p_")), q).alias(name) for name, q in (("low", tail), ("high", 1 - tail))])
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), statistic(F.avg(flag.cast("int"))).alias("estimate"))
    return whole.join(spread, by, "left")
