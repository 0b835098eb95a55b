"""Scoring queries against a labelled gallery.

The theta join (every query with every reference that an exclusion rule leaves) runs
as a grid of blocks: both sides are dealt to blocks by hash, each pair of blocks is
one matrix product in double precision, and each task reduces its block (best
reference of each class, or the best references) before anything leaves it.  So the
shuffle holds each vector once for every block of the other side and a few rows a
query, never the pairs.  Blocks are as large as memory allows, so that a vector is
moved seldom, and smaller only where there would be fewer pairs of blocks than cores.

Gallery frames have the columns ``id, cls, grp, v`` (and ``day`` for time rules).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Rows of a block: at least and at most, and numbers of a block at most; a task holds two blocks and one slab of their product.
LEAST_BLOCK, MOST_BLOCK, BLOCK_NUMBERS = 512, 8192, 1 << 23
#: The same where products are screened in single precision, whose slabs are small.
WIDE_BLOCK = 32768
#: Queries whose products with a block are held at a time.
SLAB = 512
#: Cells of a product in single precision that are held at a time, rows that runs of one class and sighting have at least on average, and cells of a product that may be worth the exact cosine, of a query and class on average.
CELLS, LEAST_RUN, CLOSE = 1 << 22, 16, 8
#: Parts that classes are dealt to where a query meets its own only, and tasks of a grid at most.
CLASS_PARTS, MOST_TASKS = 64, 2000

#: What a query may not be scored against, given arrays of the two blocks: True is left out; None leaves out nothing.
EXCLUSIONS: dict[str, Callable] = {
    "none": lambda q, r: None,
    "self": lambda q, r: q["id"][:, None] == r["id"][None, :],
    "sighting": lambda q, r: q["grp"][:, None] == r["grp"][None, :],
    "sighting_of_class": lambda q, r: (q["grp"][:, None] == r["grp"][None, :]) & (q["cls"][:, None] == r["cls"][None, :]),
    "own_class": lambda q, r: q["cls"][:, None] == r["cls"][None, :],
    "not_before": lambda q, r: q["id"][:, None] >= r["id"][None, :],
    "sighting_or_other_class": lambda q, r: (q["grp"][:, None] == r["grp"][None, :]) | (q["cls"][:, None] != r["cls"][None, :]),
}
#: Those that look at sightings and classes alone.
BY_GROUP = ("none", "sighting", "sighting_of_class", "own_class", "sighting_or_other_class")


def years_apart(years: int, own_class_only: bool = True) -> Callable:
    """Own-class references must be ``years`` * 365 days away and of another sighting; other classes are free."""

    def rule(q: dict, r: dict) -> np.ndarray:
        near = (np.abs(q["day"][:, None] - r["day"][None, :]) < 365 * years) | (q["grp"][:, None] == r["grp"][None, :])
        return near & (q["cls"][:, None] == r["cls"][None, :])

    return rule


def block_rows(n: int, m: int, dim: int, cores: int, most: int = MOST_BLOCK) -> int:
    """Rows of a block for ``n`` queries and ``m`` references: about four pairs of blocks a core until blocks are as large as they may be."""
    most = max(1, min(most, BLOCK_NUMBERS // max(1, dim)))
    return min(most, max(LEAST_BLOCK, int((n * m / (4 * cores)) ** 0.5)))


def _arrays(t: pa.Table) -> dict:
    v = t.column("v").combine_chunks()
    m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
    out = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("v", "cb", "qb", "rb")}
    return out | {"v": m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)}


def best_of_rows(s: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(i, j)`` of the k largest finite numbers of each row, rows in order and the largest first; ties go to the smaller of ``ids[j]``.

    The k-th largest of maxima of groups of columns is no larger than the k-th largest
    number, so only what reaches it is put in order, and no row is sorted.
    """
    n, m = s.shape
    groups = min(m, max(64, 8 * k))
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = s[:, :groups].copy()
    for first in range(groups, m, groups):
        part = s[:, first : first + groups]
        np.maximum(top[:, : part.shape[1]], part, out=top[:, : part.shape[1]])
    least = np.partition(top, groups - k, axis=1)[:, groups - k] if k < groups else np.full(n, -np.inf)
    i, j = np.divmod(np.flatnonzero(s >= np.maximum(least, np.finfo(float).min)[:, None]), m)
    order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def _best_of_class(s: np.ndarray, q: dict, r: dict, k: int) -> pa.Table:
    """The k best references of each class, ties to the smaller id; ``r`` is in the order of classes and ids."""
    classes, starts = np.unique(r["cls"], return_index=True)
    out: list[list] = [[], [], [], []]
    for c, first, end in zip(classes, starts, [*starts[1:], len(r["cls"])], strict=True):
        part = s[:, first:end]
        if k > 1:
            i, j = best_of_rows(part, k, r["id"][first:end])
        else:
            j = part.argmax(axis=1)
            i = np.flatnonzero(np.isfinite(part[np.arange(len(part)), j]))
            j = j[i]
        for column, x in zip(out, (q["id"][i], np.full(len(i), c), r["id"][first + j], part[i, j]), strict=True):
            column.append(x)
    return pa.table({n: np.concatenate(x) if x else np.zeros(0, t) for n, x, t in zip(("q", "cls", "ref", "score"), out, (np.int64, np.int32, np.int64, float), strict=True)})


def _best_overall(s: np.ndarray, q: dict, r: dict, k: int) -> pa.Table:
    i, j = best_of_rows(s, k, r["id"])
    return pa.table({"q": q["id"][i], "cls": r["cls"][j], "ref": r["id"][j], "score": s[i, j]})


def _pick(s: np.ndarray, q: dict, r: dict, k: int) -> pa.Table:
    """The best reference of all, ties to the smaller class and then id; ``r`` is in that order."""
    j = s.argmax(axis=1)
    i = np.flatnonzero(np.isfinite(s[np.arange(len(s)), j]))
    j = j[i]
    return pa.table({"q": q["id"][i], "cls": r["cls"][j], "ref": r["id"][j], "score": s[i, j]})


def _over(s: np.ndarray, q: dict, r: dict, least: float) -> pa.Table:
    i, j = np.nonzero(s >= least)
    return pa.table({"q": q["id"][i], "cls": r["cls"][j], "ref": r["id"][j], "score": s[i, j]})


REDUCTIONS = {"class": _best_of_class, "overall": _best_overall, "pick": _pick, "over": _over}


def _take(x: dict, rows: slice | np.ndarray) -> dict:
    return {c: a[rows] for c, a in x.items()}


def block_of(a: pa.Table, b: pa.Table, rule: Callable, reduce: Callable, schema: pa.Schema) -> pa.Table:
    """``reduce(scores, q, r)`` over two blocks, some queries at a time into one product; the references are in the order of classes and ids."""
    every, r, parts = _arrays(a), _arrays(b), []
    r = _take(r, np.lexsort((r["id"], r["cls"])))
    slab = max(1, min(SLAB, CELLS // b.num_rows))
    across, room = np.ascontiguousarray(r["v"].T), np.empty((min(slab, a.num_rows), b.num_rows))
    unsound = ~np.isfinite(r["v"]).all(1)
    for first in range(0, a.num_rows, slab):
        q = _take(every, slice(first, first + slab))
        s = np.matmul(q["v"], across, out=room[: len(q["v"])])
        out = rule(q, r)
        if out is not None:
            np.copyto(s, -np.inf, where=out)
        s[:, unsound] = s[~np.isfinite(q["v"]).all(1)] = -np.inf
        parts.append(reduce(s, q, r).cast(schema))
    return pa.concat_tables(parts)


def best_of_block(a: pa.Table, b: pa.Table, rule: Callable, keep: str, schema: pa.Schema) -> pa.Table:
    """:func:`block_of` for the best reference (``keep`` is ``class`` or ``pick``) by a rule of ``BY_GROUP``.

    Products in single precision say which references come close to the best, and only
    their cosines are taken in double precision.  References lie in runs of one class and
    sighting, so a rule is applied to the largest number of each run, never to a pair.
    Where runs are short, or many references come as close, all is in double precision.
    """
    slow = lambda x: block_of(x, b, rule, lambda s, q, r: REDUCTIONS[keep](s, q, r, 1), schema)
    every, r = _arrays(a), _arrays(b)
    r = _take(r, np.isfinite(r["v"]).all(1))
    r = _take(r, np.lexsort((r["id"], r["grp"], r["cls"])))
    n, m = len(every["id"]), len(r["id"])
    if not m:
        return schema.empty_table()
    first_of = lambda *keys: np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
    starts = first_of(r["cls"], r["grp"])
    if len(starts) * LEAST_RUN > m:
        return slow(a)
    runs, spans = _take(r, starts), list(zip(starts, [*starts[1:], m], strict=True))
    classes = first_of(runs["cls"]) if keep == "class" else np.zeros(1, np.int64)
    of_run = np.searchsorted(classes, np.arange(len(runs["cls"])), "right") - 1
    # Twice what a product of unit vectors may be off in single precision, and some.
    margin = np.float32((r["v"].shape[1] + 8) * 2.0**-22)
    theirs, step, parts = r["v"].astype(np.float32), max(64, min(SLAB, CELLS // m)), []
    room = np.empty(m * min(step, n), np.float32)
    for first in range(0, n, step):
        q = _take(every, slice(first, first + step))
        sound = np.isfinite(q["v"]).all(1)
        q = q if sound.all() else _take(q, sound)
        own = np.ascontiguousarray(q["v"].T.astype(np.float32))
        s = np.matmul(theirs, own, out=room[: m * len(q["v"])].reshape(m, -1))
        most = np.empty((len(spans), len(q["v"])), np.float32)
        for x, (start, end) in enumerate(spans):
            np.maximum.reduce(s[start:end], axis=0, out=most[x])
        out = rule(q, runs)
        if out is not None:
            most[out.T] = -np.inf
        least = (np.maximum.reduceat(most, classes, axis=0) - margin)[of_run]
        near, found, held = (most >= least) & np.isfinite(most), [], 0
        for x, (start, end) in enumerate(spans):
            rows = np.flatnonzero(near[x])
            j, i = np.nonzero(s[start:end].take(rows, axis=1) >= least[x, rows])
            found.append((rows[i], j + start))
            held += len(i)
            if held > CLOSE * len(classes) * step:
                break
        if held > CLOSE * len(classes) * step:
            parts.append(slow(a.slice(first, step)))
            continue
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        score = np.einsum("ij,ij->i", q["v"][i], r["v"][j])
        cls, ref = r["cls"][j], r["id"][j]
        order = np.lexsort((ref, -score, cls, i) if keep == "class" else (ref, cls, -score, i))
        order = order[first_of(i[order], cls[order]) if keep == "class" else first_of(i[order])] if len(i) else order
        parts.append(pa.table({"q": q["id"][i[order]], "cls": cls[order], "ref": ref[order], "score": score[order]}).cast(schema))
    return pa.concat_tables(parts)


def grid(queries: DataFrame, refs: DataFrame, exclude: str | Callable, reduce: Callable, schema: str, block: int | None = None) -> tuple[DataFrame, int]:
    """``reduce(scores, q, r)`` over all pairs of blocks, where the scores of left-out pairs are minus infinity; and the number of reference blocks.

    ``reduce`` sees some queries of a block with all references of another, in the order of
    classes and ids, and returns the columns of ``schema``; the scores are its own only
    until it returns.  A rule that leaves out all other classes (by its attribute ``own_class``
    where it isn't named) has blocks of a query's own class only.
    """
    rule = EXCLUSIONS[exclude] if isinstance(exclude, str) else exclude
    own = exclude == "sighting_or_other_class" or getattr(rule, "own_class", False)
    return cells(queries, refs, lambda a, b, arrow: block_of(a, b, rule, reduce, arrow), schema, block, own)


def cells(queries: DataFrame, refs: DataFrame, compare: Callable, schema: str, block: int | None = None, own_class: bool = False, most: int = MOST_BLOCK) -> tuple[DataFrame, int]:
    """``compare(a, b, arrow schema)`` of all pairs of blocks, or of those where a query meets references of its own class, in blocks of up to ``most`` rows; and the number of reference blocks."""
    part = F.pmod(F.xxhash64("cls"), F.lit(CLASS_PARTS)).cast("int") if own_class else F.lit(0)
    queries, refs = queries.withColumn("cb", part), refs.withColumn("cb", part)
    each = lambda f: f.groupBy("cb").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"))
    size = lambda f, name: each(f).agg(F.max("n").alias(name), F.max("dim").alias(name + "dim"), F.count(F.lit(1)).alias(name + "parts"))
    counts = size(queries, "n").crossJoin(size(refs, "m")).first()
    dim, n, m, deals = max(counts.ndim or 1, counts.mdim or 1), counts.n or 0, counts.m or 0, max(1, counts.mparts)
    block = block or block_rows(n, m, dim, -(-queries.sparkSession.sparkContext.defaultParallelism // deals), most)
    nq, nr = max(1, -(-n // block)), max(1, -(-m // block))
    deal = lambda f, own, n, other, m: f.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(queries, "qb", nq, "rb", nr), deal(refs, "rb", nr, "qb", nq)
    right = right.select([F.col(c).alias("r_" + c) for c in right.columns])  # a gallery scored against itself needs names of its own
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    # Cells are much work and few bytes, so they are dealt here and not put together by bytes.
    tasks = min(MOST_TASKS, 2 * deals * nq * nr)
    keys = ("cb", "qb", "rb")
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *["r_" + c for c in keys])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        return compare(a, b.rename_columns([c[2:] for c in b.column_names]), arrow)

    return left.groupBy(*keys).cogroup(right.groupBy(*["r_" + c for c in keys])).applyInArrow(cell, schema), nr


def score(queries: DataFrame, refs: DataFrame, exclude: str | Callable = "sighting", keep: str = "class", k: float = 1, block: int | None = None) -> DataFrame:
    """``(q, cls, ref, score)``: cosines of queries with references.

    ``keep`` is ``class`` (the k best references of each class and query), ``overall``
    (the k best of a query), ``pick`` (the best of a query, ties to the smaller class) or
    ``over`` (all of k or more).  Ties go to the smaller id.
    """
    kept, schema = REDUCTIONS[keep], "q long, cls int, ref long, score double"
    if exclude in BY_GROUP and keep in ("class", "pick") and k == 1:
        rule = EXCLUSIONS[exclude]
        part, nr = cells(queries, refs, lambda a, b, arrow: best_of_block(a, b, rule, keep, arrow), schema, block, exclude == "sighting_or_other_class", WIDE_BLOCK)
    else:
        part, nr = grid(queries, refs, exclude, lambda s, q, r: kept(s, q, r, k), schema, block)
    if keep == "over" or nr == 1:
        return part
    order = [F.desc("score"), *(["cls"] if keep == "pick" else []), "ref"]
    by = Window.partitionBy(*(("q", "cls") if keep == "class" else ("q",))).orderBy(*order)
    return part.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).drop("n")


def _sums_of_sighting(least: float) -> Callable:
    def run(s: np.ndarray, q: dict, r: dict) -> pa.Table:
        groups, code = np.unique(r["grp"], return_inverse=True)
        open_ = np.isfinite(s)
        member = np.eye(len(groups))[code]
        met, strong, total = open_ @ member, (s >= least) @ member, np.where(open_, s, 0.0) @ member
        i, j = np.nonzero(met)
        return pa.table({"id": q["id"][i], "rgrp": groups[j], "strong": strong[i, j].astype(np.int64), "total": total[i, j]})

    return run


def by_sighting(gallery: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """``(id, rgrp, strong, total)``: for each photo and each other sighting of its class, how many of its photos match with ``least`` or more and the sum of all scores."""
    part, nr = grid(gallery, gallery, "sighting_or_other_class", _sums_of_sighting(least), "id long, rgrp long, strong long, total double", block)
    return part if nr == 1 else part.groupBy("id", "rgrp").agg(F.sum("strong").alias("strong"), F.sum("total").alias("total"))


def _best_of_sighting(s: np.ndarray, q: dict, r: dict) -> pa.Table:
    """For each query and sighting the best score, the fewest days between and the first day of the references that are left."""
    out: list[list] = [[], [], [], [], []]
    for g in np.unique(r["grp"]):
        own = np.flatnonzero(r["grp"] == g)
        part, day = s[:, own], r["day"][own]
        open_ = np.isfinite(part)
        i = np.flatnonzero(open_.any(1))
        far = np.iinfo(np.int64).max
        gap = np.where(open_[i], np.abs(q["day"][i, None] - day[None]), far).min(1, initial=far)
        first = np.where(open_[i], day[None], far).min(1, initial=far)
        for column, x in zip(out, (q["id"][i], np.full(len(i), g), part[i].max(1, initial=-np.inf), gap, first), strict=True):
            column.append(x)
    return pa.table({n: np.concatenate(x) for n, x in zip(("q", "rgrp", "own", "gap", "rday"), out, strict=True)})


def best_of_other_sightings(gallery: DataFrame, block: int | None = None) -> DataFrame:
    """``(q, rgrp, own, gap, rday)`` for ``gallery`` with days: each photo's best score with each other sighting of its class, the days to the nearest of its photos and its first day; a block leaves a row a photo and sighting."""
    part, nr = grid(gallery, gallery, "sighting_or_other_class", _best_of_sighting, "q long, rgrp long, own double, gap long, rday long", block)
    return part if nr == 1 else part.groupBy("q", "rgrp").agg(F.max("own").alias("own"), F.min("gap").alias("gap"), F.min("rday").alias("rday"))


def _best_by_years(years: list[int]) -> Callable:
    def run(s: np.ndarray, q: dict, r: dict) -> pa.Table:
        classes, starts = np.unique(r["cls"], return_index=True)
        best = np.maximum.reduceat(s, starts, axis=1)
        own = np.full((len(years), len(s)), -np.inf)
        for c, first, end in zip(classes, starts, [*starts[1:], len(r["cls"])], strict=True):
            i = np.flatnonzero(q["cls"] == c)
            best[i, np.searchsorted(classes, c)] = -np.inf
            part, days = s[i, first:end], np.abs(q["day"][i, None] - r["day"][None, first:end])
            part[q["grp"][i, None] == r["grp"][None, first:end]] = -np.inf
            for y, row in zip(years, own, strict=True):
                row[i] = part.max(1, where=days >= 365 * y, initial=-np.inf)
        j = best.argmax(1)  # of equal classes the smallest
        other = best[np.arange(len(best)), j]
        sure = lambda x: pa.array(x, mask=~np.isfinite(x))
        return pa.table({"q": q["id"], "cls": q["cls"], "other": sure(other), "other_cls": pa.array(classes[j], mask=~np.isfinite(other)), **{f"own_{y}": sure(x) for y, x in zip(years, own, strict=True)}})

    return run


def best_by_years(gallery: DataFrame, years: list[int], block: int | None = None) -> DataFrame:
    """``(q, cls, other, other_cls, own_<y> ...)`` for ``gallery`` with days: each photo's best score with another class, of equal ones the smallest, and with its own by the rule of :func:`years_apart` for each of ``years``; null without a reference.

    All years are reduced from one matrix product; a block leaves a row a photo.
    """
    schema = "q long, cls int, other double, other_cls int, " + ", ".join(f"own_{y} double" for y in years)
    part, _ = grid(gallery, gallery, "none", _best_by_years(years), schema, block)
    first = F.max(F.when(F.col("other").isNotNull(), F.struct("other", (-F.col("other_cls")).alias("c")))).alias("x")
    best = part.groupBy("q", "cls").agg(first, *[F.max(f"own_{y}").alias(f"own_{y}") for y in years])
    return best.select("q", "cls", F.col("x.other").alias("other"), (-F.col("x.c")).alias("other_cls"), *[f"own_{y}" for y in years])


def top_classes(best: DataFrame, k: int = 5) -> DataFrame:
    """The k best classes of each query: score first, then class."""
    by = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def with_other_sighting(gallery: DataFrame) -> DataFrame:
    """Rows whose class has a row of another sighting."""
    per = gallery.groupBy("cls").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi")
    return gallery.join(per, "cls", "left_semi")


def knn_votes(nearest: DataFrame) -> DataFrame:
    """Sum of the similarities of a query's nearest references, by class; only classes with a positive vote."""
    return nearest.groupBy("q", "cls").agg(F.sum("score").alias("score")).filter("score > 0")


def centroids(gallery: DataFrame) -> DataFrame:
    """A row for each class: the mean of its unit vectors, as ``id = cls, v``.  Means are per component, combined map-side."""
    from lynceus.functions.vectors import doubles, unit

    parts = gallery.select("cls", F.posexplode(unit(doubles("v"))).alias("i", "x")).groupBy("cls", "i").agg(F.avg("x").alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x)
    return parts.groupBy("cls").agg(v.alias("v")).select(F.col("cls").cast("long").alias("id"), "cls", F.lit(-1).cast("long").alias("grp"), "v")


def fuse(spot: DataFrame, emb: DataFrame, weight: float = 1.0, spot_weight: float = 1.0) -> DataFrame:
    """``spot_weight * log1p(best spot score) + weight * best similarity`` for each query and class; without spots 0, without a vector -1."""
    both = spot.select("q", "cls", F.col("score").alias("s")).join(emb.select("q", "cls", F.col("score").alias("e")), ["q", "cls"], "full")
    value = F.lit(float(spot_weight)) * F.log1p(F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0))) + F.lit(float(weight)) * F.coalesce("e", F.lit(-1.0))
    return both.select("q", "cls", value.alias("score"))
