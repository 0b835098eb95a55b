"""Projections and learned scores.

Everything that grows with the gallery is an aggregate: sums and outer products are
added up in tasks, parts meet in groups, classes are shrunk and weighed before they
leave them, and the driver gets one matrix of dim x dim, whose eigenproblem it solves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.prefix import running_before
from lynceus.sources.scratch import cut


def _array(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _added(parts: DataFrame, *by: str) -> DataFrame:
    """The sums of ``parts(*by, n, x array)`` as one row a key; a key has a part a task at most."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n double, x array<double>"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = _array(t.column("x")).sum(0)
        out = {c: pa.array([k.as_py()]) for c, k in zip(by, key, strict=True)}
        return pa.table(out | {"n": pa.array([float(np.sum(t.column("n").to_numpy()))]), "x": pa.array([x.tolist()], pa.list_(pa.float64()))}).cast(pa.schema([(c, t.schema.field(c).type) for c in by] + [("n", pa.float64()), ("x", pa.list_(pa.float64()))]))

    return parts.groupBy(*by).applyInArrow(run, schema)


def total_moments(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of ``rows(v)``; classes play no part.  A task sends each row of its matrix once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, acc = 0, None
        for b in batches:
            if b.num_rows:
                x = _array(b.column("v"))
                one = np.hstack((x, np.ones((len(x), 1))))
                acc = one.T @ one if acc is None else acc + one.T @ one
                n += len(x)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc), dtype=np.int32)), pa.array(np.full(len(acc), float(n))), pa.array(acc.tolist(), pa.list_(pa.float64()))], names=["i", "n", "x"])

    got = _added(rows.select("v").mapInArrow(run, "i int, n double, x array<double>"), "i").orderBy("i").collect()  # dim + 1 rows of dim + 1 numbers
    m = np.array([r.x for r in got])
    return got[0].n, m[-1, :-1], m[:-1, :-1]


def fit_pca(rows: DataFrame, dim: int, whiten: bool = False) -> Callable:
    """Centred projection to the leading directions of the covariance; at most min(dim, n, p) of them."""
    n, s, o = total_moments(rows)
    mean = s / n
    values, vectors = np.linalg.eigh(o / n - np.outer(mean, mean))
    keep = np.argsort(-values)[: int(min(dim, n, len(mean)))]
    w = vectors[:, keep] * (1 / np.sqrt(np.maximum(values[keep] * n / max(1, n - 1), 1e-12)) if whiten else 1.0)
    return lambda x: (x - mean) @ w


def shrunk(cov: np.ndarray, n: float, fourth: float) -> np.ndarray:
    """Ledoit-Wolf shrinkage towards the mean variance; ``fourth`` is the sum over rows of the squared squared norm."""
    p = len(cov)
    mu = np.trace(cov) / p
    delta = ((cov**2).sum() - 2 * mu * np.trace(cov) + p * mu * mu) / p
    beta = min((fourth / n - (cov**2).sum()) / (n * p), delta)
    share = 0.0 if beta <= 0 else beta / delta
    return (1 - share) * cov + share * mu * np.eye(p)


#: The key under which all rows together are a class.
EVERYTHING = -1


def shrunk_covariances(rows: DataFrame, transform: Callable) -> DataFrame:
    """``(cls, n, x)``: each class's covariance, shrunk after its components were scaled to unit variance and scaled back; ``EVERYTHING`` is that of all rows.

    Each task adds up its rows of a class, sums of a class meet in one group, and a second
    pass over the rows adds up their fourth moments; a large class is many parts.
    """
    both = rows.select("cls", "v").unionAll(rows.select(F.lit(EVERYTHING).cast(rows.schema["cls"].dataType).alias("cls"), "v"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, cls = transform(_array(b.column("v"))), b.column("cls").to_numpy()
            for c in np.unique(cls):
                own = np.hstack((x[cls == c], np.ones((int((cls == c).sum()), 1))))
                acc[c] = acc.get(c, 0.0) + own.T @ own
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(acc), np.int32)), pa.array([m[-1, -1] for m in acc.values()]), pa.array([m.ravel().tolist() for m in acc.values()], pa.list_(pa.float64()))], names=["cls", "n", "x"])

    sums = cut(_added(both.mapInArrow(moments, "cls int, n double, x array<double>"), "cls"))
    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = int(np.sqrt(m.size) + 0.5)
        m = m.reshape(d, d)
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        cov = m[:-1, :-1] / n - np.outer(mean, mean)
        var = np.diag(cov)
        scale = np.where(var > 10 * np.finfo(float).eps * np.maximum(1, mean * mean), np.sqrt(np.maximum(var, 0)), 1.0)
        return mean, cov, scale

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [parts(np.array(m.as_py())) for m in b.column("x")]
            yield pa.RecordBatch.from_arrays([b.column("cls"), *(pa.array([p[i].tolist() for p in each], pa.list_(pa.float64())) for i in (0, 2))], names=["cls", "mean", "scale"])

    # A row meets its class's mean and scale, two vectors, not its matrix.
    known = both.join(cut(sums.select("cls", "x").mapInArrow(centre, "cls int, mean array<double>, scale array<double>")), "cls")

    def fourths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, cls = transform(_array(b.column("v"))), b.column("cls").to_numpy()
            sums_ = ((((x - _array(b.column("mean"))) / _array(b.column("scale"))) ** 2).sum(1)) ** 2
            for c in np.unique(cls):
                acc[c] = acc.get(c, 0.0) + float(sums_[cls == c].sum())
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(acc), np.int32)), pa.array(list(acc.values()))], names=["cls", "f"])

    fourth = known.select("cls", "v", "mean", "scale").mapInArrow(fourths, "cls int, f double").groupBy("cls").agg(F.sum("f").alias("f"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, m, f in zip(*(b.column(c) for c in ("n", "x", "f")), strict=True):
                _, cov, scale = parts(np.array(m.as_py()))
                out.append((shrunk(cov / np.outer(scale, scale), n.as_py(), f.as_py()) * np.outer(scale, scale)).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("n"), pa.array(out, pa.list_(pa.float64()))], names=["cls", "n", "x"])

    return sums.join(fourth, "cls").select("cls", "n", "x", "f").mapInArrow(finish, "cls int, n double, x array<double>")


def fit_lda(rows: DataFrame, pca_dim: int = 128) -> Callable:
    """PCA, then the directions that part the classes: between against within covariance, where within is the mean of the classes'
    shrunk covariances by their shares of the rows and between is the shrunk covariance of all rows less that; at most classes - 1."""
    first = fit_pca(rows, pca_dim)
    covs = cut(shrunk_covariances(rows, first))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _array(b.column("x")), b.column("n").to_numpy()
            every = b.column("cls").to_numpy() == EVERYTHING
            for kind, own in (("all", every), ("within", ~every)):
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([float(own.sum())]), pa.array([(x[own] * n[own][:, None]).sum(0).tolist()], pa.list_(pa.float64()))], names=["kind", "n", "x"])

    got = {r.kind: r for r in _added(covs.mapInArrow(weigh, "kind string, n double, x array<double>"), "kind").collect()}  # two matrices of the projection's size
    n = covs.filter(F.col("cls") == EVERYTHING).first().n
    d = int(np.sqrt(len(got["all"].x)) + 0.5)
    total, within = (np.array(got[k].x).reshape(d, d) / n for k in ("all", "within"))
    root = np.linalg.cholesky(within + 1e-12 * np.trace(within) / d * np.eye(d))
    inverse = np.linalg.inv(root)
    values, vectors = np.linalg.eigh(inverse @ (total - within) @ inverse.T)
    keep = np.argsort(-values)[: int(max(1, min(d, got["within"].n - 1)))]
    w = inverse.T @ vectors[:, keep]
    return lambda x: first(x) @ w


def project(rows: DataFrame, f: Callable) -> DataFrame:
    """``rows`` with ``v`` replaced by the unit vectors of its projection."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        x = f(np.stack(v.to_numpy()).astype(np.float64)) if len(v) else np.zeros((0, 1))
        return pd.Series(list(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)))

    return rows.withColumn("v", run("v"))


def deal_sizes(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """``(size, first rank, folds in turn)`` for groups dealt from the largest, each to the lightest fold (the first of equal ones).

    ``sizes`` is ``(size, groups)``.  Folds that differ by less than the size take groups of
    that size in one order, so no list is as long as the groups are many.
    """
    load, out = [0] * k, []
    for size, groups in sorted(sizes, reverse=True):
        rank = 0
        while rank < groups:
            order = sorted(range(k), key=lambda i: (load[i], i))
            low = [i for i in order if load[i] - load[order[0]] < size]
            if len(low) == k:
                take = groups - rank
            else:  # the lightest folds go round among themselves until they come up to the next one
                take = min(groups - rank, max(1, (load[order[len(low)]] - load[low[-1]]) // size * len(low)))
            out.append((size, rank, low))
            whole, rest = divmod(take, len(low))
            for place, i in enumerate(low):
                load[i] += size * (whole + (place < rest))
            rank += take
    return out


def folds(rows: DataFrame, k: int) -> DataFrame:
    """``(grp, fold)``: whole groups, from the largest, each to the fold with the fewest rows so far; of equally large ones the last name first.

    The order of dealing depends on sizes alone, so only the histogram of sizes reaches
    the driver; a group's rank among equal sizes is a running sum over ranges.
    """
    size = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    counts = [(r.n, r["count"]) for r in size.groupBy("n").count().collect()]
    dealt = deal_sizes(counts, k)
    upto, seen = {}, 0
    for n, m in sorted(counts):
        seen += m
        upto[n] = seen
    turns = rows.sparkSession.createDataFrame([(n, start, order, upto[n]) for n, start, order in dealt] or [(0, 0, [0], 0)], "n long, start long, turn array<int>, upto long")
    placed = running_before(size.select("grp", "n", F.struct("n", "grp").alias("o"), F.lit(1).alias("one")), "o", ["one"])
    own = placed.join(turns, "n").withColumn("rank", F.col("upto") - 1 - F.col("before_one")).filter(F.col("rank") >= F.col("start"))
    last = own.groupBy("grp").agg(F.max(F.struct("start", "turn", "rank")).alias("x"))
    return last.select("grp", F.get("x.turn", ((F.col("x.rank") - F.col("x.start")) % F.size("x.turn")).cast("int")).alias("fold"))


def out_of_fold(rows: DataFrame, fit: Callable[[DataFrame], Callable], k: int, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Scores of each fold's rows against all rows in a space that was fit without the fold."""
    from functools import reduce

    dealt = rows.join(folds(rows, k), "grp")
    parts = []
    for i in range(k):
        f = fit(dealt.filter(F.col("fold") != i))
        space = project(dealt, f).select(*rows.columns, "fold")
        parts.append(score(space.filter(F.col("fold") == i).drop("fold"), space.drop("fold")))
    return reduce(DataFrame.unionAll, parts)


def kmeans(rows: DataFrame, k: int, seed: int = 0, starts: int = 10) -> DataFrame:
    """``(id, cluster, rank)``: Lloyd's clusters, the cheapest of ``starts`` runs, and each row's place by closeness to its centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = rows.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features")).persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=20, initSteps=5).fit(x) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = F.array(*[F.array(*[F.lit(float(c)) for c in centre]) for centre in model.clusterCenters()])
    got = model.transform(x).select("id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("v"))
    gap = F.aggregate(F.zip_with("v", F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)
    got = got.withColumn("gap", gap).select("id", "cluster", F.struct("cluster", "gap", "id").alias("o"), F.lit(1).alias("one"))
    placed = cut(running_before(got, "o", ["one"]))  # no task sorts a cluster
    x.unpersist()
    first = placed.groupBy("cluster").agg(F.min("before_one").alias("first"))
    return placed.join(first, "cluster").select("id", "cluster", (F.col("before_one") - F.col("first") + 1).cast("int").alias("rank"))


def logistic_scores(train: DataFrame, ask: DataFrame, c: float = 1.0, balanced: bool = True) -> DataFrame:
    """``(q, cls, score)``: each class's probability by a multinomial logistic regression over the vectors of ``train(cls, v)``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sizes = sorted((r.cls, r["count"]) for r in train.groupBy("cls").count().collect())  # a row a class, as the model has
    n, codes = sum(m for _, m in sizes), [k for k, _ in sizes]
    weights = [n / (len(sizes) * m) if balanced else 1.0 for _, m in sizes]
    # From Arrow, which needs no Python on the executors.
    known = train.sparkSession.createDataFrame(pa.table({"cls": pa.array(codes, pa.int32()), "label": np.arange(len(sizes), dtype=float), "w": pa.array(weights, pa.float64())}))
    x = train.join(F.broadcast(known), "cls").select("label", "w", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = LogisticRegression(family="multinomial", regParam=1.0 / (c * n), weightCol="w", standardization=False, maxIter=500, tol=1e-9).fit(x)
    got = model.transform(ask.select(F.col("id").alias("q"), array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    each = got.select("q", F.posexplode(vector_to_array("probability")).alias("i", "score"))
    return each.select("q", F.element_at(F.array(*[F.lit(k) for k in codes]), F.col("i") + 1).alias("cls"), "score")


def logistic(rows: DataFrame, columns: list[str], label: str, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """Coefficients of a logistic regression as rows ``(term, weight)``; classes weigh the same if balanced."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.select(*columns, F.col(label).cast("double").alias("label")))
    counts = {r.label: r["count"] for r in x.groupBy("label").count().collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.element_at(F.create_map(*[F.lit(v) for kv in ((float(k), n / (len(counts) * m)) for k, m in counts.items()) for v in kv]), F.col("label"))
    model = LogisticRegression(regParam=1.0 / (c * n), weightCol="w", standardization=False, maxIter=200, tol=1e-10).fit(x.withColumn("w", weight))
    rows_out = [*zip(columns, map(float, model.coefficients), strict=True), ("constant", float(model.intercept))]
    return rows.sparkSession.createDataFrame(rows_out, "term string, weight double")
