"""Centroid clustering with Hamerly's bounds, exact in integers.

A vector's components become integers once.  Each round is one pass over a table that
holds, beside the vector and its cluster, one upper bound of the distance to its own
centroid and one lower bound of the distance to any other:

* after a move of the centroids the upper bound grows by its own centroid's drift and
  the lower bound shrinks by the largest drift of the others;
* a vector whose upper bound is below its lower bound, or below half the distance of its
  centroid to the next, stays where it is without looking at any centroid;
* any other has its own distance measured, and where that doesn't settle it, all of
  them, in whole 64-bit numbers.  A tie goes to the smaller number, so bounds that only
  meet settle nothing.

Bounds are rounded outwards, distances that decide are whole numbers.  Tasks add up only
what has moved, a row a cluster, so nothing is shuffled but ``k x dim`` sums a task;
only ``k x dim`` numbers reach the driver.  The rows of a task are written with its sums
as one Parquet table in the shared folder; a lost executor costs its running tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import PREFIX, RID, Scratch, with_row_id, without

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Largest integer of a component: with up to 64 of them a squared distance is below 2 ** 62.
LARGEST = 1 << 27
#: Bounds are doubles and rounded outwards by this share.
OUTWARD = 1e-12

_ID, _X, _UPPER, _LOWER = (PREFIX + x for x in ("id", "x", "upper", "lower"))
_COUNT, _SUM, _SCANS = (PREFIX + x for x in ("count", "sum", "scans"))
_STATE = f"cluster int, `{_X}` binary, `{_UPPER}` double, `{_LOWER}` double, distance long, `{_COUNT}` long, `{_SUM}` array<long>, `{_SCANS}` long"
_KINDS = (pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())


def quantised(vector: str, dim: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and ``floor(scale * x)`` of its components as doubles."""
    doubles = F.col(vector).cast("array<double>")
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    return (F.size(vector) == dim) & F.coalesce(sound, F.lit(False)), F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``c``, one centroid or one a row, in whole numbers."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def _geometry(centroids: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each centroid moved and the farthest move of all others, rounded up; half of each centroid's distance to the next, rounded down."""
    k = len(centroids)
    drift = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(np.float64)) * (1 + OUTWARD)
    others = np.array([max([drift[j] for j in range(k) if j != i], default=0.0) for i in range(k)])
    gaps = np.array([min([float(squared(centroids[j : j + 1], c)[0]) for j in range(k) if j != i], default=np.inf) for i, c in enumerate(centroids)])
    return drift, others, np.sqrt(gaps) / 2 * (1 - OUTWARD)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid, the smaller number of equally near ones, and a lower bound of the distance to the others."""
    d = np.stack([squared(x, c) for c in centroids], axis=1)
    own, at = d.argmin(axis=1), np.arange(len(x))
    least = d[at, own]
    rest = d.astype(np.float64)
    rest[at, own] = np.inf
    return own.astype(np.int32), least, np.sqrt(rest.min(axis=1)) * (1 - OUTWARD)


def _pass(kept: list[str], dim: int, centroids: np.ndarray, before: np.ndarray | None, last: bool):
    """One round: the rows with their clusters and bounds, and at the end of a task a row a cluster of what it gained.  Without ``before`` there are no clusters yet."""
    k, first = len(centroids), before is None
    drift, others, half = _geometry(centroids, before)
    names = [*kept, "cluster", _X, _UPPER, _LOWER, "distance", _COUNT, _SUM, _SCANS]

    def assign(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        if first:
            cluster, least, lower = nearest(x, centroids)
            return cluster, np.sqrt(least.astype(np.float64)) * (1 + OUTWARD), lower, np.full(len(x), -1), len(x)
        old = b.column("cluster").to_numpy()
        upper = (b.column(_UPPER).to_numpy() + drift[old]) * (1 + OUTWARD)
        lower = (b.column(_LOWER).to_numpy() - others[old]) * (1 - OUTWARD)
        settled = np.maximum(lower, half[old])
        cluster, open_ = old.copy(), np.flatnonzero(~(upper < settled))
        upper[open_] = np.sqrt(squared(x[open_], centroids[old[open_]]).astype(np.float64)) * (1 + OUTWARD)
        open_ = open_[~(upper[open_] < settled[open_])]
        if len(open_):
            cluster[open_], least, lower[open_] = nearest(x[open_], centroids)
            upper[open_] = np.sqrt(least.astype(np.float64)) * (1 + OUTWARD)
        return cluster, upper, lower, old, len(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, scans = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        kinds = None
        for b in batches:
            if not b.num_rows:
                continue
            kinds = [b.schema.field(c).type for c in kept]
            if first:
                x = b.column(_X).flatten().to_numpy().reshape(-1, dim)
                packed = pa.array([row.tobytes() for row in x.astype("<i4")], pa.binary())
            else:
                packed = b.column(_X)
                x = np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
            cluster, upper, lower, old, scanned = assign(b, x)
            scans += scanned
            for moved, sign in ((cluster, 1), (old, -1)):
                for c in np.unique(moved[cluster != old]):
                    own = (moved == c) & (cluster != old)
                    if c >= 0:
                        count[c] += sign * int(own.sum())
                        total[c] += sign * x[own].sum(axis=0)
            distance = pa.array(squared(x, centroids[cluster])) if last else pa.nulls(len(x), pa.int64())
            own = [*(b.column(c) for c in kept), pa.array(cluster.astype(np.int32)), packed, pa.array(upper), pa.array(lower), distance]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(x), t) for t in _KINDS[5:])], names=names)
        if kinds is not None:
            sums = [pa.array(count), pa.array(total.tolist(), _KINDS[6]), pa.array([scans] + [0] * (k - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds), pa.array(np.arange(k, dtype=np.int32)), *(pa.nulls(k, t) for t in _KINDS[1:5]), *sums], names=names)

    return run


def seeds(kept: DataFrame, vec_id: str, k: int, dim: int, seed: int) -> np.ndarray:
    """The vectors of the smallest ``sha256("seed:id")`` in that order; of equal hashes the smaller vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))).cast("binary"), 256)
    got = kept.select(order.alias("h"), _X).orderBy("h", _X).limit(k).collect()  # k vectors
    return np.array([r[1] for r in got], np.int64).reshape(-1, dim)


def means(count: np.ndarray, total: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``floor(sum / count)``, exactly; the old centroid where the cluster is empty."""
    return np.array([[int(s) // int(n) for s in row] if n else old for n, row, old in zip(count, total, centroids.tolist(), strict=True)], np.int64)


def cluster(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, scans: list | None = None) -> DataFrame:
    """The kept rows of ``vectors``, without the vector, with ``cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; the others,
    and those with a component of ``LARGEST / scale`` or more, whose squared distances
    would not fit a long, give no row.  ``dim`` is at most 64 for the same reason.
    Repeated rows are vectors each; a null id counts as the empty string where the first
    centroids are drawn; fewer vectors than ``k`` make fewer clusters.  Empty clusters
    keep their centroid.  Inertia over the range of a long is null.  An empty table gives
    an empty table; input columns named like an output are replaced.  ``scans`` is given
    the number of full scans of each pass.
    """
    if not 0 < dim <= DIM or k < 1:
        raise ValueError(f"dim is 1 to {DIM}, k at least 1")
    scratch = Scratch(vectors.sparkSession, "centroids")
    rows = without(vectors, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    sound, whole = quantised(vector, dim, scale)
    # Columns beside vector and id aren't carried through the passes; they are joined back by row number.
    extra = [c for c in rows.columns if c not in (vector, vec_id)]
    kept = with_row_id(scratch, rows.filter(sound)) if extra else rows.filter(sound)
    carry = F.col(RID) if extra else F.col(vec_id)
    source = kept.select(carry.alias(_ID), F.col(vec_id), whole.alias(_X))
    centroids, before = seeds(source, vec_id, k, dim, seed), None
    outputs = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    if not len(centroids):
        return rows.filter(F.lit(False)).select(*[f"`{c}`" for c in rows.columns if c != vector], *[F.lit(None).cast(t).alias(c) for c, t in outputs.items()])
    schema = f"`{_ID}` {source.schema[_ID].dataType.simpleString()}, {_STATE}"
    state = source.select(_ID, _X)
    count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
    for turn in range(rounds + 1):
        last = turn == rounds
        state = scratch.save(state.mapInArrow(_pass([_ID], dim, centroids, before, last), schema), f"pass{turn}")
        if turn:
            scratch.drop(f"pass{turn - 1}")
        gained = state.filter(F.col(_COUNT).isNotNull())
        if scans is not None:
            scans.append(gained.agg(F.sum(_SCANS)).first()[0] or 0)
        if not last:
            got = gained.select("cluster", F.posexplode(F.concat(F.array(_COUNT), _SUM)).alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()  # k x (dim + 1) numbers
            for r in got:
                if r.i:
                    total[r.cluster, r.i - 1] += r.s
                else:
                    count[r.cluster] += r.s
            before, centroids = centroids, means(count, total, centroids)
        state = state.filter(F.col(_X).isNotNull())
    inertias = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # k rows
    inertia = None if None in inertias.values() or sum(inertias.values()) >= 1 << 63 else sum(inertias.values())
    named = [(i, inertias.get(i), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = state.select(_ID, "cluster", "distance").join(F.broadcast(named), "cluster")  # k rows
    if not extra:
        back = placed.withColumnRenamed(_ID, vec_id)
        return back.select(f"`{vec_id}`", *outputs)
    return kept.join(placed, kept[RID] == placed[_ID]).select(*[kept[f"`{c}`"] for c in rows.columns if c != vector], *outputs)


def op11(vectors: DataFrame) -> DataFrame:
    return cluster(vectors.select("vec_id", "embedding"))


def _sql() -> str:
    """Every round as plain SQL: all distances, the nearest, floored means."""
    gap = "list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS num, x AS m FROM v QUALIFY num < {CLUSTERS}
)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT vec_id, x, num, {gap} AS d FROM v CROSS JOIN c{i})")
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, num, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, num) = 1)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT num, i, sum(x[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {DIM + 1}) r(i) GROUP BY num, i)")
            steps.append(f"f{i} AS (SELECT num, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{i} GROUP BY num)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.num, coalesce(f{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN f{i} USING (num))")
    end = f"""SELECT vec_id, num::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY num))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (num)"""
    return "WITH " + ",\n".join(steps) + "\n" + end


OP11_SQL = _sql()
