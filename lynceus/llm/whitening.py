"""Embedding whitening from a tiled covariance.

Entries become integers once, so sums and deviations are exact.  The fit list has each
distinct vector once; its covariance is built in tiles:

* dimensions are cut into column blocks, the fit list into row-blocks of bounded size;
* each row-block is centred and its column blocks are shuffled to the tile keys
  ``(row-block, i, j)``, i <= j, that need them;
* a key multiplies its pair of blocks, and the products of a tile are added up by a
  tree of bounded fan-in;
* the driver assembles the tiles, ``dim x dim`` numbers, and solves the eigenproblem.

A row of the table is then projected where it lies.  No vector meets all others
anywhere, a vector that repeats is one row of the fit list before anything is shuffled
whole, and a group holds one row-block of two column blocks however long the table is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import PREFIX, Scratch, without

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Dimensions of a column block, numbers of a row-block, products that are added up in one group.
TILE, ROW_BLOCK, FAN_IN = 32, 1 << 22, 64
#: Entries are below this in size, so that their integers and sums of a few thousand of them are longs.
LARGEST = 1 << 46
#: Eigenvalues below this share of the largest are rounding.
RANK = 1e-13

_X = PREFIX + "x"
_LONGS = 1 << 63


@dataclass(frozen=True)
class Fit:
    """What a row needs to be whitened: ``n``, the exact sums, eigenvalues and their vectors as columns, the variance in all."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(vector: str, scale: int = SCALE, shift: int = SHIFT) -> tuple[Column, Column]:
    """Whether a vector can be used, and ``floor(scale * entry) + shift`` of its entries as doubles."""
    doubles = F.col(vector).cast("array<double>")
    sound = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LARGEST)))
    return F.coalesce(sound, F.lit(False)), F.transform(doubles, lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(shift))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, in longs where they fit and in Python's integers where not."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < _LONGS // 2:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` with the rounding of one division."""
    return deviations(x, n, sums).astype(np.float64) / n


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Count and sums of ``fit``; a task adds up its rows, the driver gets ``dim + 1`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [0] * (dim + 1)
        for b in batches:
            x = _matrix(b.column(_X), dim)
            acc[0] += len(x)
            for i in range(0, len(x), 1024):  # so many longs below LARGEST * SCALE have a long as their sum
                acc[1:] = [a + int(s) for a, s in zip(acc[1:], x[i : i + 1024].sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(map(str, acc), pa.string())], names=["i", "s"])

    got = fit.select(_X).mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r.i: int(r.s) for r in got}
    return sums.get(0, 0), [sums.get(i + 1, 0) for i in range(dim)]


def _column_blocks(dim: int, n: int, sums: list[int], tile: int, row_block: int):
    """Each row-block's centred column blocks, once for each tile key that needs them."""
    blocks, step = -(-dim // tile), max(1, row_block // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        for b in batches:
            for first in range(0, b.num_rows, step):
                x = centred(_matrix(b.column(_X).slice(first, step), dim), n, sums)
                rows, turn = (part << 32) + turn, turn + 1
                for c in range(blocks):
                    block = np.ascontiguousarray(x[:, c * tile : (c + 1) * tile]).tobytes()
                    for o in range(blocks):
                        yield pa.RecordBatch.from_pydict({"rows": [rows], "i": [min(c, o)], "j": [max(c, o)], "block": [c], "m": [len(x)], "x": [block]}, schema=_BLOCKS)

    return run


_BLOCKS = pa.schema([("rows", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("m", pa.int32()), ("x", pa.binary())])


def _multiply(key: tuple, t: pa.Table) -> pa.Table:
    rows, i, j = (k.as_py() for k in key)
    block = {c: np.frombuffer(x, np.float64).reshape(m, -1) for c, m, x in zip(*(t.column(c).to_pylist() for c in ("block", "m", "x")), strict=True)}
    return pa.table({"rows": [rows], "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "p": [(block[i].T @ block[j]).tobytes()]})


def _add(key: tuple, t: pa.Table) -> pa.Table:
    i, j, rows = (k.as_py() for k in key)
    total = reduce(np.add, (np.frombuffer(p, np.float64) for p in t.column("p").to_pylist()))
    return pa.table({"rows": [rows], "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "p": [total.tobytes()]})


def covariance(scratch: Scratch, fit: DataFrame, dim: int, n: int, sums: list[int], tile: int = TILE, row_block: int = ROW_BLOCK, fan_in: int = FAN_IN) -> np.ndarray:
    """The covariance of the fit list, divisor ``n``, from products of pairs of column blocks."""
    shape = "rows long, i int, j int, p binary"
    blocks = fit.select(_X).mapInArrow(_column_blocks(dim, n, sums, tile, row_block), "rows long, i int, j int, block int, m int, x binary")
    products = scratch.save(blocks.groupBy("rows", "i", "j").applyInArrow(_multiply, shape), f"products{dim}")
    many = products.filter("i = 0 and j = 0").count()
    numbered = products
    while many > 1:
        many = -(-many // fan_in)
        numbered = numbered.withColumn("rows", F.pmod(F.xxhash64("rows", F.lit(many)), F.lit(many)))
        numbered = numbered.groupBy("i", "j", "rows").applyInArrow(_add, shape)
    v = np.zeros((dim, dim))
    for r in numbered.collect():  # the tiles: dim x dim numbers
        a, b = slice(r.i * tile, min(dim, (r.i + 1) * tile)), slice(r.j * tile, min(dim, (r.j + 1) * tile))
        v[a, b] = np.frombuffer(r.p, np.float64).reshape(a.stop - a.start, -1)
        v[b, a] = v[a, b].T
    return v / n


def learn(scratch: Scratch, fit: DataFrame, dim: int, components: int) -> Fit | None:
    """The leading eigenvectors of the fit list's covariance, as many as have variance; None for an empty list."""
    n, sums = exact_sums(fit, dim)
    if not n:
        return None
    v = covariance(scratch, fit, dim, n, sums)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * max(values.max(), 0.0)]
    return Fit(n, sums, values[order], vectors[:, order], float(np.trace(v)))


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return centred(x, fit.n, fit.sums) @ fit.vectors / np.sqrt(fit.values)


def identity_error(fit_list: DataFrame, fit: Fit, dim: int) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity; a task adds up its products."""
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((k, k))
        for b in batches:
            w = _whitened(_matrix(b.column(_X), dim), fit)
            acc += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(acc.ravel())], names=["i", "s"])

    got = fit_list.select(_X).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # components x components numbers
    c = np.zeros(k * k)
    c[[r.i for r in got]] = [r.s for r in got]
    return float(np.abs(c.reshape(k, k) / fit.n - np.eye(k)).max(initial=0.0))


def _project(names: list[str], dim: int, fit: Fit, error: float):
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(_X), dim)
            gap = deviations(x, fit.n, fit.sums)
            if int(np.abs(gap).max(initial=0)) ** 2 * dim < _LONGS:
                deviation = pa.array((gap * gap).sum(axis=1).astype(np.int64))
            else:
                exact = (sum(d * d for d in row) for row in gap.tolist())
                deviation = pa.array([d if d < _LONGS else None for d in exact], pa.int64())
            own = pa.array(np.repeat(np.arange(b.num_rows), k))
            m = len(own)
            more = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(m, fit.n)),
                deviation.take(own),
                pa.array(_whitened(x, fit).ravel()),
                pa.array(np.tile(fit.values / fit.trace, b.num_rows)),
                pa.array(np.full(m, error)),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(own) for c in names), *more], names=[*names, *OUTPUTS])

    return run


OUTPUTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``vectors`` and each component: the other columns and ``component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty, or hold null or non-finite entries give no rows, nor do
    those with an entry of ``LARGEST`` or more.  Vectors of each length are fitted for
    themselves.  Components without variance (more components than the distinct vectors
    span) are left out, so a single distinct vector gives no rows.  Repeated rows give
    rows each but count once in the fit.  A deviation over the range of a long is null.
    An empty table gives an empty table; input columns named like an output are replaced.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = without(vectors, *OUTPUTS)
    names = [c for c in rows.columns if c != vector]
    sound, x = integers(vector)
    usable = rows.filter(sound & (F.size(vector) > 0)).select(*[f"`{c}`" for c in names], x.alias(_X))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != vector)
    schema = (kinds + ", " if kinds else "") + _SCHEMA
    lists = scratch.save(usable.select(_X).distinct(), "fit")
    parts = []
    for dim in sorted(r[0] for r in lists.select(F.size(_X)).distinct().collect()):  # the lengths of the vectors
        fit_list = lists.filter(F.size(_X) == dim)
        fit = learn(scratch, fit_list, dim, components)
        if fit is not None and len(fit.values):
            parts.append(usable.filter(F.size(_X) == dim).mapInArrow(_project(names, dim, fit, identity_error(fit_list, fit, dim)), schema))
    return reduce(DataFrame.unionAll, parts) if parts else vectors.sparkSession.createDataFrame([], schema)


def op13(vectors: DataFrame) -> DataFrame:
    return whiten(vectors.select("vec_id", "embedding"))
