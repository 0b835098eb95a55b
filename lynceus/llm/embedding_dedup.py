"""Embedding near-deduplication as an exact metric range join.

Vectors are compared only within one label (and one length).  Unit vectors with a
cosine of t or more lie within eps = sqrt(2 - 2t) of each other, so:

* equal vectors become one row with a multiplicity (map-side aggregate);
* pivots of each label, the smallest hashes of a few drawn by hash, partition its vectors by nearest pivot;
* a vector v of cell j is replicated to an earlier cell i only if the triangle
  inequality lets a vector of that cell lie within eps: d(v, p_i) <= d(v, p_j) + 2 eps;
* each cell is cut into chunks, and every pair of chunks is one task-sized unit, so a
  cell of any size joins in bounded memory; a vector is moved once for each chunk of its
  cell.  A unit is a few matrix products in double precision.

A unit returns, for each vector, its number of links and one link of a spanning
forest, never all pairs.  In high dimensions distances concentrate and the bound
prunes little; the result is exact all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.llm.common import PREFIX, RID, Scratch, with_row_id, without
from lynceus.llm.components import components

THRESHOLD = 0.93
#: Vectors of a label for each pivot, most pivots of a label, most vectors of a chunk, vectors of an assigning task.
CELL = 4096
MOST_PIVOTS = 256
CHUNK = 8192
ASSIGN = 65536
#: Pivots are the vectors of the smallest hashes among so many drawn for each of them; none is drawn with a chance of e ** -64.
DRAWN = 64
#: Components of a chunk at most, and products of a unit held at a time.
CHUNK_NUMBERS, SLAB = 1 << 20, 1 << 22
#: Distances are rounded: so much more than the bound is replicated.
SLACK = 1e-6

_ROW, _TOP, _LINKS = PREFIX + "row", PREFIX + "top", PREFIX + "links"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _assign(eps: float):
    def run(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        v = _matrix(vectors.column("v"))
        p = _matrix(pivots.sort_by("pivot").column("v"))
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (v @ p.T)))
        own = d.argmin(axis=1)
        near = d <= d[np.arange(len(d)), own][:, None] + 2 * eps + SLACK
        near &= np.arange(len(p))[None, :] <= own[:, None]
        row, cell = np.nonzero(near)
        out = vectors.take(pa.array(row)).select(["cls", "dim", "node", "m", "v"])
        return out.append_column("cell", pa.array(cell.astype(np.int32))).append_column("own", pa.array(cell == own[row]))

    return run


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the seed of its component, by widening a front of rows and columns of the links at once."""
    parent, open_ = np.arange(n), np.zeros(n, bool)
    open_[left], open_[right] = link.any(axis=1), open_[right] | link.any(axis=0)
    row, column = np.full(n, -1), np.full(n, -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    while open_.any():
        front = np.array([seed := int(open_.argmax())])
        open_[seed] = False
        while len(front):
            reach = np.zeros(n, bool)
            i, j = row[front], column[front]
            if (i >= 0).any():
                reach[right] |= link[i[i >= 0]].any(axis=0)
            if (j >= 0).any():
                reach[left] |= link[:, j[j >= 0]].any(axis=1)
            front = np.flatnonzero(reach & open_)
            open_[front], parent[front] = False, seed
    return parent


def _join(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        c, d = key[3].as_py(), key[4].as_py()
        v = _matrix(table.column("v"))
        node, m = table.column("node").to_numpy(), table.column("m").to_numpy().astype(np.float64)
        own, chunk = table.column("own").to_numpy(zero_copy_only=False), table.column("chunk").to_numpy()
        left, right = np.flatnonzero(chunk == c), np.flatnonzero(chunk == d)
        link, n = np.zeros((len(left), len(right)), bool), np.zeros(len(node))
        slab = max(1, SLAB // max(1, len(right)))
        for i in range(0, len(left), slab):
            some = left[i : i + slab]
            near = v[some] @ v[right].T >= threshold
            near &= own[some][:, None] | own[right][None, :]
            if c == d:
                near[np.arange(len(some)), i + np.arange(len(some))] = False
            link[i : i + slab] = near
            if near.any():  # sums of whole numbers below 2 ** 53
                near = near.astype(np.float64)
                n[some] += near @ m[right]
                if c != d:
                    n[right] += m[some] @ near
        hit = np.flatnonzero(n)
        parent = _forest(link, left, right, len(node)) if len(hit) else np.zeros(0, int)
        return pa.table({"a": node[hit], "b": node[parent[hit]] if len(hit) else node[hit], "links": n[hit].astype(np.int64)})

    return run


def vector_dedup(vectors: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``vectors`` with ``n_links, component_id, kept``.

    ``n_links`` counts the other rows linked directly, equal vectors included;
    ``component_id`` is the smallest id reachable.  Vectors that are null, empty, zero
    or hold null or non-finite components, and rows with a null label, link with
    nothing: their component is their own id.  Vectors of different lengths don't link.
    ``kept`` is whether the id is the component's, false for a null id.  Repeated rows
    are copies.  An empty table gives an empty table; input columns named like an
    output are replaced.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = without(vectors, "n_links", "component_id", "kept")
    base = with_row_id(scratch, rows)
    eps = float(np.sqrt(2.0 - 2.0 * threshold))
    doubles = F.col(vector).cast("array<double>")
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    usable = base.filter(F.col(label).isNotNull() & F.coalesce(sound, F.lit(False)))
    usable = usable.select(F.col(RID).alias("rid"), F.col(vec_id).alias("id"), F.col(label).cast("string").alias("cls"), F.size(vector).alias("dim"), doubles.alias("v"))
    nodes = usable.groupBy("cls", "dim", "v").agg(F.min("rid").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("m"))
    nodes = scratch.save(nodes, "nodes")
    sizes = scratch.save(nodes.groupBy("cls", "dim").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # Few vectors of a label are drawn by hash before any are ranked, so no task sorts a label.
    many = F.least(F.ceil(F.col("n") / CELL), F.lit(MOST_PIVOTS))
    place = F.shiftrightunsigned(F.xxhash64("v", "node"), 11) / F.lit(float(1 << 53))
    drawn = nodes.select("cls", "dim", "node", "v", place.alias("h")).join(sizes, ["cls", "dim"]).filter(F.col("h") < DRAWN * many / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("cls", "dim").orderBy("h", "node"))
    pivots = drawn.withColumn("pivot", rank).filter(F.col("pivot") <= many)
    salts = F.ceil(F.col("n") / ASSIGN).cast("int")
    pivots = pivots.select("cls", "dim", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "pivot", "v")
    pivots = scratch.save(pivots, "pivots")
    salted = nodes.join(sizes, ["cls", "dim"]).select("cls", "dim", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "node", "m", "v")
    by = ("cls", "dim", "salt")
    placed = salted.groupBy(*by).cogroup(pivots.groupBy(*by)).applyInArrow(_assign(eps), "cls string, dim int, node long, m long, v array<double>, cell int, own boolean")
    placed = scratch.save(placed, "placed")
    chunk = F.least(F.lit(CHUNK), F.greatest(F.lit(64), F.lit(CHUNK_NUMBERS) / F.col("dim")))
    cells = placed.groupBy("cls", "dim", "cell").agg(F.count(F.lit(1)).alias("n")).select("cls", "dim", "cell", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    dealt = placed.join(cells, ["cls", "dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least("chunk", x).alias("c"), F.greatest("chunk", x).alias("d")))
    dealt = dealt.withColumn("unit", F.explode(units)).select("cls", "dim", "cell", "unit.c", "unit.d", "chunk", "node", "m", "own", "v")
    found = dealt.groupBy("cls", "dim", "cell", "c", "d").applyInArrow(_join(threshold), "a long, b long, links long")
    found = scratch.save(found, "found")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(scratch, found.filter("a <> b").select("a", "b"))
    known = nodes.select("cls", "dim", "v", "node", "least", "m").join(degree, "node", "left").join(roots, "node", "left")
    known = scratch.save(known.withColumn("component", F.coalesce("component", "node")), "known")
    top = known.groupBy("component").agg(F.min("least").alias(_TOP))
    label_of = known.join(top, "component").select("cls", "dim", "v", "node", "m", _TOP, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias(_LINKS))
    label_of = scratch.save(label_of, "labels")
    # A node is the row of its number; only copies of nodes find theirs by the vector.
    copies = usable.join(nodes.select(F.col("node").alias("rid")), "rid", "left_anti").join(label_of.filter("m > 1"), ["cls", "dim", "v"])
    mine = label_of.select(F.col("node").alias(_ROW), _TOP, _LINKS).unionAll(copies.select(F.col("rid").alias(_ROW), _TOP, _LINKS))
    joined = base.join(mine, F.col(RID) == F.col(_ROW), "left")
    component = F.when(F.col(_ROW).isNull(), F.col(vec_id)).otherwise(F.col(_TOP))
    return joined.select(
        *[f"`{c}`" for c in rows.columns],
        F.coalesce(_LINKS, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(vec_id) == component, F.lit(False)).alias("kept"),
    )


def op6(vectors: DataFrame) -> DataFrame:
    done = vector_dedup(vectors.select("vec_id", "embedding", "label"))
    return done.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


OP6_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), w AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {THRESHOLD}
), r AS (
  SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
