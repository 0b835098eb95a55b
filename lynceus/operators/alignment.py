"""Whether two photos are the same picture: matched keypoints give a motion, and the pixels that it brings together are compared.

Pictures are rows ``id, width, height, gray array<int>`` (row by row, 0 to 255).  A pair
is one row that meets its two pictures by two equal joins, so a task holds one pair's
pixels; which pairs are worth it is decided by their matches before any pixel moves.
Where one motion holds for all pairs, they are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators import gallery, geometry

#: Ratio and number of matches that a pair needs, the fit's tolerance in widths (3 of 800 pixels), the share that must overlap, and the largest mean difference of one picture with itself.
RATIO, MATCHES, TOLERANCE, OVERLAP, SAME = 0.7, 30, 3 / 800, 0.5, 10.0
#: Pixels of pictures or pairs that a task compares at a time.
PIXELS = 1 << 20


def places(matrix: np.ndarray, source: tuple[int, int], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pixel of a result of ``shape`` the four pixels of a picture of shape ``source`` about its place seen through ``matrix``, their shares, and whether the picture covers it; all row by row."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v, w = np.linalg.inv(matrix) @ np.stack((x.ravel(), y.ravel(), np.ones(x.size)))
        u, v = u / w, v / w
    far = ~(np.isfinite(u) & np.isfinite(v)) | (np.abs(u) > 1e6) | (np.abs(v) > 1e6)
    u, v = np.where(far, -9.0, u), np.where(far, -9.0, v)
    left, top = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    at, shares = [], []
    for dx in (0, 1):
        for dy in (0, 1):
            i, j = left + dx, top + dy
            inside = (i >= 0) & (i < source[1]) & (j >= 0) & (j < source[0])
            at.append(np.clip(j, 0, source[0] - 1) * source[1] + np.clip(i, 0, source[1] - 1))
            shares.append(np.where(inside, (1 - np.abs(u - i)) * (1 - np.abs(v - j)), 0.0))
    return np.stack(at), np.stack(shares), sum(shares) >= 0.5


def moved(pictures: np.ndarray, at: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """``pictures`` (a row each) with each pixel at its :func:`places`: bilinear values, with nothing beyond the edges."""
    return np.rint(sum(share * pictures[:, i] for i, share in zip(at, shares, strict=True)))


def warped(picture: np.ndarray, matrix: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """``picture`` seen through ``matrix`` (its pixels to those of the result) and where it covers the result."""
    at, shares, covered = places(matrix, picture.shape, shape)
    return moved(picture.reshape(1, -1), at, shares).reshape(shape), covered.reshape(shape)


def _scaled(matrix: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> np.ndarray | None:
    """``matrix`` (in units of the widths) in pixels of pictures of these shapes, None where it can't be turned round."""
    scale = np.diag([a[1], a[1], 1.0]) @ matrix @ np.diag([1 / b[1], 1 / b[1], 1.0])
    return scale if np.isfinite(scale).all() and abs(np.linalg.det(scale)) >= 1e-15 else None


def difference(a: np.ndarray, b: np.ndarray, matrix: np.ndarray) -> tuple[float | None, float]:
    """Mean difference of ``a`` and ``b`` moved onto it by ``matrix`` (in units of their widths) where they overlap, None with less than ``OVERLAP`` of ``a``; and the share of ``a`` that is covered."""
    scale = _scaled(matrix, a.shape, b.shape)
    if scale is None:
        return None, 0.0
    onto, covered = warped(b, scale, a.shape)
    share = float(covered.mean())
    return (float(np.abs(onto - a)[covered].mean()) if share >= OVERLAP else None), share


def compared(motions: DataFrame, pictures: DataFrame) -> DataFrame:
    """``(a, b, difference, overlap)`` for ``motions(a, b, matrix)`` that bring b onto a; the difference is null without enough overlap, or without pixels."""
    side = lambda n: pictures.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("width", "height", "gray")])
    rows = motions.select("a", "b", "matrix").join(side("a"), "a").join(side("b"), "b")
    names = ["a", "b", "matrix", *[f"{n}_{c}" for n in "ab" for c in ("width", "height", "gray")]]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for i in range(t.num_rows):
                cell = {c: t.column(c)[i] for c in names}
                one, sound = {}, True
                for n in "ab":
                    w, h, gray = cell[f"{n}_width"].as_py(), cell[f"{n}_height"].as_py(), cell[f"{n}_gray"]
                    sound = sound and bool(w and h and gray.is_valid and len(gray.values) == w * h)
                    one[n] = gray.values.to_numpy(zero_copy_only=False).reshape(h, w).astype(np.float64) if sound else None
                out.append(difference(one["a"], one["b"], np.array(cell["matrix"].as_py()).reshape(3, 3)) if sound else (None, 0.0))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array([d for d, _ in out], pa.float64()), pa.array([o for _, o in out], pa.float64())], names=["a", "b", "difference", "overlap"])

    return rows.select(*names).mapInArrow(run, f"a {types['a']}, b {types['b']}, difference double, overlap double")


def _shapes(x: dict) -> np.ndarray:
    """Height and width of each picture, 0 and 0 of those without sound pixels."""
    known = lambda c: np.nan_to_num(x[c].astype(float)).astype(np.int64)
    h, w, n = known("height"), known("width"), np.array([0 if g is None else len(g) for g in x["gray"]], np.int64)
    return np.where(((h > 0) & (w > 0) & (h * w == n))[:, None], np.column_stack((h, w)), 0)


def block_differences(q: dict, r: dict, i: np.ndarray, j: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`difference` (NaN for None) and overlap of the pairs ``q[i], r[j]`` by one motion; a picture is moved once for each shape that it meets."""
    gap, share = np.full(len(i), np.nan), np.zeros(len(i))
    own, theirs = _shapes(q)[i], _shapes(r)[j]
    kinds, code = np.unique(np.column_stack((own, theirs)), axis=0, return_inverse=True)
    for k, (h, w, hr, wr) in enumerate(kinds.tolist()):
        scale = _scaled(matrix, (h, w), (hr, wr)) if h and hr else None
        if scale is None:
            continue
        at, shares, covered = places(scale, (hr, wr), (h, w))
        pairs = np.flatnonzero(code.ravel() == k)
        share[pairs] = covered.mean()
        if covered.mean() < OVERLAP:
            continue
        (left, li), (right, ri) = np.unique(i[pairs], return_inverse=True), np.unique(j[pairs], return_inverse=True)
        a = np.stack([q["gray"][x] for x in left]).astype(np.float64)[:, covered]
        step = max(1, PIXELS // (h * w))
        b = np.concatenate([moved(np.stack([r["gray"][x] for x in right[n : n + step]]).astype(np.float64), at, shares)[:, covered] for n in range(0, len(right), step)])
        for n in range(0, len(pairs), step):
            gap[pairs[n : n + step]] = np.abs(b[ri[n : n + step]] - a[li[n : n + step]]).mean(1)
    return gap, share


def alike(photos: DataFrame, least: float, matrix: np.ndarray, block: int | None = None) -> DataFrame:
    """``(a, b, difference, overlap)`` of :func:`compared`, a before b, for the ``photos(id, cls, grp, v, width, height, gray)`` whose vectors score ``least`` or more, all by one motion.

    Pixels lie beside the vectors in the blocks of the gallery's grid, so pairs are compared where they are found and only results leave the task.
    """

    def reduce(s: np.ndarray, q: dict, r: dict) -> pa.Table:
        i, j = np.divmod(np.flatnonzero(s >= least), s.shape[1])
        gap, share = block_differences(q, r, i, j, matrix)
        return pa.table({"a": q["id"][i], "b": r["id"][j], "difference": pa.array(gap, mask=np.isnan(gap)), "overlap": share})

    return gallery.grid(photos, photos, "not_before", reduce, "a long, b long, difference double, overlap double", block)[0]


def same_pictures(matched: DataFrame, pictures: DataFrame, same: float = SAME) -> DataFrame:
    """``(a, b, difference, overlap, same)`` for the pairs of :func:`spots.matches` (a is the reference r, b the query q) with enough matches and a motion that explains some of them."""
    some = matched.select(F.col("q"), F.col("r"), F.transform(F.filter("m", lambda x: x.ratio < RATIO), lambda x: F.struct(x.ax, x.ay, x.bx, x.by)).alias("m"))
    motions = geometry.verify_lists(some.filter(F.size("m") >= MATCHES), "homography", tolerance=TOLERANCE).filter("matrix is not null")
    out = compared(motions.select(F.col("r").alias("a"), F.col("q").alias("b"), "matrix"), pictures)
    return out.withColumn("same", F.coalesce(F.col("difference") < same, F.lit(False)))


def duplicates(same: DataFrame, photos: DataFrame) -> DataFrame:
    """``(a, b)``, a before b: the same pictures that aren't of one class and day, where two like pictures are expected; ``photos(id, cls, date)``."""
    p = photos.select("id", "cls", "date")
    left, right = p.select(*[F.col(c).alias("a_" + c) for c in p.columns]), p.select(*[F.col(c).alias("b_" + c) for c in p.columns])
    rows = same.filter("same").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = rows.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
    return rows.filter(~((F.col("a_cls") == F.col("b_cls")) & F.col("a_date").eqNullSafe(F.col("b_date")))).select("a", "b")
