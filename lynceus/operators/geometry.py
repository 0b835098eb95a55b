"""Geometric verification: how many matched keypoints of a pair of photos one motion explains.

``matches`` has a row for each matched keypoint, ``q, r, ax, ay, bx, by``, with places in
units of the photos' widths.  A pair's matches are few (a photo has a bounded number of
keypoints), so a pair is one row of lists; a task takes many pairs at a time, draws the
minimal sets of all of them and fits them in one batched decomposition.  A pair of few
matches has all its minimal sets tried; of others some are drawn, with a seed of the
pair's own, more where few matches agree.  The most matches within the model's tolerance
count; fewer than ``LEAST`` matches count as none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tolerance of each model, and the matches that a pair must have.
TOLERANCE = {"homography": 0.02, "similarity": 0.03, "affine": 0.06, "epipolar": 0.01}
LEAST = 5
#: Matches of a minimal set, sets drawn at first and at most, and pairs that a task verifies at a time.
MINIMAL = {"homography": 4, "similarity": 2, "affine": 3, "epipolar": 8}
FIRST_DRAWS, DRAWS = 50, 500
PAIRS = 64
CONFIDENCE = 0.9999


def _null_vector(rows: np.ndarray) -> np.ndarray:
    return np.linalg.svd(rows)[2][-1]


def fit(model: str, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix from points ``a`` to ``b`` by least squares; None where they don't determine one."""
    n, one, zero = len(a), np.ones(len(a)), np.zeros(len(a))
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    if model == "similarity":
        m = np.block([[x[:, None], -y[:, None], one[:, None], zero[:, None]], [y[:, None], x[:, None], zero[:, None], one[:, None]]])
        if np.linalg.matrix_rank(m) < 4:
            return None
        c, s, tx, ty = np.linalg.lstsq(m, np.concatenate((u, v)), rcond=None)[0]
        return np.array([[c, -s, tx], [s, c, ty], [0, 0, 1]])
    if model == "affine":
        m = np.column_stack((x, y, one))
        if np.linalg.matrix_rank(m) < 3:
            return None
        return np.vstack((np.linalg.lstsq(m, b, rcond=None)[0].T, [0, 0, 1]))
    if model == "homography":
        top = np.column_stack((x, y, one, zero, zero, zero, -u * x, -u * y, -u))
        low = np.column_stack((zero, zero, zero, x, y, one, -v * x, -v * y, -v))
        m = np.vstack((top, low))
        return None if np.linalg.matrix_rank(m) < 8 else _null_vector(m).reshape(3, 3)
    m = np.column_stack((u * x, u * y, u, v * x, v * y, v, x, y, one))
    if n < 8 or np.linalg.matrix_rank(m) < 8:
        return None
    w, d, t = np.linalg.svd(_null_vector(m).reshape(3, 3))
    return w @ np.diag([d[0], d[1], 0]) @ t


def minimal_fits(model: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrices of many minimal sets at once, ``sets x matches x 2`` points on each side; nan where a set determines none."""
    n = len(a)
    out = np.full((n, 3, 3), np.nan)
    if not n:
        return out
    one, zero = np.ones(a.shape[:2]), np.zeros(a.shape[:2])
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        if model == "similarity":
            p, q = x + 1j * y, u + 1j * v
            m = (q[:, 1] - q[:, 0]) / (p[:, 1] - p[:, 0])
            t = q[:, 0] - m * p[:, 0]
            rows = np.stack((m.real, -m.imag, t.real, m.imag, m.real, t.imag, zero[:, 0], zero[:, 0], one[:, 0]), axis=1)
            return np.where(np.isfinite(rows).all(1)[:, None], rows, np.nan).reshape(n, 3, 3)
        if model == "affine":
            m = np.stack((x, y, one), axis=2)
            sound = np.abs(np.linalg.det(m)) > 1e-12
            out[sound, 2] = (0, 0, 1)
            out[sound, :2] = np.linalg.solve(m[sound], b[sound]).transpose(0, 2, 1)
            return out
        if model == "homography":
            top = np.stack((x, y, one, zero, zero, zero, -u * x, -u * y, -u), axis=2)
            low = np.stack((zero, zero, zero, x, y, one, -v * x, -v * y, -v), axis=2)
            m = np.concatenate((top, low), axis=1)
        else:
            m = np.stack((u * x, u * y, u, v * x, v * y, v, x, y, one), axis=2)
        _, d, w = np.linalg.svd(m)
        sound = d[:, 7] > 1e-12 * d[:, 0]
        out[sound] = w[sound, -1].reshape(-1, 3, 3)
        if model == "epipolar" and sound.any():
            w, d, t = np.linalg.svd(out[sound])
            d[:, 2] = 0
            out[sound] = w @ (d[:, :, None] * t)
    return out


def gaps(model: str, matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each match from one model or from many: of the moved point, or from the epipolar line on the worse side."""
    p, q = np.column_stack((a, np.ones(len(a)))), np.column_stack((b, np.ones(len(b))))
    with np.errstate(divide="ignore", invalid="ignore"):
        if model == "epipolar":
            line, back = p @ np.swapaxes(matrix, -1, -2), q @ matrix
            off = np.abs((q * line).sum(-1))
            out = np.maximum(off / np.hypot(line[..., 0], line[..., 1]), off / np.hypot(back[..., 0], back[..., 1]))
        else:
            moved = p @ np.swapaxes(matrix, -1, -2)
            gap = moved[..., :2] / moved[..., 2:] - b
            out = np.hypot(gap[..., 0], gap[..., 1])
    return np.nan_to_num(out, nan=np.inf, posinf=np.inf)


def _sets(n: int, need: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """All minimal sets of n matches where there are no more than ``draws``, else as many drawn ones."""
    if comb(n, need) <= draws:
        return np.array(list(combinations(range(n), need)))
    return np.argsort(rng.random((draws, n)), axis=1)[:, :need]


def consensus(model: str, pairs: list[tuple[np.ndarray, np.ndarray, int]], draws: int = DRAWS, refit: bool = True, tolerance: float | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """For each ``(a, b, seed)`` which matches one motion of the model brings within its tolerance, as many as were found, and its matrix."""
    need, within = MINIMAL[model], TOLERANCE[model] if tolerance is None else tolerance
    best = [(np.zeros(len(a), bool), None) for a, _, _ in pairs]
    rngs = [np.random.default_rng(seed) for _, _, seed in pairs]
    open_ = [k for k, (a, _, _) in enumerate(pairs) if len(a) >= max(LEAST, need)]
    for turn in (min(FIRST_DRAWS, draws), draws):
        sets = [_sets(len(pairs[k][0]), need, turn, rngs[k]) for k in open_]
        if not sets:
            break
        fits = minimal_fits(model, *(np.concatenate([pairs[k][side][s] for k, s in zip(open_, sets, strict=True)]) for side in (0, 1)))
        more, at = [], 0
        for k, s in zip(open_, sets, strict=True):
            a, b, _ = pairs[k]
            near = gaps(model, fits[at : at + len(s)], a, b) <= within
            top = int(near.sum(1).argmax())
            if near[top].sum() > best[k][0].sum():
                best[k] = (near[top], fits[at + top])
            at += len(s)
            # Enough draws: a set of agreeing matches only is among them with a chance of CONFIDENCE.
            share = min(1 - 1e-9, max(1e-9, best[k][0].mean() ** need))
            if len(s) == turn < draws and turn < np.log(1 - CONFIDENCE) / np.log1p(-share):
                more.append(k)
        open_ = more
    if refit:  # once more from all that agree
        for k, (a, b, _) in enumerate(pairs):
            if best[k][0].sum() >= need and (matrix := fit(model, a[best[k][0]], b[best[k][0]])) is not None:
                near = gaps(model, matrix, a, b) <= within
                if near.sum() >= best[k][0].sum():
                    best[k] = (near, matrix)
    return best


def inliers(model: str, a: np.ndarray, b: np.ndarray, seed: int = 0, draws: int = DRAWS) -> int:
    """The most matches that one motion of this model brings within its tolerance."""
    return int(consensus(model, [(a, b, seed)], draws)[0][0].sum())


def verify_lists(pairs: DataFrame, model: str, draws: int = DRAWS, refit: bool = True, tolerance: float | None = None) -> DataFrame:
    """``(q, r, matches, inliers, matrix)`` from ``pairs(q, r, m array<struct<ax, ay, bx, by>>)``; the matrix is null without inliers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PAIRS):
                t = whole.slice(first, PAIRS)
                lists, flat = t.column("m"), t.column("m").flatten()
                xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")]) if len(flat) else np.zeros((0, 4))
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
                q, r = t.column("q").to_numpy(), t.column("r").to_numpy()
                own = [x[np.lexsort(x.T[::-1])] for x in np.split(xy, ends[:-1])]
                found = consensus(model, [(x[:, :2], x[:, 2:], (int(i) * 1_000_003 + int(j)) & 0x7FFFFFFF) for x, i, j in zip(own, q, r, strict=True)], draws, refit, tolerance)
                matrix = [None if m is None else m.ravel().tolist() for _, m in found]
                yield pa.RecordBatch.from_arrays(
                    [t.column("q"), t.column("r"), pa.array([len(x) for x in own], pa.int32()), pa.array([int(n.sum()) for n, _ in found], pa.int32()), pa.array(matrix, pa.list_(pa.float64()))],
                    names=["q", "r", "matches", "inliers", "matrix"],
                )

    rows = pairs.select(F.col("q").cast("long").alias("q"), F.col("r").cast("long").alias("r"), F.col("m").cast("array<struct<ax:double,ay:double,bx:double,by:double>>").alias("m"))
    return rows.mapInArrow(run, "q long, r long, matches int, inliers int, matrix array<double>")


def verify(matches: DataFrame, model: str = "similarity", draws: int = DRAWS, refit: bool = True) -> DataFrame:
    """``(q, r, matches, inliers)`` for every pair that has a match, from a row a match."""
    lists = matches.groupBy("q", "r").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("m"))
    return verify_lists(lists, model, draws, refit).drop("matrix")
