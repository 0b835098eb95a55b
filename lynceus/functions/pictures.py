"""Difference hashes of gray pictures."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and columns of the gray picture that is hashed; a row of n pixels has n - 1 bits.
ROWS, COLUMNS = 16, 17


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), 0)


def difference_bits(gray: Column) -> Column:
    """256 bits of a 16 x 17 gray picture, row by row: whether a pixel is brighter than the one to its left; null where the size isn't that."""
    places = F.sequence(F.lit(0), F.lit(ROWS * (COLUMNS - 1) - 1))
    at = lambda i: (F.floor(i / (COLUMNS - 1)) * COLUMNS + i % (COLUMNS - 1)).cast("int")
    bits = lambda g: F.transform(places, lambda i: (F.get(g, at(i) + 1) > F.get(g, at(i))).cast("int"))
    return _bound(gray, lambda g: F.when(F.size(g) == ROWS * COLUMNS, bits(g)))


def pack_bits(bits: Column) -> Column:
    """256 bits as four 64-bit words, the first bit lowest."""
    place = lambda b, w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.get(b, 64 * w + i).cast("long"), i)))
    return _bound(bits, lambda b: F.when(b.isNotNull(), F.array(*[place(b, w) for w in range(ROWS * (COLUMNS - 1) // 64)])))


#: Weights of red, green and blue in 65,536ths, lobes of the resampling kernel, and bits of its weights.
LUMA, LOBES, WEIGHT_BITS = (19595, 38470, 7471), 3, 22


def gray_of(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a pixel from its colours, 0 to 255."""
    r, g, b = LUMA
    return F.shiftright(red.cast("int") * r + green.cast("int") * g + blue.cast("int") * b + F.lit(1 << 15), 16)


@lru_cache(64)
def kernel(size: int, wanted: int) -> np.ndarray:
    """Weights ``wanted x size`` that resample a line of pixels: a windowed sinc as wide as the pixels that one stands for, in whole numbers that add up to one."""
    scale = size / wanted
    reach = LOBES * max(scale, 1.0)
    centre = (np.arange(wanted) + 0.5) * scale
    first = np.maximum(0, (centre - reach + 0.5).astype(int))
    last = np.minimum(size, (centre + reach + 0.5).astype(int))
    place = np.arange(size)[None]
    at = (place - centre[:, None] + 0.5) / max(scale, 1.0)
    w = np.where((place >= first[:, None]) & (place < last[:, None]) & (np.abs(at) < LOBES), np.sinc(at) * np.sinc(at / LOBES), 0.0)
    w /= w.sum(1, keepdims=True)
    return np.trunc(w * (1 << WEIGHT_BITS) + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def resampled(picture: np.ndarray, rows: int = ROWS, columns: int = COLUMNS) -> np.ndarray:
    """A gray picture in another size: its lines, then its columns, each rounded to 0 to 255; a side that has its size stays."""
    half, out = 1 << (WEIGHT_BITS - 1), picture.astype(np.int64)
    if out.shape[1] != columns:
        out = np.clip((out @ kernel(out.shape[1], columns).T + half) >> WEIGHT_BITS, 0, 255)
    if out.shape[0] != rows:
        out = np.clip((kernel(out.shape[0], rows) @ out + half) >> WEIGHT_BITS, 0, 255)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def hash_picture(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """The 16 x 17 picture that is hashed, from a gray picture of any size; null where the pixels aren't width x height."""

    def one(p, w, h):
        if p is None or pd.isna(w) or pd.isna(h) or w < 1 or h < 1 or len(p) != int(w) * int(h):
            return None
        return resampled(np.asarray(p).reshape(int(h), int(w))).ravel()

    return pd.Series([one(*x) for x in zip(gray, width, height, strict=True)], dtype=object)
