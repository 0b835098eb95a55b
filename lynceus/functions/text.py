"""Packed lists, file names, dates and labels as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ends of names that a system gives to copies of a file.
COPY_NAME = r"( \d+| copy( \d+)?| \(\d+\))$"


def unpack_list(packed: Column) -> Column:
    """``name:score;name:score`` to an array of (name, score); the last colon parts the two."""
    item = lambda x: F.struct(
        F.regexp_extract(x, r"^(.*):([^:]*)$", 1).alias("name"),
        F.regexp_extract(x, r"^(.*):([^:]*)$", 2).try_cast("double").alias("score"),
    )
    return F.when(packed == "", F.array().cast("array<struct<name:string,score:double>>")).otherwise(F.transform(F.split(packed, ";"), item))


def pack_list(names: Column, scores: Column) -> Column:
    """The inverse, with the scores as they print."""
    return F.concat_ws(";", F.zip_with(names, scores, lambda n, s: F.concat(n, F.lit(":"), s.cast("string"))))


def photo_id(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.jpg$", 1).try_cast("long")


def first_date(name: Column) -> Column:
    """The first yyyy-mm-dd in a name, null without one."""
    return F.to_date(F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def is_copy_name(stem: Column) -> Column:
    return stem.rlike(COPY_NAME)


def exif_time(value: Column) -> Column:
    """The first two colons of an EXIF time become hyphens."""
    return F.regexp_replace(value, r"^([^:]*):([^:]*):", "$1-$2-")


def view_name(view: Column) -> Column:
    """``back`` and ``rear`` are one view."""
    return F.when(view == "back", "rear").otherwise(view)


def no_blank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
