"""Verdicts, bands, likelihood steps and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-offs of the decision bands; likelihood steps (percent from this score on, 5 below) and that of the check zone's low end with several photos.
MATCH, CHECK, CHECK_MULTI = 2.0, 1.2, 1.5
LIKELIHOOD = ((3.0, 98), (2.0, 97), (1.5, 95), (1.2, 45), (1.0, 30), (0.8, 15))
LIKELIHOOD_LOW, LIKELIHOOD_MULTI = 5, 30
#: Edges of the score bins in which the share of right answers is told.
LIKELIHOOD_BINS = (0.0, 0.8, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0)


def band(score: Column, photos: Column | None = None) -> Column:
    """match / check / possibly new, on the unrounded score; several photos need more for a check."""
    least = F.lit(CHECK) if photos is None else F.when(photos > 1, CHECK_MULTI).otherwise(CHECK)
    return F.when(score >= MATCH, "match").when(score >= least, "check").otherwise("possibly new")


def likelihood(score: Column, photos: Column | None = None) -> Column:
    """Rough percent chance that the pick is right, by half-open steps of its spot score; with several photos a score in the check zone's low end says less."""
    steps = F.coalesce(*[F.when(score >= least, percent) for least, percent in LIKELIHOOD], F.lit(LIKELIHOOD_LOW))
    if photos is None:
        return steps
    return F.when((photos > 1) & (score >= CHECK) & (score < CHECK_MULTI), LIKELIHOOD_MULTI).otherwise(steps)


def likelihood_bin(score: Column) -> Column:
    """Lower edge of the score's bin; a score below all edges has none."""
    return F.coalesce(*[F.when(score >= edge, edge) for edge in reversed(LIKELIHOOD_BINS)])


def verdict_kind(verdict: Column) -> Column:
    return F.when(verdict == "bad_photo", "bad").when(verdict == "new_turtle", "new").when(verdict == "known", "known").otherwise("")


def result(truth: Column, top: Column) -> Column:
    """right / in top 5 / wrong; empty without a truth or a list."""
    return (
        F.when(truth.isNull() | (truth == "") | (F.size(top) < 1), "")
        .when(F.element_at(top, 1) == truth, "right")
        .when(F.array_contains(top, truth), "in top 5")
        .otherwise("wrong")
    )


def share_count(n: Column, share: float = 0.15) -> Column:
    """At least one, half-even."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int"))


def year_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b)) / F.lit(365.25)


def gap_bucket(years: Column) -> Column:
    return F.when(years < 1, "<1").when(years < 2, "1-2").when(years < 3, "2-3").otherwise("3+")


#: Fixed value: the first year of the standard photo protocol.
PROTOCOL_YEAR = 2024


def era(day: Column) -> Column:
    """Before or since the standard photo protocol; null without a day."""
    return F.when(F.year(day) >= PROTOCOL_YEAR, f"{PROTOCOL_YEAR}+").when(day.isNotNull(), f"before {PROTOCOL_YEAR}")


def sightings_bin(n: Column) -> Column:
    return F.when(n <= 2, n.cast("string")).when(n <= 4, "3-4").when(n <= 9, "5-9").otherwise("10+")


#: What a service says of a photo and the name of the view.
PHOTO_VIEWS = {"top": "carapace_top", "plastron": "plastron", "front": "front", "rear": "rear", "site_view": "site_view"}
PHOTO_VIEWS |= {v: v for v in ("carapace_top", "carapace_left", "carapace_right", "carapace_side")}
HEAD_VIEWS = {"left": "carapace_left", "right": "carapace_right"}


def view_of(photo: Column, head: Column) -> Column:
    """The view from the kind of photo and, of a side, from where the head points; a side without a head is the plain side, what is unknown is empty."""
    side = F.coalesce(*[F.when(head == k, v) for k, v in HEAD_VIEWS.items()], F.lit("carapace_side"))
    other = F.coalesce(*[F.when(photo == k, v) for k, v in PHOTO_VIEWS.items()], F.lit(""))
    return F.when(photo == "side", side).otherwise(other)
