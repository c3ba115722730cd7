"""Confidence of skills and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.normalize import clamp

# What counts for and against a profile.
BASE, PER_SOURCE, MOST_SOURCES, PER_FIELD, AGREED, MISSING = 0.50, 0.10, 4, 0.02, 0.05, 0.05
AGREE, DISAGREE = 0.05, -0.10
ONE, TWO, MORE, TRUSTED_BONUS = 0.60, 0.80, 0.95, 0.05
TRUSTED = ("resume_pdf", "resume_docx", "linkedin")


def skill_confidence(sources: Column) -> Column:
    n = F.size(sources)
    base = F.when(n == 1, F.lit(ONE)).when(n == 2, F.lit(TWO)).otherwise(F.lit(MORE))
    bonus = F.when(F.arrays_overlap(sources, F.array(*map(F.lit, TRUSTED))), F.lit(TRUSTED_BONUS)).otherwise(F.lit(0.0))
    return F.when(n <= 0, F.lit(0.0)).otherwise(clamp(base + bonus))


def overall_confidence(n_sources: Column, present: dict[str, Column], adjustments: list[Column]) -> Column:
    """``present`` tells which of the required fields are there; full_name and emails are critical."""
    score = F.lit(BASE) + F.least(n_sources, F.lit(MOST_SOURCES)) * F.lit(PER_SOURCE)
    for is_there in present.values():
        score = score + F.when(is_there, F.lit(PER_FIELD)).otherwise(F.lit(0.0))
    total = F.lit(0.0)
    for a in adjustments:
        total = total + a
    score = score + total + F.when((n_sources >= 2) & present["full_name"], F.lit(AGREED)).otherwise(F.lit(0.0))
    for critical in ("full_name", "emails"):
        score = score - F.when(present[critical], F.lit(0.0)).otherwise(F.lit(MISSING))
    return F.bround(clamp(score), 2)
