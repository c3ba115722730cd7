"""Summaries of profiles for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM, SHOWN = 0.8, 0.5, 8


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def summary(p: DataFrame) -> DataFrame:
    """One line per profile: confidence, how much there is of each field, and the sources it came from."""
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(f"n_{c}")
    sources = F.array_join(F.array_sort(F.array_distinct(F.transform("provenance", lambda x: x["source"]))), ", ")
    return p.select("candidate_id", "full_name", "overall_confidence", *map(count, ("emails", "phones", "skills", "experience", "education")), sources.alias("sources"))


def cards(p: DataFrame) -> DataFrame:
    """What a card of a profile shows: band, first mail and how many more, the first skills, the latest job."""
    more = lambda c, shown: F.greatest(F.coalesce(F.size(c), F.lit(0)) - shown, F.lit(0))
    job = F.get("experience", F.lit(0))
    return p.select(
        "candidate_id", "full_name", band(F.col("overall_confidence")).alias("band"), F.get("emails", F.lit(0)).alias("email"), more("emails", 1).alias("more_emails"),
        F.transform(F.slice("skills", 1, SHOWN), lambda s: s["name"]).alias("top_skills"), more("skills", SHOWN).alias("more_skills"), job["title"].alias("latest_title"), job["company"].alias("latest_company"),
    )
