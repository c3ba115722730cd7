"""Checks of finished profiles: what is missing, out of range or in the wrong form.  Nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHONE, YEAR_MONTH, COUNTRY = r"^\+\d{1,15}$", r"^\d{4}-(?:0[1-9]|1[0-2])$", r"^[A-Z]{2}$"


def _each(values: Column, bad, message) -> Column:
    marked = F.transform(values, lambda x, i: F.when(bad(x), message(x, i)))
    return F.coalesce(F.filter(marked, lambda m: m.isNotNull()), F.array().cast("array<string>"))


def semantic_errors() -> Column:
    """array<string> over the columns phones, experience and location."""
    wrong = lambda c, rx: c.isNotNull() & (c != "") & ~c.rlike(rx)
    dates = [
        _each(F.col("experience"), lambda e, f=f: wrong(e[f], YEAR_MONTH), lambda e, i, f=f: F.concat(F.lit("experience["), i.cast("string"), F.lit(f'].{f} "'), e[f], F.lit('" does not match YYYY-MM format')))
        for f in ("start", "end")
    ]
    phones = _each(F.col("phones"), lambda p: wrong(p, PHONE), lambda p, i: F.concat(F.lit("phones["), i.cast("string"), F.lit('] "'), p, F.lit('" does not match E.164 format')))
    country = F.col("location.country")
    place = F.when(wrong(country, COUNTRY), F.array(F.concat(F.lit('location.country "'), country, F.lit('" does not match ISO-3166 alpha-2 format')))).otherwise(F.array().cast("array<string>"))
    return F.concat(phones, *dates, place)


def structural_errors() -> Column:
    """Required fields and ranges."""
    outside = lambda c: c.isNotNull() & ~c.between(0.0, 1.0)
    return F.array_compact(F.array(
        F.when(F.col("candidate_id").isNull(), F.lit("candidate_id is missing")),
        F.when(outside(F.col("overall_confidence")), F.lit("overall_confidence is not between 0 and 1")),
        F.when(F.col("total_years_experience") < 0, F.lit("total_years_experience is negative")),
        F.when(F.exists(F.coalesce("skills", F.array().cast("array<struct<name:string,confidence:double,sources:array<string>>>")), lambda s: s["name"].isNull() | outside(s["confidence"])), F.lit("a skill has no name or a confidence not between 0 and 1")),
    ))


def validate(profiles: DataFrame) -> DataFrame:
    """The profiles, kept whole, with an array of errors."""
    return profiles.withColumn("errors", F.concat(structural_errors(), semantic_errors()))


def warnings_of(profiles: DataFrame) -> DataFrame:
    """(stage, ref, seq, message), one row per error."""
    return validate(profiles).select(F.lit("validate").alias("stage"), F.col("candidate_id").alias("ref"), F.posexplode("errors").alias("seq", "message"))
