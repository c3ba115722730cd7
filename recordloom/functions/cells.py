"""Column helpers for dirty cells: Unicode trimming, stand-ins for missing values, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for "no value", compared trimmed and in lower case.
STAND_INS = (
    "n/a", "na", "n.a.", "n.a", "n/k", "none", "null", "nil", "nan", "unknown", "undefined", "missing", "empty",
    "not provided", "not available", "not applicable", "not given", "not specified", "not known", "no name", "no value",
    "tbd", "tba", "tbc", "to be defined", "to be confirmed", "to be announced", "-", "--", "---", "- - -", "?", "??", "???", ".", "..", "...", "x", "xx", "xxx",
    "sin datos", "keine angabe", "k.a.", "k. a.", "ohne", "inconnu", "desconocido", "unbekannt", "нет", "[none]", "(none)", "<none>", "#n/a",
)

#: Every white-space character of Unicode, and the zero-width marks that pad cells unseen.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\xad"


def strip(c: Column) -> Column:
    """Trim every kind of white space (and zero-width marks), not just U+0020; no regular expression."""
    return F.btrim(c, F.lit(SPACES))


def is_stand_in(c: Column) -> Column:
    """True for a blank cell, a stand-in word, or a run of marks without letter or digit."""
    low = F.lower(strip(c))
    return low.isin("", *STAND_INS) | ~low.rlike(r"[\p{L}\p{N}]")


def present(c: Column) -> Column:
    """The trimmed value, or null where the cell says nothing."""
    return F.when(c.isNotNull() & ~is_stand_in(c), strip(c))


def email_key(c: Column) -> Column:
    """A mail address without case, display name, ``mailto:`` and wrapping characters; null where none is in the cell."""
    found = F.regexp_extract(F.lower(strip(c)), r"(?:mailto:)?([^\s<>\"'()\[\],;:@]+@[^\s<>\"'()\[\],;:@]+\.[^\s<>\"'()\[\],;:@.]{2,})", 1)
    return F.when(found != "", found)


def emails_of(c: Column) -> Column:
    """All distinct addresses of a ``;``- or ``,``-separated cell."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[;,|\s]+")
    return F.array_distinct(F.array_compact(F.transform(parts, email_key)))


def profile_key(c: Column) -> Column:
    """The profile name of a linkedin link, however the link is written; null where there is none."""
    low = F.lower(strip(c))
    name = F.regexp_extract(low, r"(?:linkedin\.[a-z.]+/)(?:[a-z]{2}/)?(?:in|pub|profile)/+([^/?#\s]+)", 1)
    return F.when((name != "") & ~name.isin("me", "n/a", "na", "none", "null", "unknown", "profile"), name)
