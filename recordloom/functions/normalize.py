"""Normalisers: phone, date, country, skill, link and mail, as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import dims
from recordloom.functions.cells import strip


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def phone_e164(c: Column, profile: str = "digits") -> Column:
    """``+`` and digits, or null.  ``profile='library'`` follows the stricter rules for numbers without ``+``."""
    def read(v: Column, digits: Column) -> Column:
        n = F.length(digits)
        common = (
            F.when(v.isNull() | (n == 0), None)
            .when(v.startswith("+"), F.concat(F.lit("+"), digits))
            .when(n == 10, F.concat(F.lit("+1"), digits))
            .when((n == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
            .when((n == 12) & digits.startswith("91"), F.concat(F.lit("+"), digits))
        )
        if profile == "library":
            return common.when(n.between(7, 9), F.concat(F.lit("+1"), digits))
        return common.when(n >= 7, F.concat(F.lit("+"), digits))

    return _bound(strip(c), lambda v: _bound(F.regexp_replace(v, r"[^0-9]+", ""), lambda digits: read(v, digits)))


def _bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


#: The forms of a date, as year and month: Y-M(-D), M-Y, Month D Y, D Month Y, Month Y, Y.
_DATE = r"^(?:(\d{4})[-/](\d{1,2})(?:[-/]\d{1,2})?|(\d{1,2})[/-](\d{4})|([A-Za-z]+)\s+\d{1,2}\s*,?\s*(\d{4})|\d{1,2}\s+([A-Za-z]+)\s*,?\s*(\d{4})|([A-Za-z]+)\s*,?\s*(\d{4})|(\d{4}))$"
_YEAR, _MONTH = "$1$4$6$8$10$11", "$2$3$5$7$9"  # groups that do not take part are empty


def date_ym(c: Column) -> Column:
    """``YYYY-MM`` of a date in one of the known forms; null for an open end or anything else."""
    mark = "\u0001"

    def of(p: Column) -> Column:  # [year, month]
        y, m = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1))
        month = F.when(m == "", 1).otherwise(F.coalesce(m.try_cast("int"), dims.lookup(dims.MONTHS, F.lower(m))))
        return _bound(month, lambda n: F.when(y.between(1900, 2100) & n.between(1, 12), F.format_string("%04d-%02d", y, n)))

    def read(v: Column) -> Column:
        parts = F.split(F.regexp_replace(F.translate(v, mark, ""), _DATE, _YEAR + mark + _MONTH), mark)
        return F.when(~F.lower(v).isin(*dims.PRESENT), _bound(parts, of))

    return _bound(strip(c), read)


def year_of(c: Column) -> Column:
    return F.coalesce(F.left(date_ym(c), F.lit(4)).try_cast("int"), F.nullif(F.regexp_extract(c, r"(?:19|20)\d{2}", 0), F.lit("")).try_cast("int"))


def country_iso2(c: Column) -> Column:
    names = dims.country_aliases()

    def read(v: Column) -> Column:
        low = F.lower(v)
        less = lambda prefix: F.when(low.startswith(prefix), F.substring(low, len(prefix) + 1, 10_000))
        found = F.filter(F.transform(F.array(low, less("the "), less("republic of ")), lambda k: dims.lookup(names, k)), lambda x: x.isNotNull())
        return F.when((F.length(v) == 2) & F.upper(v).isin(*dims.CODES), F.upper(v)).otherwise(F.get(found, F.lit(0)))

    return _bound(strip(c), read)


def title_case(c: Column) -> Column:
    """A capital after everything that is no letter."""
    parts = F.split(F.lower(c), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def skill_name(c: Column) -> Column:
    """The canonical name; an unknown all-lower-case skill gets capitals, any other stays as it is."""

    def read(v: Column) -> Column:
        unknown = F.when((v == F.lower(v)) & (v != F.upper(v)), title_case(v)).otherwise(v)
        return F.coalesce(dims.lookup(dims.skill_aliases(), F.lower(v)), unknown)

    return _bound(strip(c), read)


def url_key(c: Column) -> Column:
    """A link without case, closing slashes, scheme and www."""
    v = F.rtrim(F.lower(strip(c)), F.lit("/"))
    v = F.regexp_replace(v, r"^(?:https://www\.)?(?:http://www\.)?(?:https://)?(?:http://)?(?:www\.)?", "")  # one after the other, each once
    return F.when(strip(c) != "", v)


def mail_key(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def names_agree(first: Column, other: Column) -> Column:
    """Fewer than three letters differ."""
    return F.levenshtein(F.lower(first), F.lower(other)) < 3


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def months_between_ym(start: Column, end: Column) -> Column:
    year, month = (lambda c: F.left(c, F.lit(4)).cast("int")), (lambda c: F.right(c, F.lit(2)).cast("int"))
    return (year(end) - year(start)) * 12 + month(end) - month(start)
