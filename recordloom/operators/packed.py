"""Several values packed into one cell, split into one row per value with its position.

The cell is cut at its quote marks: odd pieces are literals, even pieces are cut at delimiters, and the array of
pieces is folded into values again, whose ordinals are their positions.  Everything is built-in array SQL, so the
operator is narrow: no shuffle, no Python, and a hot source or a very long cell costs in proportion to its bytes (each
piece is copied once).

Defined results: a null or blank cell gives no value; blank values are neither returned nor counted; repeats
stay; an unclosed quote or bracket is ordinary text; several kinds of delimiters may stand in one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import strip

CUT, MARK, END, ESCAPE = "\u0001", "\u0002", "\u0003", "\u0004"  # put around literals and between values while a cell is taken apart
_CODES = {ESCAPE: ESCAPE + "e", CUT: ESCAPE + "c", MARK: ESCAPE + "m", END: ESCAPE + "n"}  # how the same characters in a cell are kept apart
_HARD = r",;|\u2022\u00b7\u3001\uff0c\uff1b\uff5c\n\r\t"


def delimiter(hyphen: bool) -> str:
    """The pattern of what separates two values: marks anywhere, slash (and hyphen) only between white space."""
    return rf"[{_HARD}]|(?<=\s)[/{'\\-\u2013\u2014' if hyphen else ''}](?=\s)"


def _literals(hyphen: bool) -> str:
    soft = "/\\-\u2013\u2014" if hyphen else "/"
    after = rf"(?=\s*$|\s*[{_HARD}]|\s+[{soft}]\s)"
    before = rf"(^\s*|[{_HARD}]\s*|\s[{soft}]\s+)"
    inner = rf"'(?!\s*$|\s*[{_HARD}]|\s+[{soft}]\s)"
    double = r'"([^"]*(?:""[^"]*)*)"'
    single = rf"'([^']*(?:{inner}[^']*)*)'"
    round_ = r"(\([^()]*(?:\([^()]*\)[^()]*)*\))"
    within = rf'((?<=[\s(\[])"[^"]*(?:""[^"]*)*"(?=[\s)\]{_HARD}]|$))'
    return rf"(?:{before}(?:{double}|{single}){after})|{round_}|{within}"


def values(cell: Column, hyphen: bool = False) -> Column:
    """array<string> of the values of a cell in their order; empty for a null cell."""
    given = F.coalesce(cell, F.lit(""))
    odd = given.rlike(f"[{CUT}{MARK}{END}{ESCAPE}]")

    def coded(text: Column) -> Column:
        for char, code in _CODES.items():
            text = F.replace(text, F.lit(char), F.lit(code))
        return text

    def meant(value: Column) -> Column:
        for char, code in reversed(_CODES.items()):
            value = F.replace(value, F.lit(code), F.lit(char))
        return value

    text = F.regexp_replace(F.when(odd, coded(given)).otherwise(given), r"(?U)^\s*\[([^\[\]]*)\]\s*$", "$1")
    # before the mark stands the inside of double quotes, after it what is kept as it is
    pieces = F.split(F.regexp_replace(text, _literals(hyphen), f"$1{CUT}$2{MARK}$3$4$5{CUT}"), CUT, -1)

    def folded(piece: Column, i: Column) -> Column:
        literal = F.concat(F.replace(F.substring_index(piece, MARK, 1), F.lit('""'), F.lit('"')), F.substring_index(piece, MARK, -1))
        return F.when(i % 2 == 1, literal).otherwise(F.regexp_replace(piece, delimiter(hyphen), END))

    found = F.split(F.array_join(F.transform(pieces, folded), ""), END, -1)
    return F.filter(F.transform(F.when(odd, F.transform(found, meant)).otherwise(found), strip), lambda v: v != "")


def unpack(df: DataFrame, key: str, fields: dict[str, bool], src_table: str, at_least: int = 1) -> DataFrame:
    """One row per value: src_table, key, field_name, pos (from 1), val.

    ``fields`` maps a column to whether a spaced hyphen separates in it.  Cells with fewer than ``at_least``
    values give no rows.  Other columns of ``df`` are not read, whatever their names.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("field_name"), values(F.col(f"`{name}`"), hyphen).alias("vals")) for name, hyphen in fields.items()])
    rows = df.select(F.col(f"`{key}`").alias(key), F.inline(cells)).where(F.size("vals") >= at_least)
    return rows.select(F.lit(src_table).alias("src_table"), key, "field_name", F.posexplode("vals").alias("pos0", "val")).select(
        "src_table", key, "field_name", (F.col("pos0") + 1).alias("pos"), "val"
    )
