"""The queries of the general operators on packed cells, failing rows and drifting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.cells import STAND_INS
from recordloom.operators import drift, packed, rejects
from recordloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every packed cell, with its position."""
    one = packed.unpack(table(spark, sf_dir, "candidates"), "ext_id", {"skills": False, "location": True}, "candidates", at_least=2)
    two = packed.unpack(table(spark, sf_dir, "edge_case_structured"), "ext_id", {"skills": False}, "edge_case_structured", at_least=2)
    return one.unionByName(two)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing records with every reason."""
    return rejects.rejected(table(spark, sf_dir, "invalid_data"), "row_id")


def p2_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound records as rows."""
    return rejects.sound(table(spark, sf_dir, "invalid_data"), "row_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the payload fields of each file against the file before it."""
    return drift.changes(table(spark, sf_dir, "student_files"))


def p7_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of every feed under the field names its feed began with."""
    u = drift.unify(table(spark, sf_dir, "student_files"))
    return u.select("rec_id", "feed_id", "file_no", F.to_json("fields").alias("fields"), F.to_json("experience").alias("experience"))


QUERIES = {"p7_found": p7_found, "p7_unified": p7_unified, "p1_found": p1_found, "p2_found": p2_found, "p2_sound": p2_sound}


def _p2_sql(sound: bool) -> str:
    """The same automaton as one regular expression, and the checks of the fields."""
    field = '"[^"]*(?:""[^"]*)*"|[^",]*'
    ws = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
    stand_ins = ", ".join("'" + w.replace("'", "''") + "'" for w in STAND_INS)
    cell = lambda k: f"trim(case when f[{k}] like '\"%' then replace(f[{k}][2:-2], '\"\"', '\"') else f[{k}] end, {ws})"
    rows = (
        f"with r as (select row_id, coalesce(raw, '') as raw from invalid_data), p as (select row_id, regexp_full_match(raw, '(?:{field})(?:,(?:{field}))*') as fine, regexp_extract_all(',' || raw, ',({field})', 1) as f from r), "
        f"c as (select row_id, fine, len(f) = 4 as four, {cell(1)} as name, {cell(2)} as email, {cell(3)} as phone, {cell(4)} as skills from p), "
        "d as (select *, list_filter(list_transform(string_split(email, ';'), lambda x: trim(x)), lambda x: x <> '') as mails, "
        f"trim(regexp_replace(phone, '(?i)\\s*\\bext\\.\\s*\\d+$', ''), {ws}) as core from c), "
        f"e as (select *, name = '' or not regexp_matches(name, '\\p{{L}}') or regexp_matches(name, '[@\\p{{Nd}}]') or lower(name) in ({stand_ins}) as bad_name, "
        "email <> '' and (len(mails) = 0 or len(list_filter(mails, lambda x: not regexp_full_match(x, '[^@\\s]+@[^@\\s.]+(?:\\.[^@\\s.]+)+'))) > 0) as bad_email, "
        "phone <> '' and not (regexp_full_match(core, '\\+?[0-9 .()\\-]+') and length(regexp_replace(core, '[^0-9]', '', 'g')) between 7 and 15) as bad_phone from d) "
    )
    if sound:
        return rows + "select row_id, nullif(name, '') as name, nullif(email, '') as email, nullif(phone, '') as phone, nullif(skills, '') as skills from e where fine and four and not (bad_name or bad_email or bad_phone)"
    return rows + (
        "select row_id, 'broken_quoting' as reason from e where not fine union all select row_id, 'column_count' from e where fine and not four "
        "union all select row_id, 'invalid_name' from e where fine and four and bad_name union all select row_id, 'invalid_email' from e where fine and four and bad_email union all select row_id, 'invalid_phone' from e where fine and four and bad_phone"
    )


#: Packed cells need look-ahead and drift needs variants: these are tested against brute force in tests/.
ORACLE: dict[str, str] = {"p2_found": _p2_sql(False), "p2_sound": _p2_sql(True)}
