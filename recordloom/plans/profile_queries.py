"""Queries of the engine's operators over the test tables, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import dims, resume
from recordloom.functions import normalize as N
from recordloom.functions.cells import STAND_INS
from recordloom.operators import fusion, linkage, projection, report, validation
from recordloom.operators.schema import EXPERIENCE
from recordloom.runtime import table
from recordloom.sources import files, records

AS_OF = "2025-06"
SOURCES = {"candidates": "csv", "student1_english": "ats_json", "edge_case_structured": "recruiter_notes"}


def _joined(c, mark="|"):
    return F.array_join(F.array_sort(c), mark)


# ------------------------------------------------------------------ inputs


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of people as extractions of three sources."""
    parts = [records.from_rows(table(spark, sf_dir, "candidates"), "ext_id", "csv", "source_file")]
    people = table(spark, sf_dir, "student1_english")
    exp = F.transform("experience", lambda e: F.struct(e["company"], e["title"], e["start_date"], e["end_date"], e["summary"]).cast("struct<company:string,title:string,start_date:string,end_date:string,summary:string>"))
    edu = F.transform("education", lambda e: F.struct(e["institution"].alias("institution"), e["degree"].alias("degree"), e["field_of_study"].alias("field_of_study"), e["end_year"].cast("string").alias("year"), F.lit(None).cast("string").alias("summary")))
    people = people.withColumn("experience", F.coalesce(exp, F.array().cast(EXPERIENCE))).withColumn("education", edu).drop("total_years_experience")
    parts.append(records.from_rows(people, "ext_id", "ats_json", "source_file", lists=True))
    parts.append(records.from_rows(table(spark, sf_dir, "edge_case_structured"), "ext_id", "recruiter_notes", "source_file"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extraction with the root of its group; one that shares nothing is a group of its own."""
    ext = extractions(spark, sf_dir)
    return fusion.ordered(ext, linkage.link(ext, ignore_stand_ins=True))


# ------------------------------------------------------------------ text and normalisers


def extract_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _joined(resume.mails(F.col("text"))).alias("emails"))


def extract_phones(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _joined(resume.phones(F.col("text"))).alias("phones"))


def extract_location(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(n) for n, c in resume.location(F.col("text")).items()])


def phone_e164(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("ext_id", N.phone_e164(F.col("phone")).alias("digits_rule"), N.phone_e164(F.col("phone"), "library").alias("library_rule"))


def date_ym(spark, sf_dir):
    jobs = table(spark, sf_dir, "student2_indian").select("ext_id", F.posexplode("experience").alias("pos", "e"))
    return jobs.select("ext_id", "pos", N.date_ym(F.col("e.start_date")).alias("start_ym"), N.date_ym(F.col("e.end_date")).alias("end_ym"))


def skill_canonical(spark, sf_dir):
    rows = table(spark, sf_dir, "student1_english").select("ext_id", F.posexplode(records.split_multi(F.col("skills"))).alias("pos", "raw"))
    return rows.select("ext_id", "pos", N.skill_name(F.col("raw")).alias("skill"))


def country_iso(spark, sf_dir):
    return table(spark, sf_dir, "student2_indian").select("ext_id", N.country_iso2(F.col("location.country")).alias("iso"))


def url_key(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("ext_id", N.url_key(F.col("linkedin")).alias("key"))


def content_dedup(spark, sf_dir):
    return files.first_of_each(table(spark, sf_dir, "documents").select("doc_id", "text"), F.md5("text"), "doc_id").select("doc_id")


# ------------------------------------------------------------------ readers


def csv_extraction(spark, sf_dir):
    e = records.from_rows(table(spark, sf_dir, "candidates"), "ext_id", "csv", "source_file")
    lists = [F.array_join(c, "|").alias(c) for c in ("emails", "phones", "skills")]
    return e.select("ext_id", "full_name", *lists, "company", "title", "location_city", "location_region", "location_country", "linkedin")


def json_keys(spark, sf_dir):
    e = records.from_json_records(table(spark, sf_dir, "student_files"), "rec_id", "payload")
    plain = lambda c: F.when(~F.col(c).rlike(r"^[\[{]"), F.col(c)).alias(c)
    return e.select(F.col("ext_id").alias("rec_id"), plain("company"), plain("title"), plain("linkedin"), plain("github"), F.size("experience").alias("n_experience"))


def resume_person(spark, sf_dir):
    p = resume.person(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", p["full_name"].alias("full_name"), p["headline"].alias("headline"), F.array_join(p["skills"], "|").alias("skills"), *[F.to_json(p[c]).alias(c) for c in ("experience", "education")])


# ------------------------------------------------------------------ linkage


def link_tokens(spark, sf_dir):
    return linkage.tokens(extractions(spark, sf_dir), ignore_stand_ins=True)


def link_components(spark, sf_dir):
    return linkage.link(extractions(spark, sf_dir), ignore_stand_ins=True)


# ------------------------------------------------------------------ fusion


def merge_priority(spark, sf_dir):
    return fusion.resolve(members(spark, sf_dir), "company").select("root", F.col("value").alias("company"), "source", "adjustment")


def name_agreement(spark, sf_dir):
    return fusion.resolve(members(spark, sf_dir), "full_name", True).select("root", F.col("value").alias("full_name"), "source", "adjustment")


def merged_emails(spark, sf_dir):
    return fusion._in_order(fusion.emails(members(spark, sf_dir)), "emails").select("root", F.array_join("emails", "|").alias("emails"))


def merged_phones(spark, sf_dir):
    return fusion._in_order(fusion.phones(members(spark, sf_dir)), "phones").select("root", F.array_join("phones", "|").alias("phones"))


def merged_location(spark, sf_dir):
    return fusion.locations(members(spark, sf_dir)).select("root", "location.city", "location.region", "location.country", "source")


def merged_links(spark, sf_dir):
    return fusion.links(members(spark, sf_dir))


def merged_skills(spark, sf_dir):
    return fusion.skills(members(spark, sf_dir)).select("root", "key", "name", F.array_join("sources", "|").alias("sources"), F.round("confidence", 6).alias("confidence"))


def experience_dedup(spark, sf_dir):
    return fusion.experience(members(spark, sf_dir)).select("root", "company", "title", F.col("start").alias("start_ym"), F.col("end").alias("end_ym"))


def experience_years(spark, sf_dir):
    return fusion.years(fusion.experience(members(spark, sf_dir)), AS_OF)


def education_first(spark, sf_dir):
    return fusion.education(members(spark, sf_dir)).select("root", "institution", "degree", "field_of_study")


def provenance_distinct(spark, sf_dir):
    ext = extractions(spark, sf_dir)
    return fusion.provenance(fusion.ordered(fusion.traceable(ext), linkage.link(ext, ignore_stand_ins=True)))


def fuse_profiles(spark, sf_dir):
    ext = extractions(spark, sf_dir)
    p = fusion.fuse(ext, linkage.link(ext, ignore_stand_ins=True), AS_OF)
    return report.summary(p)


def fused_profile(spark, sf_dir):
    """The whole profile, its lists in their order."""
    ext = extractions(spark, sf_dir)
    p = fusion.fuse(ext, linkage.link(ext, ignore_stand_ins=True), AS_OF)
    text = lambda *cs: F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])
    each = lambda c, *fields: F.array_join(F.transform(c, lambda x: text(*[x[f] for f in fields])), "|").alias(c)
    skills = F.array_join(F.transform("skills", lambda x: F.concat_ws("/", x["name"], x["confidence"].cast("string"), F.array_join(x["sources"], "+"))), "|").alias("skills")
    return p.select(
        "candidate_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "location.city", "location.region", "location.country", "links.linkedin", "links.github", "total_years_experience", skills,
        each("experience", "company", "title", "start", "end", "summary"), each("education", "institution", "degree", "field"), each("provenance", "field", "source"), "overall_confidence",
    )


def overall_confidence(spark, sf_dir):
    ext = extractions(spark, sf_dir)
    return fusion.confidence(ext, linkage.link(ext, ignore_stand_ins=True))


# ------------------------------------------------------------------ projection, validation, report


def _profiles(spark, sf_dir):
    exp = F.transform("experience", lambda e: F.struct(e["company"].alias("company"), e["title"].alias("title"), e["start_date"].alias("start"), e["end_date"].alias("end")))
    prov = F.transform("provenance", lambda p: F.struct(p["field_name"].alias("field"), p["source"].alias("source"), p["method"].alias("method")))
    return table(spark, sf_dir, "result_with_pdfs").withColumn("experience", exp).withColumn("provenance", prov).withColumn("candidate_id", F.col("result_id").cast("string"))


def project_custom(spark, sf_dir):
    config = {
        "fields": [{"path": "candidate_id"}, {"path": "full_name"}, {"from": "emails[0]", "path": "primary_email"}, {"from": "phones[0]", "path": "primary_phone", "normalize": "E164"}, {"path": "location.country"}, {"path": "no.such.path"}],
        "include_confidence": True, "missing_value": "null",
    }
    return projection.project(_profiles(spark, sf_dir), config)


def project_fanout(spark, sf_dir):
    config = {"fields": [{"path": "candidate_id"}, {"path": "skills[].name", "normalize": "canonical"}, {"from": "experience[].company", "path": "companies"}], "missing_value": "null"}
    p = projection.project(_profiles(spark, sf_dir), config)
    return p.select("candidate_id", F.array_join("name", "|").alias("skills"), F.array_join("companies", "|").alias("companies"))


def project_required(spark, sf_dir):
    config = {"fields": [{"path": "candidate_id", "required": True}, {"path": "full_name", "required": True}, {"from": "emails[0]", "path": "email", "required": True}], "missing_value": "error"}
    return projection.project(_profiles(spark, sf_dir), config)


_POLICY = {"fields": [{"path": "full_name", "required": True}, {"from": "emails[0]", "path": "primary_email", "required": True}, {"path": "location.country"}], "include_confidence": True}


def project_null(spark, sf_dir):
    """The documents of the sink under the policy null."""
    return projection.to_json(_profiles(spark, sf_dir), {**_POLICY, "missing_value": "null"})


def project_omit(spark, sf_dir):
    """The documents of the sink under the policy omit."""
    return projection.to_json(_profiles(spark, sf_dir), {**_POLICY, "missing_value": "omit"})


def project_error(spark, sf_dir):
    """The documents of the sink under the policy error."""
    return projection.to_json(_profiles(spark, sf_dir), {**_POLICY, "missing_value": "error"})


def project_left_out(spark, sf_dir):
    """What the policy error leaves out, and why."""
    return projection.rejects(_profiles(spark, sf_dir), _POLICY).select("candidate_id", F.array_join("missing", "|").alias("missing"))


def validate_semantic(spark, sf_dir):
    v = validation.validate(_profiles(spark, sf_dir))
    return v.select("candidate_id", F.size("errors").alias("n_errors"))


def validate_messages(spark, sf_dir):
    """What the checks say of records that were never normalised."""
    exp = F.transform("experience", lambda e: F.struct(e["company_name"].alias("company"), e["job_title"].alias("title"), e["start_date"].alias("start"), e["end_date"].alias("end")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("overall_confidence", "double"), ("total_years_experience", "double"), ("skills", "array<struct<name:string,confidence:double,sources:array<string>>>"))]
    rows = table(spark, sf_dir, "student2_indian").select(F.col("ext_id").cast("string").alias("candidate_id"), F.array("cell").alias("phones"), exp.alias("experience"), "location", *none)
    return validation.validate(rows).where(F.size("errors") > 0).select("candidate_id", F.array_join("errors", "|").alias("errors"))


def report_summary(spark, sf_dir):
    return report.summary(_profiles(spark, sf_dir))


def report_cards(spark, sf_dir):
    c = report.cards(_profiles(spark, sf_dir))
    return c.withColumn("top_skills", F.array_join("top_skills", "|"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_emails, extract_phones, extract_location, phone_e164, date_ym, skill_canonical, country_iso, url_key, content_dedup, csv_extraction, json_keys, resume_person, link_tokens, link_components,
        merge_priority, name_agreement, merged_emails, merged_phones, merged_location, merged_links, merged_skills, experience_dedup, experience_years, education_first, provenance_distinct, fuse_profiles, fused_profile,
        overall_confidence, project_custom, project_fanout, project_required, project_null, project_omit, project_error, project_left_out, validate_semantic, validate_messages, report_summary, report_cards,
    )
}

# ------------------------------------------------------------------ the same in SQL

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def _blank(x: str) -> str:
    return f"nullif({_strip(x)}, '')"


def _cell(x: str) -> str:
    quoted = f"trim(trim({_strip(x)}, '\"'), '''')"
    return f"nullif({_strip(quoted)}, '')"


def _quote(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _present(x: str) -> str:
    low = f"lower({_strip(x)})"
    return f"case when {low} in ('', {_quote(STAND_INS)}) or not regexp_matches({low}, '[\\p{{L}}\\p{{N}}]') then null else {_strip(x)} end"


def _e164(x: str, library: bool = False) -> str:
    d = f"regexp_replace({_strip(x)}, '[^0-9]', '', 'g')"
    tail = f"when length({d}) between 7 and 9 then '+1' || {d}" if library else f"when length({d}) >= 7 then '+' || {d}"
    return f"case when {x} is null or {d} = '' then null when {_strip(x)} like '+%' then '+' || {d} when length({d}) = 10 then '+1' || {d} when length({d}) = 11 and {d} like '1%' then '+' || {d} when length({d}) = 12 and {d} like '91%' then '+' || {d} {tail} end"


def _ym(x: str) -> str:
    v = _strip(x)
    month = "case lower({m}) " + " ".join(f"when '{k}' then {n}" for k, n in dims.MONTHS.items()) + " end"
    forms = [
        (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 1, 2, False), (r"^(\d{4})[-/](\d{1,2})$", 1, 2, False), (r"^(\d{1,2})[/-](\d{4})$", 2, 1, False), (r"^([A-Za-z]+)\s+(\d{1,2})\s*,?\s*(\d{4})$", 3, 1, True),
        (r"^(\d{1,2})\s+([A-Za-z]+)\s*,?\s*(\d{4})$", 3, 2, True), (r"^([A-Za-z]+)\s*,?\s*(\d{4})$", 2, 1, True), (r"^(\d{4})$", 1, 0, False),
    ]
    tries = []
    for rx, y, m, named in forms:
        year = f"try_cast(regexp_extract({v}, '{rx}', {y}) as int)"
        mon = "1" if m == 0 else month.format(m=f"regexp_extract({v}, '{rx}', {m})") if named else f"try_cast(regexp_extract({v}, '{rx}', {m}) as int)"
        tries.append(f"case when {year} between 1900 and 2100 and ({mon}) between 1 and 12 then printf('%04d-%02d', {year}, {mon}) end")
    return f"case when lower({v}) in ({_quote(dims.PRESENT)}) then null else coalesce({', '.join(tries)}) end"


def _url(x: str) -> str:
    v = f"regexp_replace(lower({_strip(x)}), '/+$', '')"
    for p in (r"^https://www\.", r"^http://www\.", "^https://", "^http://", r"^www\."):
        v = f"regexp_replace({v}, '{p}', '')"
    return f"case when {_strip(x)} <> '' then {v} end"


def _split(x: str, marks: str = "[;,]") -> str:
    return f"coalesce(list_filter(list_transform(regexp_split_to_array({x}, '{marks}'), lambda p: {_strip('p')}), lambda p: p <> ''), [])"


def _skill_table() -> str:
    return "skill_alias(k, v) as (values " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in sorted(dims.skill_aliases().items())) + ")"


def _country_table() -> str:
    return "country_alias(k, v) as (values " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in sorted(dims.country_aliases().items())) + ")"


def _title(x: str) -> str:
    """Capitals after what is no letter, letter by letter."""
    return f"list_reduce(list_prepend('', string_split(lower({x}), '')), lambda acc, c: acc || case when acc = '' or not regexp_matches(right(acc, 1), '\\p{{L}}') then upper(c) else c end)"


def _skill(x: str, alias: str) -> str:
    return f"coalesce({alias}.v, case when {x} = lower({x}) and {x} <> upper({x}) then {_title(x)} else {x} end)"


_PROFILE = r"regexp_extract(lower(" + _strip("linkedin") + r"), 'linkedin\.[a-z.]+/(?:[a-z]{2}/)?(?:in|pub|profile)/+([^/?#\s]+)', 1)"
_EXT = "ext as (" + " union all ".join(
    f"select ext_id, '{s}' as source_name, {dims.PRIORITY[s]} as pri, {_cell('name')} as full_name, {_cell('email')} as email, {_cell('phone')} as phone, {_cell(c)} as company, {_cell('title')} as title, {_cell('location')} as location, {_cell('skills')} as skills, {_cell('linkedin')} as linkedin, {_cell(g)} as github from {t}"
    for t, s, c, g in (("candidates", "csv", "current_company", "cast(null as varchar)"), ("student1_english", "ats_json", "company", "github"), ("edge_case_structured", "recruiter_notes", "current_company", "github"))
) + ")"


_RESULTS = "select result_id::varchar as candidate_id, * exclude (candidate_id) from result_with_pdfs"


def _policy_sql(omit: bool, where: str = "true") -> str:
    cells = {"full_name": "full_name", "primary_email": "emails[1]", "country": "location.country", "overall_confidence": "overall_confidence"}
    absent = set(cells) if omit else {"overall_confidence"}
    part = lambda k, c: (f"case when {c} is not null then '\"{k}\":' || to_json({c})::varchar end" if k in absent else f"'\"{k}\":' || coalesce(to_json({c})::varchar, 'null')")
    return f"select '{{' || array_to_string(list_filter([{', '.join(part(k, c) for k, c in cells.items())}], lambda x: x is not null), ',') || '}}' as json from ({_RESULTS}) where {where}"


def _messages_sql() -> str:
    wrong = lambda c, rx: f"{c} <> '' and not regexp_matches({c}, '{rx}')"
    each = lambda values, f, path, rx, form: f"list_filter(list_transform(coalesce({values}, []), lambda x, i: case when {wrong(f, rx)} then '{path[0]}[' || (i - 1) || ']{path[1]} \"' || {f} || '\" does not match {form} format' end), lambda m: m is not null)"
    ym = r"^\d{4}-(?:0[1-9]|1[0-2])$"
    lists = [
        each("[cell]", "x", ("phones", ""), r"^\+\d{1,15}$", "E.164"), each("experience", "x.start_date", ("experience", ".start"), ym, "YYYY-MM"), each("experience", "x.end_date", ("experience", ".end"), ym, "YYYY-MM"),
        f"case when {wrong('location.country', '^[A-Z]{2}$')} then ['location.country \"' || location.country || '\" does not match ISO-3166 alpha-2 format'] else [] end",
    ]
    return f"with e as (select ext_id::varchar as candidate_id, {' || '.join(lists)} as errors from student2_indian) select candidate_id, array_to_string(errors, '|') as errors from e where len(errors) > 0"


def _groups() -> str:
    """roots: every record with the smallest record that it is linked to, directly or through others."""
    return (
        f"{_EXT}, {_tokens()}, star as (select distinct ext_id as u, min(ext_id) over (partition by kind, key1, key2) as v from tok), edge as (select u, v from star where u <> v union select v, u from star where u <> v), "
        "reach(a, b) as (select u, u from edge union select r.a, e.v from reach r join edge e on e.u = r.b), "
        "roots as (select ext.ext_id, coalesce(min(b), ext.ext_id) as root from ext left join reach on reach.a = ext.ext_id group by ext.ext_id)"
    )


def _same_letters(a: str, b: str) -> str:
    """Letters that differ: DuckDB counts bytes, so every other letter of the two becomes a capital, which they have none of."""
    other = f"array_to_string(list_distinct(regexp_extract_all(lower({a}) || lower({b}), '[^\\x00-\\x7f]')), '')"
    plain = lambda x: f"translate(lower({x}), {other}, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ', length({other})))"
    return f"levenshtein({plain(a)}, {plain(b)}) < 3"


def _resolve(field: str, agree: str) -> str:
    return (
        f"v as (select root, source_name, ord, ext_id, pri, {field} as v from m where {field} is not null), "
        "w as (select *, first_value(v) over (partition by root order by ord) as head, row_number() over (partition by root order by -pri, source_name, ord) as nth from v), "
        f"g as (select root, count(*) as n, bool_and({agree}) as agree from w group by root), "
        "res as (select w.root, w.v as value, w.source_name as source, case when g.n = 1 then 0.0 when g.agree then 0.05 else -0.10 end::double as adjustment from w join g using (root) where nth = 1)"
    )


def _list_of(p: str, split: str, key: str, value: str) -> str:
    """``p``_lst: the first of each distinct value of a list field, with its place."""
    return (
        f"{p}_l as (select root, source_name, ord, unnest({split}) as raw, unnest(range(len({split}))) as pos from m), {p}_k as (select *, {key} as key from {p}_l), "
        f"{p}_f as (select *, row_number() over (partition by root, key order by ord, pos) as nth from {p}_k where key is not null), "
        f"{p}_lst as (select root, source_name as source, ord, pos, {value} as value from {p}_f where nth = 1)"
    )


_MAILS, _PHONES = _split("email"), _split("phone")
_LOC = (
    f"p as (select root, source_name, ord, {_split('location', ',')} as parts from m), q as (select *, case when len(parts) >= 1 then parts[1] end as city, case when len(parts) >= 2 then parts[2] end as region, case when len(parts) >= 3 then parts[3] end as raw, row_number() over (partition by root order by ord) as nth from p where len(parts) > 0), "
    f"{_country_table()}, loc as (select root, city, region, coalesce(ca.v, case when regexp_matches(raw, '^[A-Za-z]{{2}}$') and upper(raw) in ({_quote(dims.CODES)}) then upper(raw) end, raw) as country, source_name as source from q left join country_alias ca on ca.k = lower(raw) where nth = 1)"
)
_SKILLS = (
    f"s as (select root, source_name, ord, unnest({_split('skills', '[;,|]')}) as raw, unnest(range(len({_split('skills', '[;,|]')}))) as pos from m), {_skill_table()}, "
    f"n as (select s.*, {_skill('s.raw', 'sa')} as name from s left join skill_alias sa on sa.k = lower(s.raw)), "
    "sk as (select root, lower(name) as key, arg_min(name, ord * 100000 + pos) as name, list_sort(list_distinct(list(source_name))) as src from n group by 1, 2)"
)
_JOBS = (
    "e as (select root, ord, source_name, unnest(experience) as x, unnest(range(len(experience))) as pos from m join student1_english t using (ext_id)), "
    f"e2 as (select *, row_number() over (partition by root, lower(coalesce({_blank('x.start_date')}, '')) order by ord, pos) as nth from e), "
    f"jobs as (select root, ord, pos, source_name as source, {_blank('x.company')} as company, {_blank('x.title')} as title, {_ym('x.start_date')} as start_ym, {_ym('x.end_date')} as end_ym, {_blank('x.summary')} as summary from e2 where nth = 1)"
)
_STUDIES = (
    "d as (select root, ord, source_name, unnest(education) as x, unnest(range(len(education))) as pos from m join student1_english t using (ext_id)), d2 as (select *, row_number() over (partition by root order by ord, pos) as nth from d), "
    f"studies as (select root, source_name as source, {_blank('x.institution')} as institution, {_blank('x.degree')} as degree, {_blank('x.field_of_study')} as field_of_study from d2 where nth = 1)"
)
_MONTHS = "((left(coalesce(end_ym, '{0}'), 4)::int - left(start_ym, 4)::int) * 12 + right(coalesce(end_ym, '{0}'), 2)::int - right(start_ym, 2)::int)".format(AS_OF)


def _tokens() -> str:
    p = lambda x: f"lower({_present(x)})"
    some = "select ext_id, '{kind}' as kind, {k1} as key1, {k2} as key2 from {src} where {k1} is not null and {k2} is not null"
    flat = "(select ext_id, full_name, company, title, linkedin, github, unnest({l}) as x from ext)"
    jobs = "(select ext.ext_id, full_name, unnest(experience) as e from ext join student1_english using (ext_id))"
    parts = [
        some.format(kind="email", k1=p("x"), k2="''", src=flat.format(l=_MAILS)),
        some.format(kind="phone", k1=_e164(f"({_present('x')})"), k2="''", src=flat.format(l=_PHONES)),
        some.format(kind="linkedin", k1=_url(f"({_present('linkedin')})"), k2="''", src="ext"),
        some.format(kind="github", k1=_url(f"({_present('github')})"), k2="''", src="ext"),
        some.format(kind="name_company", k1=p("full_name"), k2=p("company"), src="ext"),
        some.format(kind="name_company", k1=p("full_name"), k2=p("e.company"), src=jobs),
        some.format(kind="name_title", k1=p("full_name"), k2=p("title"), src="ext"),
        some.format(kind="name_title", k1=p("full_name"), k2=p("e.title"), src=jobs),
    ]
    return "tok as (" + " union ".join(parts) + ")"


_MEMBERS = f"{_groups()}, m as (select ext.*, root, row_number() over (partition by root order by -pri, source_name, ext.ext_id) as ord from ext join roots using (ext_id))"
_MAIL_LIST, _PHONE_LIST = _list_of("mail", _MAILS, "lower(raw)", "raw"), _list_of("phone", _PHONES, _e164("raw"), "key")
_NAMES = _resolve("full_name", _same_letters("v", "head"))
_LINKS = "fl as (select source_name, root, 'links.linkedin' as field, row_number() over (partition by root order by ord) as nth from m where linkedin is not null union all select source_name, root, 'links.github', row_number() over (partition by root order by ord) from m where github is not null)"
_PROVENANCE = (
    "prov as (select root, 'full_name' as field, source from res union select root, 'email', source from mail_lst union select root, 'phone', source from phone_lst union select root, 'location', source from loc union select root, field, source_name from fl where nth = 1 "
    "union select root, 'skill:' || name, unnest(src) from sk union select root, 'experience:' || coalesce(company, ''), source from jobs union select root, 'education:' || coalesce(institution, ''), source from studies)"
)
_WHOLE = f"{_MEMBERS}, {_NAMES}, {_MAIL_LIST}, {_PHONE_LIST}, {_LOC}, {_LINKS}, {_SKILLS}, {_JOBS}, {_STUDIES}, {_PROVENANCE}"
_COUNTED = (
    "size as (select root, count(distinct source_name) as n from m group by root), "
    + ", ".join(f"n_{n} as (select root, count(*)::int as n from {t} group by root)" for n, t in (("emails", "mail_lst"), ("phones", "phone_lst"), ("skills", "sk"), ("experience", "jobs"), ("education", "studies")))
    + ", scored as (select size.root, res.value as full_name, "
    + ", ".join(f"coalesce(n_{n}.n, 0) as n_{n}" for n in ("emails", "phones", "skills", "experience", "education"))
    + ", 0.5 + least(size.n, 4) * 0.1 + 0.02 * ((res.value is not null)::int + (n_emails.n is not null)::int + (n_phones.n is not null)::int + (n_experience.n is not null)::int + (n_skills.n is not null)::int + (n_education.n is not null)::int) "
    "+ coalesce(adjustment, 0) + case when size.n >= 2 and res.value is not null then 0.05 else 0 end - case when res.value is null then 0.05 else 0 end - case when n_emails.n is null then 0.05 else 0 end as score "
    "from size left join res using (root) " + " ".join(f"left join n_{n} using (root)" for n in ("emails", "phones", "skills", "experience", "education")) + "), "
    "conf as (select *, round(greatest(0, least(1, score)), 2)::double as overall_confidence from scored)"
)


def _json_oracle() -> str:
    pick = lambda f: "coalesce(" + ", ".join(f"nullif(json_extract_string(payload, '$.{k}'), 'null')" for k in dims.KEYS[f]) + ")"
    cell = lambda f: f"case when not regexp_matches({_blank(pick(f))}, '^[\\[{{]') then {_blank(pick(f))} end as {f}"
    size = "coalesce(" + ", ".join(f"json_array_length(payload, '$.{k}')" for k in dims.KEYS["experience"]) + ", 0)::int as n_experience"
    return f"select rec_id, {', '.join(map(cell, ('company', 'title', 'linkedin', 'github')))}, {size} from student_files"


_MAIL, _PHONE = resume.MAIL, resume.PHONE
_LOCATION = resume.LOCATION.replace("(?<city>", "(").replace("(?<region>", "(").replace("(?<country>", "(")

ORACLE = {
    "extract_emails": f"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_MAIL}'))), '|') as emails from documents",
    "extract_phones": f"select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{_PHONE}'), lambda p: {_strip('p')}), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) between 7 and 15))), '|') as phones from documents",
    "extract_location": "select doc_id, " + ", ".join(f"{_strip(f'''regexp_extract(text, '{_LOCATION}', {k})''')} as location_{n}" for k, n in ((1, "city"), (2, "region"), (3, "country"))) + " from documents",
    "phone_e164": f"select ext_id, {_e164('phone')} as digits_rule, {_e164('phone', True)} as library_rule from candidates",
    "date_ym": f"with e as (select ext_id, unnest(experience) as x, unnest(range(len(experience))) as pos from student2_indian) select ext_id, pos::int as pos, {_ym('x.start_date')} as start_ym, {_ym('x.end_date')} as end_ym from e",
    "skill_canonical": f"with {_skill_table()}, s as (select ext_id, unnest({_split('skills')}) as raw, unnest(range(len({_split('skills')}))) as pos from student1_english) select ext_id, pos::int as pos, {_skill('s.raw', 'sa')} as skill from s left join skill_alias sa on sa.k = lower(s.raw)",
    "country_iso": f"with {_country_table()} select ext_id, coalesce(ca.v, case when regexp_matches({_strip('location.country')}, '^[A-Za-z]{{2}}$') and upper({_strip('location.country')}) in ({_quote(dims.CODES)}) then upper({_strip('location.country')}) end) as iso from student2_indian left join country_alias ca on ca.k = lower({_strip('location.country')})",
    "url_key": f"select ext_id, {_url('linkedin')} as key from candidates",
    "content_dedup": "select min(doc_id) as doc_id from documents group by md5(text)",
    "csv_extraction": f"with {_EXT}, p as (select *, {_split('location', ',')} as parts from ext where source_name = 'csv') select ext_id, full_name, array_to_string({_MAILS}, '|') as emails, array_to_string({_PHONES}, '|') as phones, array_to_string({_split('skills', '[;,|]')}, '|') as skills, company, title, "
    "case when len(parts) >= 1 then parts[1] end as location_city, case when len(parts) >= 2 then parts[2] end as location_region, case when len(parts) >= 3 then parts[3] end as location_country, linkedin from p",
    "json_keys": _json_oracle(),
    "link_tokens": f"with {_EXT}, {_tokens()} select ext_id, kind, key1, key2 from tok",
    "link_components": f"with recursive {_groups()} select ext_id, root from roots",
    "merge_priority": f"with recursive {_MEMBERS}, {_resolve('company', 'lower(v) = lower(head)')} select root, value as company, source, adjustment from res",
    "name_agreement": f"with recursive {_MEMBERS}, {_NAMES} select root, value as full_name, source, adjustment from res",
    "merged_emails": f"with recursive {_MEMBERS}, {_MAIL_LIST} select root, string_agg(value, '|' order by ord, pos) as emails from mail_lst group by root",
    "merged_phones": f"with recursive {_MEMBERS}, {_PHONE_LIST} select root, string_agg(value, '|' order by ord, pos) as phones from phone_lst group by root",
    "merged_location": f"with recursive {_MEMBERS}, {_LOC} select root, city, region, country, source from loc",
    "merged_links": f"with recursive {_MEMBERS} select root, arg_min(linkedin, ord) filter (linkedin is not null) as linkedin, arg_min(source_name, ord) filter (linkedin is not null) as linkedin_source, arg_min(github, ord) filter (github is not null) as github, arg_min(source_name, ord) filter (github is not null) as github_source from m group by root",
    "merged_skills": f"with recursive {_MEMBERS}, {_SKILLS} select root, key, name, array_to_string(src, '|') as sources, case len(src) when 1 then 0.6 when 2 then 0.8 else 0.95 end::double as confidence from sk",
    "experience_dedup": f"with recursive {_MEMBERS}, {_JOBS} select root, company, title, start_ym, end_ym from jobs",
    "experience_years": f"with recursive {_MEMBERS}, {_JOBS} select root, round_even(sum({_MONTHS}) / 12.0, 1)::double as total_years_experience from jobs where start_ym is not null and {_MONTHS} > 0 group by root",
    "education_first": f"with recursive {_MEMBERS}, {_STUDIES} select root, institution, degree, field_of_study from studies",
    "provenance_distinct": f"with recursive {_WHOLE} select root, field, source from prov",
    "fuse_profiles": f"with recursive {_WHOLE}, {_COUNTED} select sha256(root::varchar) as candidate_id, full_name, overall_confidence, n_emails, n_phones, n_skills, n_experience, n_education, array_to_string(list_sort(list(distinct prov.source)), ', ') as sources from conf left join prov using (root) group by all",
    "overall_confidence": f"with recursive {_WHOLE}, {_COUNTED} select root, overall_confidence from conf",
    "fused_profile": f"with recursive {_WHOLE}, {_COUNTED}, "
    "t1 as (select root, string_agg(value, '|' order by ord, pos) as emails from mail_lst group by root), t2 as (select root, string_agg(value, '|' order by ord, pos) as phones from phone_lst group by root), "
    "t3 as (select root, arg_min(linkedin, ord) filter (linkedin is not null) as linkedin, arg_min(github, ord) filter (github is not null) as github from m group by root), "
    "t4 as (select root, string_agg(name || '/' || (case len(src) when 1 then 0.6 when 2 then 0.8 else 0.95 end)::double::varchar || '/' || array_to_string(src, '+'), '|' order by key) as skills from sk group by root), "
    "t5 as (select root, string_agg(coalesce(company, '') || '/' || coalesce(title, '') || '/' || coalesce(start_ym, '') || '/' || coalesce(end_ym, '') || '/' || coalesce(summary, ''), '|' order by coalesce(start_ym, '0000-00') desc, ord, pos) as experience from jobs group by root), "
    f"t6 as (select root, round_even(sum({_MONTHS}) / 12.0, 1)::double as total_years_experience from jobs where start_ym is not null and {_MONTHS} > 0 group by root), "
    "t7 as (select root, string_agg(field || '/' || source, '|' order by field, source) as provenance from prov group by root) "
    "select sha256(root::varchar) as candidate_id, full_name, coalesce(emails, '') as emails, coalesce(phones, '') as phones, city, region, country, linkedin, github, total_years_experience, coalesce(t4.skills, '') as skills, coalesce(t5.experience, '') as experience, "
    "case when studies.root is null then '' else coalesce(institution, '') || '/' || coalesce(degree, '') || '/' || coalesce(field_of_study, '') end as education, coalesce(provenance, '') as provenance, overall_confidence "
    "from conf left join t1 using (root) left join t2 using (root) left join loc using (root) left join t3 using (root) left join t4 using (root) left join t5 using (root) left join t6 using (root) left join studies using (root) left join t7 using (root)",
    "project_custom": f"select candidate_id, full_name, emails[1] as primary_email, coalesce({_e164('phones[1]')}, phones[1]) as primary_phone, location.country as country, cast(null as varchar) as path, overall_confidence from ({_RESULTS})",
    "project_fanout": f"with {_skill_table()}, r as ({_RESULTS}), s as (select candidate_id, unnest(list_transform(skills, lambda x: {_strip('x.name')})) as raw, unnest(range(len(skills))) as pos from r), n as (select candidate_id, string_agg({_skill('s.raw', 'sa')}, '|' order by pos) as skills from s left join skill_alias sa on sa.k = lower(s.raw) group by 1) "
    "select r.candidate_id, n.skills, case when len(experience) > 0 then array_to_string(list_filter(list_transform(experience, lambda e: e.company), lambda c: c is not null), '|') end as companies from r left join n using (candidate_id)",
    "project_required": f"select candidate_id, full_name, emails[1] as email from ({_RESULTS}) where candidate_id is not null and full_name is not null and emails[1] is not null",
    "project_null": _policy_sql(False),
    "project_omit": _policy_sql(True),
    "project_error": _policy_sql(False, "full_name is not null and emails[1] is not null"),
    "project_left_out": f"select candidate_id, concat_ws('|', case when full_name is null then 'full_name' end, case when emails[1] is null then 'primary_email' end) as missing from ({_RESULTS}) where full_name is null or emails[1] is null",
    "validate_messages": _messages_sql(),
    "validate_semantic": f"select candidate_id, (coalesce(len(list_filter(phones, lambda p: p <> '' and not regexp_matches(p, '^\\+\\d{{1,15}}$'))), 0) + coalesce(len(list_filter(experience, lambda e: e.start_date <> '' and not regexp_matches(e.start_date, '^\\d{{4}}-(?:0[1-9]|1[0-2])$'))), 0) + coalesce(len(list_filter(experience, lambda e: e.end_date <> '' and not regexp_matches(e.end_date, '^\\d{{4}}-(?:0[1-9]|1[0-2])$'))), 0) "
    f"+ case when location.country <> '' and not regexp_matches(location.country, '^[A-Z]{{2}}$') then 1 else 0 end + case when overall_confidence not between 0 and 1 then 1 else 0 end + case when total_years_experience < 0 then 1 else 0 end + case when len(list_filter(skills, lambda s: s.name is null or s.confidence not between 0 and 1)) > 0 then 1 else 0 end)::int as n_errors from ({_RESULTS})",
    "report_summary": "select candidate_id, full_name, overall_confidence, " + ", ".join(f"coalesce(len({c}), 0)::int as n_{c}" for c in ("emails", "phones", "skills", "experience", "education")) + f", array_to_string(list_sort(list_distinct(list_transform(provenance, lambda p: p.source))), ', ') as sources from ({_RESULTS})",
    "report_cards": "select candidate_id, full_name, case when overall_confidence >= 0.8 then 'high' when overall_confidence >= 0.5 then 'medium' else 'low' end as band, emails[1] as email, greatest(coalesce(len(emails), 0) - 1, 0)::int as more_emails, array_to_string(list_transform(skills[1:8], lambda s: s.name), '|') as top_skills, greatest(coalesce(len(skills), 0) - 8, 0)::int as more_skills, experience[1].title as latest_title, experience[1].company as latest_company "
    f"from ({_RESULTS})",
}
