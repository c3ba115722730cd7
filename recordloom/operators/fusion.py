"""One canonical profile per group of extractions.

The members of a group are put in the order of their sources' priority; every field is its own aggregate, so a
projection that asks for few fields computes few.  Per-record lists (mails, phones, skills) are reduced per value
by hash aggregation before the group is put together, so a group with very many records is spread over its
values first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import dims
from recordloom.functions import normalize as N
from recordloom.operators import scoring


JOB, STUDY = ("company", "title", "start_date", "end_date", "summary"), ("institution", "degree", "field_of_study", "year")


def ordered(ext: DataFrame, groups: DataFrame) -> DataFrame:
    """Extractions with their root and their place in the order of the group."""
    return ext.join(groups, "ext_id").withColumn("pri", dims.priority(F.col("source_name"))).withColumn("ord", _place())


def _place() -> Column:
    return F.struct((-dims.priority(F.col("source_name"))).alias("p"), F.lower("source_name").alias("s"), F.col("ext_id").alias("e"))


def resolve(members: DataFrame, field: str, name_like: bool = False) -> DataFrame:
    """(root, value, source, adjustment): the value of the most trusted source, and whether all agree."""
    value = F.when(N.blank_to_null(F.col(field)).isNotNull(), F.col(field))
    rows = members.select("root", "source_name", "ord", "ext_id", value.alias("v")).where("v is not null")
    win = F.struct(F.col("ord.p").alias("p"), F.col("source_name").alias("s"), F.col("ord").alias("o"))
    first = rows.groupBy("root").agg(F.min_by("v", win).alias("value"), F.min_by("source_name", win).alias("source"), F.count("*").alias("n"), F.min_by("v", "ord").alias("head"))
    same = N.names_agree(F.col("head"), F.col("v")) if name_like else F.lower("head") == F.lower("v")
    agree = rows.join(first.select("root", "head"), "root").groupBy("root").agg(F.min(same).alias("agree"))
    adjustment = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("agree"), F.lit(scoring.AGREE)).otherwise(F.lit(scoring.DISAGREE))
    return first.join(agree, "root").select("root", "value", "source", adjustment.alias("adjustment"))


def _listed(members: DataFrame, values: Column, key) -> DataFrame:
    """(root, key, value, source, ord, pos): the first of each distinct value of a list field."""
    keyed = F.transform(values, lambda x: F.struct(x.alias("raw"), key(x).alias("key")))  # a filter on a column would work it out again
    rows = members.select("root", "source_name", "ord", F.posexplode(keyed).alias("pos", "x")).select("root", "source_name", "ord", "pos", "x.raw", "x.key").where("key is not null")
    first = F.min(F.struct("ord", "pos", "raw", "source_name"))
    return rows.groupBy("root", "key").agg(first.alias("f")).select("root", "key", F.col("f.raw").alias("value"), F.col("f.source_name").alias("source"), F.col("f.ord").alias("ord"), F.col("f.pos").alias("pos"))


def emails(members: DataFrame) -> DataFrame:
    return _listed(members, F.col("emails"), lambda c: N.mail_key(c)).withColumn("value", N.blank_to_null(F.col("value")))


def phones(members: DataFrame, profile: str = "digits") -> DataFrame:
    return _listed(members, F.col("phones"), lambda c: N.phone_e164(c, profile)).withColumn("value", F.col("key"))


def _in_order(rows: DataFrame, name: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("ord", "pos", "value")))  # distinct values of one group
    return rows.groupBy("root").agg(F.transform(packed, lambda x: x["value"]).alias(name))


def locations(members: DataFrame) -> DataFrame:
    """(root, location, source): the first extraction with any part; parts are never mixed."""
    part = lambda c: N.blank_to_null(F.col(c))
    raw = part("location_country")
    loc = F.struct(part("location_city").alias("city"), part("location_region").alias("region"), F.coalesce(N.country_iso2(raw), raw).alias("country"))
    rows = members.where(F.coalesce(part("location_city"), part("location_region"), raw).isNotNull())
    return rows.groupBy("root").agg(F.min_by(loc, F.col("ord")).alias("location"), F.min_by("source_name", "ord").alias("source"))


def links(members: DataFrame) -> DataFrame:
    """(root, linkedin, linkedin_source, github, github_source): the first of each kind as it was written."""
    rows = members.select("root", "ord", "source_name", N.blank_to_null(F.col("linkedin")).alias("linkedin"), N.blank_to_null(F.col("github")).alias("github"))
    first = lambda v, c: F.min_by(v, F.when(F.col(c).isNotNull(), F.col("ord")))
    known = lambda v, c: F.when(F.max(F.col(c).isNotNull()), first(v, c))
    return rows.groupBy("root").agg(*[known(v, c).alias(n) for c in ("linkedin", "github") for v, n in ((c, c), ("source_name", f"{c}_source"))])


def skills(members: DataFrame) -> DataFrame:
    """(root, key, name, sources, confidence), one row per skill of a group."""
    names = F.transform("skills", lambda x: N.skill_name(N.blank_to_null(x)))  # a filter on a column would work it out again
    rows = members.select("root", "source_name", "ord", F.posexplode(names).alias("pos", "name")).where("name is not null")
    per = rows.groupBy("root", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("ord", "pos")).alias("name"), F.array_sort(F.collect_set("source_name")).alias("sources"))
    return per.withColumn("confidence", scoring.skill_confidence(F.col("sources")))


def _low(e: Column, f: str) -> Column:
    return F.lower(F.coalesce(N.blank_to_null(e[f]), F.lit("")))


def _job_key(e: Column, mode: str) -> Column:
    return _low(e, "start_date") if mode == "reference" else F.concat_ws("\u0001", _low(e, "company"), _low(e, "title"), F.coalesce(N.date_ym(N.blank_to_null(e["start_date"])), F.lit("")))


def _study_key(e: Column, mode: str) -> Column:
    return F.lit("") if mode == "reference" else F.concat_ws("\u0001", _low(e, "institution"), _low(e, "degree"))


def experience(members: DataFrame, mode: str = "reference") -> DataFrame:
    """(root, company, title, start, end, summary, source, ord, pos): jobs, repeats left out.

    ``mode='reference'`` takes jobs with the same start as written for one; ``'full'`` looks at company, title
    and the normalised start.
    """
    rows = members.select("root", "source_name", "ord", F.posexplode("experience").alias("pos", "e"))
    text = lambda f: N.blank_to_null(F.col(f"e.{f}"))
    first = F.min(F.struct("ord", "pos", "source_name", "e"))
    kept = rows.groupBy("root", _job_key(F.col("e"), mode).alias("key")).agg(first.alias("f")).select("root", F.col("f.source_name").alias("source"), F.col("f.ord").alias("ord"), F.col("f.pos").alias("pos"), F.col("f.e").alias("e"))
    return kept.select("root", text("company").alias("company"), text("title").alias("title"), N.date_ym(text("start_date")).alias("start"), N.date_ym(text("end_date")).alias("end"), text("summary").alias("summary"), "source", "ord", "pos")


def years(jobs: DataFrame, as_of: str) -> DataFrame:
    """(root, total_years_experience): months of all jobs over twelve; a job without an end lasts until ``as_of``."""
    months = N.months_between_ym(F.col("start"), F.coalesce("end", F.lit(as_of)))
    counted = jobs.where(F.col("start").isNotNull() & (months > 0))
    return counted.groupBy("root").agg(F.bround(F.sum(months) / F.lit(12.0), 1).alias("total_years_experience"))


def education(members: DataFrame, mode: str = "reference") -> DataFrame:
    """(root, institution, degree, field_of_study, end_year, source, ord, pos); ``'reference'`` keeps the first of a group."""
    rows = members.select("root", "source_name", "ord", F.posexplode("education").alias("pos", "e"))
    text = lambda f: N.blank_to_null(F.col(f"e.{f}"))
    year = F.lit(None).cast("int") if mode == "reference" else N.year_of(text("year"))
    first = F.min(F.struct("ord", "pos", "source_name", "e"))
    kept = rows.groupBy("root", _study_key(F.col("e"), mode).alias("key")).agg(first.alias("f")).select("root", F.col("f.source_name").alias("source"), F.col("f.ord").alias("ord"), F.col("f.pos").alias("pos"), F.col("f.e").alias("e"))
    return kept.select("root", text("institution").alias("institution"), text("degree").alias("degree"), text("field_of_study").alias("field_of_study"), year.alias("end_year"), "source", "ord", "pos")


def _firsts(members: DataFrame, mode: str, phone_profile: str) -> DataFrame:
    """(root, and per kind of field, under its name behind a line, a list of (o, key, v, source, g, n, sources)): the first of each distinct value of a group.

    ``o`` is its place; ``g`` the first place of the value without regard to how its source is written, ``n`` the rows
    that have it.  Members are sent to their group once, and all that follows happens where they arrive.
    """
    SINGLE, WITH_SOURCES = ("full_name", "headline", "given"), ("skills", "self")
    text = lambda c: N.blank_to_null(F.col(c))
    entry = lambda kind, key, pos, *v: F.struct(F.lit(kind).alias("kind"), key.alias("key"), pos.alias("pos"), F.array(*v).alias("v"))
    none = F.array().cast("array<struct<kind:string,key:string,pos:int,v:array<string>>>")
    here = lambda there, kind, key, *v: F.when(there, F.array(entry(kind, key, F.lit(0), *v))).otherwise(none)
    single = lambda kind, c: here(N.blank_to_null(c).isNotNull(), kind, F.lower(c), c)
    each = lambda c, make: F.coalesce(F.filter(F.transform(c, make), lambda x: x["key"].isNotNull()), none)
    parts = [text(f"location_{c}") for c in ("city", "region", "country")]

    def skill(x: Column, i: Column) -> Column:
        name = N.skill_name(N.blank_to_null(x))
        return F.get(F.transform(F.array(name), lambda n: entry("skills", F.lower(n), i, n)), F.lit(0))

    every = [
        here(F.lit(True), "self", F.lit("")), single("full_name", F.col("full_name")), single("headline", F.col("headline")), single("given", F.col("total_years_experience").cast("string")),
        here(F.coalesce(*parts).isNotNull(), "location", F.lit(""), *parts), *[here(text(c).isNotNull(), c, F.lit(""), text(c)) for c in ("linkedin", "github")],
        each("emails", lambda x, i: entry("emails", N.mail_key(x), i, x)), each("phones", lambda x, i: entry("phones", N.phone_e164(x, phone_profile), i, x)), each("skills", skill),
        each("experience", lambda e, i: entry("experience", _job_key(e, mode), i, *[e[f] for f in JOB])), each("education", lambda e, i: entry("education", _study_key(e, mode), i, *[e[f] for f in STUDY])),
    ]
    kinds = ["self", *SINGLE, "location", "linkedin", "github", "emails", "phones", "skills", "experience", "education"]
    if phone_profile != "digits":  # provenance follows the digits
        every.append(each("phones", lambda x, i: entry("digits", N.phone_e164(x), i, x)))
        kinds.append("digits")
    used = ["full_name", "headline", "total_years_experience", "location_city", "location_region", "location_country", "linkedin", "github", "emails", "phones", "skills", "experience", "education"]
    sent = members.select("root", "source_name", "ext_id", *used).repartition("root")
    rows = sent.select("root", "source_name", _place().alias("ord"), F.inline(F.concat(*every)))
    place = F.struct(F.col("ord.p").alias("p"), F.when(F.col("kind").isin(*SINGLE), F.col("source_name")).otherwise(F.lit("")).alias("a"), F.col("ord.s").alias("s"), F.col("ord.e").alias("e"), F.col("pos").alias("pos"))
    per = rows.groupBy("root", "kind", "key").agg(
        F.min(F.struct(place.alias("o"), "v", F.col("source_name").alias("source"))).alias("f"), F.min(F.when(F.col("kind").isin(*SINGLE), F.col("ord"))).alias("g"), F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("kind").isin(*WITH_SOURCES), F.col("source_name")))).alias("sources"),
    )
    value = F.struct(F.col("f.o").alias("o"), "key", F.col("f.v").alias("v"), F.col("f.source").alias("source"), "g", "n", "sources", "kind")
    whole = per.groupBy("root").agg(F.collect_list(value).alias("all"))  # a list for each kind would look at every row as often
    return whole.select("root", *[F.filter("all", lambda x: x["kind"] == k).alias(f"_{k}") for k in kinds])  # noqa: B023


def _traced(firsts: DataFrame) -> Column:
    """Which source each field came from, once each, sorted: a list of (field, source)."""
    pair = lambda field, source: F.struct(field.alias("field"), source.alias("source"))
    top = lambda kind, field: F.transform(F.slice(F.array_sort(kind), 1, 1), lambda x: pair(F.lit(field), x["source"]))
    each = lambda kind, field: F.transform(kind, lambda x: pair(F.lit(field), x["source"]))
    named = lambda kind, mark: F.transform(kind, lambda x: pair(F.concat(F.lit(mark), F.coalesce(N.blank_to_null(x["v"][0]), F.lit(""))), x["source"]))
    skill = F.flatten(F.transform("_skills", lambda x: F.transform(x["sources"], lambda s: pair(F.concat(F.lit("skill:"), x["v"][0]), s))))
    return F.array_sort(F.array_distinct(F.concat(
        top("_full_name", "full_name"), top("_headline", "headline"), top("_location", "location"), top("_linkedin", "links.linkedin"), top("_github", "links.github"), each("_emails", "email"),
        each("_digits" if "_digits" in firsts.columns else "_phones", "phone"), skill, named("_experience", "experience:"), named("_education", "education:"),
    )))


def traceable(ext: DataFrame, mode: str = "reference") -> DataFrame:
    """Extractions for ``provenance`` alone: marks for fields of which it asks only whether they are there, no texts of jobs and studies."""
    none, mark = F.lit(None).cast("string"), lambda *cs: F.when(F.coalesce(*[N.blank_to_null(F.col(c)) for c in cs]).isNotNull(), F.lit("x")).alias(cs[0])
    cut = lambda c, fields, used: F.transform(c, lambda e: F.struct(*[(e[f] if f in used else none).alias(f) for f in fields])).alias(c)
    return ext.select(
        "ext_id", "source_name", "emails", "phones", "skills", *map(mark, ("full_name", "headline", "linkedin", "github")), mark("location_city", "location_region", "location_country"), none.alias("location_region"), none.alias("location_country"),
        cut("experience", JOB, ("company", "start_date") if mode == "reference" else ("company", "title", "start_date")), cut("education", STUDY, ("institution",) if mode == "reference" else ("institution", "degree")), F.lit(None).cast("double").alias("total_years_experience"),
    )


def provenance(members: DataFrame, mode: str = "reference") -> DataFrame:
    """(root, field, source): which source each field of a profile came from, once each."""
    firsts = _firsts(members, mode, "digits")
    return firsts.select("root", F.inline(_traced(firsts)))


def fuse(ext: DataFrame, groups: DataFrame, as_of: str, mode: str = "reference", phone_profile: str = "digits") -> DataFrame:
    """Profiles (see schema.PROFILE) with root; candidate_id is a hash of the group's members' least record."""
    from recordloom.operators.schema import PROFILE

    firsts = _firsts(ordered(ext, groups), mode, phone_profile)
    text, zero, oldest = N.blank_to_null, F.lit(0.0), F.lit("0000-00")
    top = lambda kind: F.get(F.array_sort(kind), F.lit(0))
    agree = {"_full_name": lambda head, x: F.levenshtein(head, x) < 3, "_headline": lambda head, x: head == x}  # keys are in lower case

    def adjustment(kind: str) -> Column:
        head = F.array_min(F.transform(kind, lambda x: F.struct(x["g"].alias("g"), x["key"].alias("key"))))["key"]
        same = F.get(F.transform(F.array(head), lambda h: F.forall(kind, lambda x: agree[kind](h, x["key"]))), F.lit(0))
        return F.when(F.aggregate(kind, F.lit(0).cast("long"), lambda n, x: n + x["n"]) <= 1, zero).when(same, F.lit(scoring.AGREE)).otherwise(F.lit(scoring.DISAGREE))

    def place(x: Column) -> Column:
        country = F.coalesce(N.country_iso2(x["v"][2]), x["v"][2])
        return F.when(x.isNotNull(), F.struct(x["v"][0].alias("city"), x["v"][1].alias("region"), country.alias("country")))

    def newest(a: Column, b: Column) -> Column:
        x, y = F.coalesce(a["e"]["start"], oldest), F.coalesce(b["e"]["start"], oldest)
        return F.when(x > y, -1).when(x < y, 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)

    job = lambda v: F.struct(text(v[0]).alias("company"), text(v[1]).alias("title"), N.date_ym(text(v[2])).alias("start"), N.date_ym(text(v[3])).alias("end"), text(v[4]).alias("summary"))
    year = lambda v: F.lit(None).cast("int") if mode == "reference" else N.year_of(text(v[3]))
    study = lambda v: F.struct(text(v[0]).alias("institution"), text(v[1]).alias("degree"), text(v[2]).alias("field"), year(v).alias("end_year"))
    skill = lambda x: F.struct(x["v"][0].alias("name"), scoring.skill_confidence(x["sources"]).alias("confidence"), x["sources"].alias("sources"))
    by_key = F.array_sort(F.transform("_skills", lambda x: F.struct(x["key"].alias("key"), skill(x).alias("s"))))
    out = firsts.select(
        "root", F.size(F.array_distinct(F.transform(F.get("_self", F.lit(0))["sources"], F.lower))).alias("n_sources"), top("_full_name")["v"][0].alias("full_name"), adjustment("_full_name").alias("name_adj"),
        top("_headline")["v"][0].alias("headline"), adjustment("_headline").alias("head_adj"), top("_given")["v"][0].cast("double").alias("given_years"), F.get(F.transform(F.array(top("_location")), place), F.lit(0)).alias("location"),
        F.struct(top("_linkedin")["v"][0].alias("linkedin"), top("_github")["v"][0].alias("github"), F.lit(None).cast("string").alias("portfolio"), F.array().cast("array<string>").alias("other")).alias("links"),
        F.transform(F.array_sort("_emails"), lambda x: text(x["v"][0])).alias("emails"), F.transform(F.array_sort("_phones"), lambda x: x["key"]).alias("phones"), F.transform(by_key, lambda x: x["s"]).alias("skills"),
        F.transform(F.array_sort(F.transform("_experience", lambda x: F.struct(x["o"].alias("o"), job(x["v"]).alias("e"))), newest), lambda x: x["e"]).alias("experience"),
        F.transform(F.array_sort("_education"), lambda x: study(x["v"])).alias("education"), F.transform(_traced(firsts), lambda p: F.struct(p["field"], p["source"], F.lit("merge").alias("method"))).alias("provenance"),
    )
    months = F.filter(F.transform("experience", lambda e: N.months_between_ym(e["start"], F.coalesce(e["end"], F.lit(as_of)))), lambda n: n > 0)  # null without a start
    total = F.get(F.transform(F.array(months), lambda ms: F.when(F.size(ms) > 0, F.bround(F.aggregate(ms, F.lit(0).cast("long"), lambda n, x: n + x) / F.lit(12.0), 1))), F.lit(0))
    has = lambda c: F.size(c) > 0
    there = {"full_name": F.col("full_name").isNotNull(), **{c: has(c) for c in ("emails", "phones", "experience", "skills", "education")}}
    out = out.withColumn("overall_confidence", scoring.overall_confidence(F.col("n_sources"), there, [F.col("name_adj"), F.col("head_adj")]))
    out = out.withColumn("candidate_id", F.sha2(F.col("root").cast("string"), 256)).withColumn("total_years_experience", F.coalesce(total, "given_years"))
    columns = [c.split()[0] for c in PROFILE.replace("\n", " ").split(", ") if "<" not in c.split()[0] and ":" not in c.split()[0]]
    return out.select("root", *[c for c in columns if c in out.columns])


def confidence(ext: DataFrame, groups: DataFrame, mode: str = "reference", phone_profile: str = "digits") -> DataFrame:
    """(root, overall_confidence), as ``fuse`` has it: only names and which fields are there are sent to the groups."""
    some = lambda c, key: F.coalesce(F.exists(c, lambda x: key(x).isNotNull()), F.lit(False))
    low = lambda c: F.when(N.blank_to_null(F.col(c)).isNotNull(), F.lower(c)).alias(c)
    has = {
        "emails": some("emails", lambda x: N.mail_key(x)), "phones": some("phones", lambda x: N.phone_e164(x, phone_profile)), "experience": some("experience", lambda e: _job_key(e, mode)),
        "skills": some("skills", lambda x: N.skill_name(N.blank_to_null(x))), "education": some("education", lambda e: _study_key(e, mode)),
    }
    rows = ordered(ext.select("ext_id", "source_name", low("full_name"), low("headline"), *[c.alias(n) for n, c in has.items()]), groups)
    head = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v"))))["v"].alias(f"{c}_head")
    per = rows.groupBy("root").agg(
        F.size(F.collect_set(F.lower("source_name"))).alias("n_sources"), head("full_name"), F.count("full_name").alias("n_names"), F.collect_set("full_name").alias("names"),
        F.count("headline").alias("n_headlines"), (F.min("headline") == F.max("headline")).alias("one_headline"), *[F.max(n).alias(n) for n in has],
    )
    same_name = F.forall("names", lambda x: F.levenshtein("full_name_head", x) < 3)
    adjustment = lambda n, same: F.when(F.col(n) <= 1, F.lit(0.0)).when(same, F.lit(scoring.AGREE)).otherwise(F.lit(scoring.DISAGREE))
    there = {"full_name": F.col("n_names") > 0, **{n: F.col(n) for n in ("emails", "phones", "experience", "skills", "education")}}
    total = scoring.overall_confidence(F.col("n_sources"), there, [adjustment("n_names", same_name), adjustment("n_headlines", F.col("one_headline"))])
    return per.select("root", total.alias("overall_confidence"))
