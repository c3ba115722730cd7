"""The registered queries of profiles over small tables of people."""

import pytest

from recordloom.plans import profile_queries as Q
from recordloom.runtime import checkpoint

FLAT = "ext_id bigint, source_file string, name string, email string, phone string, {c} string, title string, location string, skills string, linkedin string"
EXP = "experience array<struct<company:string,title:string,start_date:string,end_date:string,summary:string>>"
EDU = "education array<struct<institution:string,degree:string,field_of_study:string,end_year:int>>"


def write(spark, d, candidates, people, notes):
    """candidates: (id, name, email, phone, company, title, location, skills, linkedin); people also github, experience, education; notes also github."""
    row = lambda r: (r[0], "f", *r[1:])
    spark.createDataFrame([row(r) for r in candidates], FLAT.format(c="current_company")).write.parquet(f"{d}/candidates.parquet")
    spark.createDataFrame([(*row(r), None) for r in people], FLAT.format(c="company") + f", github string, {EXP}, {EDU}, total_years_experience int").write.parquet(f"{d}/student1_english.parquet")
    spark.createDataFrame([row(r) for r in notes], FLAT.format(c="current_company") + ", github string").write.parquet(f"{d}/edge_case_structured.parquet")
    return str(d)


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    job, school = [("Foo", "Dev", "2020-01", "2024-01", None)], [("Uni", "BSc", "Physics", 2017)]
    return write(
        spark,
        tmp_path_factory.mktemp("people"),
        [(1, "Ann Lee", "ann@x.org", None, "Foo", None, "Oslo", "SQL", None), (2, "Lone Wolf", None, "5551234567", None, None, None, None, "n/a"), (3, "Zoë Straße", "zoe@x.org", None, None, None, None, None, "linkedin.com/in/zoe")],
        [(11, "Ann Lee", "ann@x.org", None, "Foo", "Dev", "Oslo", "Go", None, "github.com/ann", job, school), (13, "Zoé Strasse", None, None, None, None, None, None, "linkedin.com/in/zoe", None, [], [])],
        [(22, "Lone Wolf", None, "+1 555 123 4567", None, None, None, None, None, None)],
    )


@pytest.fixture(scope="module")
def grouped(spark, people):
    return checkpoint(Q.members(spark, people))


def test_every_record_is_fused_in_the_engines_groups(spark, people, grouped, monkeypatch):
    assert {(r["root"], r["ext_id"]) for r in grouped.collect()} == {(1, 1), (1, 11), (2, 2), (2, 22), (3, 3), (3, 13)}
    monkeypatch.setattr(Q, "members", lambda *_: grouped)
    rows = lambda name: {tuple(r) for r in Q.QUERIES[name](spark, people).collect()}
    assert rows("merge_priority") == {(1, "Foo", "ats_json", 0.05)}
    assert rows("merged_phones") == {(2, "+15551234567")}
    assert rows("education_first") == {(1, "Uni", "BSc", "Physics")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_accented_names_and_all_provenance_stay(spark, people, grouped, monkeypatch):
    monkeypatch.setattr(Q, "members", lambda *_: grouped)
    monkeypatch.setattr(Q.linkage, "link", lambda *_, **__: grouped.select("ext_id", "root"))
    names = {}
    for r in sorted(grouped.collect(), key=lambda r: tuple(r["ord"])):
        names.setdefault(r["root"], []).append((r["full_name"], r["source_name"]))
    agree = {root: all(distance(own[0][0].lower(), n.lower()) < 3 for n, _ in own) for root, own in names.items()}
    assert agree == {1: True, 2: True, 3: False}  # with the accents cut off the last would agree too
    assert {tuple(r) for r in Q.name_agreement(spark, people).collect()} == {(root, *own[0], 0.05 if agree[root] else -0.10) for root, own in names.items()}
    found = {tuple(r) for r in Q.provenance_distinct(spark, people).collect()}
    assert {f for f in found if f[0] == 1} >= {(1, "full_name", "ats_json"), (1, "experience:Foo", "ats_json"), (1, "education:Uni", "ats_json"), (1, "skill:SQL", "csv"), (1, "email", "ats_json")}
    assert (3, "full_name", "ats_json") in found
    # base, two sources, name and mail there, names differ, two sources with a name
    assert {r["root"]: r["overall_confidence"] for r in Q.overall_confidence(spark, people).collect()}[3] == pytest.approx(0.5 + 0.2 + 0.04 - 0.10 + 0.05)


def test_members_are_sent_to_their_group_once(spark, people, grouped):
    ext = Q.extractions(spark, people)
    m, p = Q.fusion.ordered(ext, grouped.select("ext_id", "root")), Q.fusion.fuse(ext, grouped.select("ext_id", "root"), Q.AS_OF)
    p.collect()
    plan = p._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # one exchange for each side of the join with the groups and one to the groups; joins of the fields would add theirs
    assert plan.count("Exchange ") <= 3 and plan.count("Join") == 1
    got = {r["root"]: r for r in p.collect()}
    for f, one in (("emails", Q.fusion._in_order(Q.fusion.emails(m), "emails")), ("phones", Q.fusion._in_order(Q.fusion.phones(m), "phones")), ("location", Q.fusion.locations(m))):
        assert {root: r[f] for root, r in got.items() if r[f]} == {r["root"]: r[f] for r in one.collect()}
    jobs = {(r["root"], r["company"], r["title"], r["start"], r["end"]) for r in Q.fusion.experience(m).collect()}
    assert {(root, *list(e)[:4]) for root, r in got.items() for e in r["experience"]} == jobs
    assert {r["root"]: r["total_years_experience"] for r in Q.fusion.years(Q.fusion.experience(m), Q.AS_OF).collect()} == {root: r["total_years_experience"] for root, r in got.items() if r["total_years_experience"]}
    assert {(r["root"], r["name"], r["confidence"]) for r in Q.fusion.skills(m).collect()} == {(root, s["name"], s["confidence"]) for root, r in got.items() for s in r["skills"]}


def test_skills_are_named_once(spark, people, grouped):
    plan = Q.fusion.skills(grouped)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<!") == 1  # the mark of title_case; a filter on what it gives would work it out again


def test_confidence_sends_names_and_not_lists(spark, people, grouped, monkeypatch):
    monkeypatch.setattr(Q.linkage, "link", lambda *_, **__: grouped.select("ext_id", "root"))
    found = Q.overall_confidence(spark, people)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RepartitionByExpression" not in plan and plan.count("Join") == 1
    ext = Q.extractions(spark, people)
    odd = ext.selectExpr("* except (full_name, headline, emails, skills, phones, experience, education)", "case ext_id % 4 when 0 then '  ' when 1 then full_name when 2 then upper(full_name) end as full_name",
        "case when ext_id < 3 then 'Dev' when ext_id < 13 then 'dev' when ext_id < 20 then ' ' end as headline", "array(null, '') as emails", "if(ext_id = 2, array(' '), skills) as skills", "if(ext_id = 3, array('x'), phones) as phones",
        "if(ext_id = 2, null, experience) as experience", "if(ext_id = 3, array(null), education) as education")
    for e in (ext, odd.select(*ext.columns)):
        for how in ({}, {"mode": "full", "phone_profile": "library"}):
            whole = Q.fusion.fuse(e, grouped.select("ext_id", "root"), Q.AS_OF, **how).select("root", "overall_confidence")
            assert {tuple(r) for r in Q.fusion.confidence(e, grouped.select("ext_id", "root"), **how).collect()} == {tuple(r) for r in whole.collect()}


def test_provenance_sends_no_texts_of_jobs(spark, people, grouped, monkeypatch):
    monkeypatch.setattr(Q.linkage, "link", lambda *_, **__: grouped.select("ext_id", "root"))
    found = Q.provenance_distinct(spark, people)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # one list for a group, and not one for each kind
    ext, groups = Q.extractions(spark, people), grouped.select("ext_id", "root")
    odd = ext.selectExpr("* except (full_name, location_city, location_region, experience, education)", "if(ext_id = 13, ' ', full_name) as full_name", "if(ext_id = 1, ' ', location_city) as location_city", "if(ext_id = 3, 'Ost', null) as location_region",
        "if(ext_id = 3, array(null), if(ext_id = 22, null, experience)) as experience", "if(ext_id = 13, array(null), education) as education").select(*ext.columns)
    for e in (ext, odd):
        for mode in ("reference", "full"):
            slim = Q.fusion.provenance(Q.fusion.ordered(Q.fusion.traceable(e, mode), groups), mode)
            assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, Q.fusion.provenance(Q.fusion.ordered(e, groups), mode).collect()))
    kept = Q.fusion.traceable(ext).where("ext_id = 11").first()
    assert [(j["company"], j["start_date"], j["summary"], j["title"]) for j in kept["experience"]] == [("Foo", "2020-01", None, None)] and kept["full_name"] == "x"
