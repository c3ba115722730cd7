"""Normalisers, readers, linkage, fusion, scoring, projection, validation and the whole engine."""

import json
import random

import pytest

from pyspark.sql import functions as F
from recordloom.functions import normalize as N
from recordloom.functions import resume
from recordloom.operators import fusion, linkage, projection, report, scoring, validation
from recordloom.plans.engine import Engine, Options, envelope
from recordloom.sources import records


def apply(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (N.phone_e164, {"+1 (555) 010-1000": "+15550101000", "9876543210": "+19876543210", "19876543210": "+19876543210", "919876543210": "+919876543210", "5551234": "+5551234", "12345": None, " ": None, None: None}),
        (lambda c: N.phone_e164(c, "library"), {"5551234": "+15551234", "9876543210123": None}),
        (N.date_ym, {"2020-01-15": "2020-01", "2020/3": "2020-03", "03/2021": "2021-03", "Jan 15, 2020": "2020-01", "15 January 2020": "2020-01", "Sept 2019": "2019-09", "2018": "2018-01", "Present": None, "13/2020": None, "": None, None: None}),
        (N.year_of, {"Graduated: 2018": 2018, "2020-05": 2020, "none": None}),
        (N.skill_name, {"js": "JavaScript", "ci-cd o'reilly 3d": "Ci-Cd O'Reilly 3D", "PySpark": "Apache Spark", "FooBar": "FooBar", "ML": "Machine Learning"}),
        (N.country_iso2, {"us": "US", "USA": "US", "the netherlands": "NL", "Republic of India": "IN", "Deutschland": "DE", "AQ": None, "zz": None, None: None}),
        (N.url_key, {"https://www.LinkedIn.com/in/x//": "linkedin.com/in/x", "www.": "", " http://github.com/y ": "github.com/y", " ": None}),
        (N.mail_key, {" A@X.com ": "a@x.com", "": None}),
    ],
)
def test_normalisers(spark, f, cases):
    assert apply(spark, list(cases), f) == list(cases.values())


TEXT = "RESUME\n=====\nJOSÉ MARÍA\nLinkedIn: linkedin.com/in/jose-x | GitHub\nphone +34-91-555-0123 a@b.com a@b.com\nSKILLS\nPython, SQL; Scikit-learn\n\nEXPERIENCE\nEngineer at Foo  Jan 2020 - Jun 2024\n- did x\n2018 - 2020\nEDUCATION\nUniv X\nBSc in Physics 2018\n\nOther School\nMSc\nPROJECTS\nz"


def test_resume_text(spark):
    r = spark.createDataFrame([(TEXT,)], "t string").select(*[c.alias(n) for n, c in resume.person(F.col("t")).items()]).first()
    assert (r.full_name, r.emails, r.phones, r.linkedin) == ("JOSÉ MARÍA", ["a@b.com"], ["+34-91-555-0123"], "linkedin.com/in/jose-x")
    assert r.headline.startswith("LinkedIn:") and r.skills == ["Python", "SQL", "Scikit", "learn"]
    assert [(e.company, e.title, e.start_date, e.end_date) for e in r.experience] == [("Foo", "Engineer", "Jan 2020", "Jun 2024"), (None, None, "2018", "2020")]
    assert [(e.institution, e.degree, e.field_of_study, e.year) for e in r.education] == [("Univ X", "BSc", "Physics 2018", "2018"), ("Other School", "MSc", None, None)]
    empty = spark.createDataFrame([(None,), ("",)], "t string").select(*[c.alias(n) for n, c in resume.person(F.col("t")).items()]).collect()
    assert all(e.full_name is None and not e.skills for e in empty)


def extraction(spark, rows):
    """rows: (id, source, name, emails, phones, company, title)"""
    from recordloom.operators.schema import conform

    df = spark.createDataFrame(rows, "id bigint, s string, n string, m array<string>, p array<string>, c string, t string")
    return conform(df, ext_id=F.col("id"), source_name=F.col("s"), full_name=F.col("n"), emails=F.col("m"), phones=F.col("p"), company=F.col("c"), title=F.col("t"))


def roots(tokens):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for rec, own in tokens.items():
        find(("r", rec))
        for t in own:
            parent[find(("r", rec))] = find(t)
    groups = {}
    for rec in tokens:
        groups.setdefault(find(("r", rec)), []).append(rec)
    return {rec: min(g) for g in groups.values() for rec in g}


def test_linkage_against_union_find(spark):
    rng = random.Random(3)
    rows, tokens = [], {}
    for i in range(300):
        mails = [f"m{rng.randrange(150)}@x.com" for _ in range(rng.randrange(0, 3))]
        phones = [f"+1555{rng.randrange(200):07d}"] if rng.random() < 0.4 else []
        name, company = f"N{rng.randrange(40)}", f"C{rng.randrange(6)}" if rng.random() < 0.5 else None
        rows.append((i, "csv", name, mails, phones, company, None))
        tokens[i] = {("e", m) for m in mails} | {("p", p) for p in phones} | ({("c", name, company)} if company else set())
    rows += [(1000 + k, "csv", None, [f"chain{k}@x", f"chain{k + 1}@x"], [], None, None) for k in range(120)]
    tokens |= {1000 + k: {f"chain{k}", f"chain{k + 1}"} for k in range(120)}
    got = {r["ext_id"]: r["root"] for r in linkage.link(extraction(spark, rows)).collect()}
    assert got == roots(tokens)


def test_scores(spark):
    conf = lambda *s: spark.range(1).select(scoring.skill_confidence(F.array(*map(F.lit, s)))).first()[0]
    assert [conf("csv"), conf("csv", "ats_json"), conf("csv", "linkedin"), conf("a", "b", "c")] == [0.6, 0.8, 0.8500000000000001, 0.95]
    there = {k: F.lit(True) for k in ("full_name", "emails", "phones", "experience", "skills", "education")}
    one = lambda n, t, adj: spark.range(1).select(scoring.overall_confidence(F.lit(n), t, [F.lit(a) for a in adj])).first()[0]
    assert one(1, there, [0.0]) == 0.72
    assert one(1, there | {"emails": F.lit(False), "phones": F.lit(False), "skills": F.lit(True)}, [0.0]) == 0.63
    assert one(2, there, [-0.10]) == 0.77


def test_fusion_order_and_conflicts(spark):
    rows = [(1, "csv", "Jon Roe", ["B@x.com"], ["5551234567"], "Foo", None), (2, "ats_json", "John Roe", ["a@x.com", "b@X.com"], [], None, None), (3, "linkedin", "Zed Other", [], ["+15551234567"], "foo", None)]
    m = fusion.ordered(extraction(spark, rows), spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "ext_id bigint, root bigint"))
    name = fusion.resolve(m, "full_name", True).first()
    assert (name["value"], name["source"], name["adjustment"]) == ("Zed Other", "linkedin", -0.10)
    assert fusion.resolve(m, "company").first()["adjustment"] == 0.05
    assert fusion._in_order(fusion.emails(m), "v").first()["v"] == ["a@x.com", "b@X.com"]
    assert fusion._in_order(fusion.phones(m), "v").first()["v"] == ["+15551234567"]


@pytest.fixture(scope="module")
def profiles(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "people.csv").write_text('﻿Name,Email,Phone,Current Company,Skills,Location\n"Ann Lee","a@x.com; A@x.com",5551234567,Foo,"Python, js|React","Austin, TX, USA"\n,,,,,\nBob Ray,b@x.com,,Bar,SQL,"Pune, India"\n')
    (d / "ats.json").write_text(json.dumps({"candidates": [{"Applicant_Name": "Ann Lee", "emails": ["a@x.com"], "tech_stack": "python;Go", "experience": [{"employer": "Foo", "job_title": "Dev", "from": "2020-01", "to": "2024-01"}, {"employer": "Old", "from": "2018-01", "to": "2020-01"}], "education": [{"school": "Uni", "degree": "BSc", "year": 2017}]}, "skip", {"name": "Cy Dee", "skills": [None, {"name": "Rust"}]}]}))
    (d / "copy.json").write_bytes((d / "ats.json").read_bytes())
    (d / "bad.json").write_text("{oops")
    (d / "cv.txt").write_text(TEXT)
    (d / "empty.csv").write_text("")
    names = ["people.csv", "ats.json", "copy.json", "bad.json", "cv.txt", "empty.csv", "gone.csv"]
    return Engine(spark, Options(as_of="2024-06")).run([str(d / n) for n in names])


def test_engine_end_to_end(spark, profiles):
    rows = {r["full_name"]: r for r in profiles.profiles.collect()}
    assert set(rows) == {"Ann Lee", "Bob Ray", "Cy Dee", "JOSÉ MARÍA"}
    ann = rows["Ann Lee"]
    assert ann["emails"] == ["a@x.com"] and ann["phones"] == ["+15551234567"] and ann["location"]["country"] == "US"
    assert [s["name"] for s in ann["skills"]] == ["Go", "JavaScript", "Python", "React"] and ann["total_years_experience"] == 6.0
    assert [e["company"] for e in ann["experience"]] == ["Foo", "Old"] and ann["overall_confidence"] == 0.92
    assert rows["Cy Dee"]["skills"][0]["name"] == "Rust"
    notes = " ".join(r["message"] for r in profiles.warnings.collect())
    assert "not valid JSON" in notes and "file not found" in notes and "file is empty" in notes
    doc = json.loads(envelope(profiles))
    assert len(doc["candidates"]) == 4 and doc["metadata"]["source_count"] == 3


def test_projection(spark, profiles):
    p = profiles.profiles
    config = {"fields": [{"path": "full_name", "required": True}, {"from": "emails[0]", "path": "primary_email", "required": True}, {"path": "skills[].name"}, {"path": "location.country"}, {"path": "a.b"}, {"from": "phones[7]", "path": "far"}], "include_confidence": True, "missing_value": "error"}
    rows = {r["full_name"]: r for r in projection.project(p, config).collect()}
    assert set(rows) == {"Ann Lee", "Bob Ray", "JOSÉ MARÍA"} and rows["Ann Lee"]["name"] == ["Go", "JavaScript", "Python", "React"]
    assert rows["Ann Lee"]["far"] is None and rows["Ann Lee"]["b"] is None and rows["Ann Lee"]["country"] == "US"
    assert [r["missing"] for r in projection.rejects(p, config).collect()] == [["primary_email"]]
    omitted = json.loads(projection.to_json(p.where("full_name = 'Ann Lee'"), {**config, "missing_value": "omit"}).first()["json"])
    assert "far" not in omitted and "b" not in omitted
    assert projection.check_output(projection.project(p, config), {"fields": [{"path": "full_name", "type": "array"}]}) == {"full_name": "expected array, got string"}
    for bad in ({}, {"fields": [{}]}, {"fields": [], "missing_value": "x"}):
        with pytest.raises(ValueError):
            projection.check_config(bad)


def test_validation_and_reports(spark, profiles):
    bad = profiles.profiles.withColumn("phones", F.array(F.lit("123"), F.lit(None).cast("string")))
    assert all('phones[0] "123"' in r["errors"][0] for r in validation.validate(bad).collect())
    assert report.summary(profiles.profiles).where("full_name = 'Ann Lee'").first()["sources"] == "ats_json, csv"
    assert report.cards(profiles.profiles).where("full_name = 'Ann Lee'").first()["band"] == "high"


def test_same_result_for_any_partitioning(spark, tmp_path):
    rows = [(i, "csv" if i % 2 else "ats_json", f"Name {i // 3}", [f"m{i // 3}@x.com"], [], f"F{i % 2}", None) for i in range(60)]
    ext = extraction(spark, rows)
    seen = set()
    for n in (1, 7, 23):
        part = ext.repartition(n)
        p = fusion.fuse(part, linkage.link(part), "2024-01")
        seen.add(tuple(sorted(r[0] for r in p.select(F.to_json(F.struct(*p.columns))).collect())))
    assert len(seen) == 1


def test_streaming_extraction(spark, tmp_path):
    from recordloom.streaming import ingest

    spark.createDataFrame([(1, '{"name":"Ann","email":"a@x.com"}'), (2, "broken")], "rec_id bigint, payload string").write.parquet(str(tmp_path / "in"))
    ingest.to_table(ingest.json_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("full_name = 'Ann'").count() == 1 and got.count() == 2


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert {"p1_found", "p2_found", "p7_found", "fuse_profiles"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rows_in_any_naming(spark):
    df = spark.createDataFrame([(1, "Ann", None, "x@y.z, q@y.z"), (2, " ", None, "")], "id int, `First Name` string, surname string, `E-Mail` string")
    rows = records.from_rows(df, "id").collect()
    assert len(rows) == 1 and rows[0]["full_name"] == "Ann" and rows[0]["emails"] == ["x@y.z", "q@y.z"]


@pytest.fixture(scope="module")
def odd_files(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    (d / "latin one.csv").write_bytes("name,email\nJosé Peña,jose@x.com\n".encode("latin-1"))
    (d / "a.csv").write_text("name,email\nAnn Lee,\n")
    (d / "b.csv").write_text("﻿name,email\nBo Roe,bo@x.com\n")
    (d / "same.csv").write_text("name,email\nAnn Lee,\n")
    (d / "lines.csv").write_text('name,title,email\n"Cy\nDee","Dev, ""senior""",cy@x.com\n')
    (d / "no.pdf").write_bytes(b"not a pdf")
    (d / "bad.json").write_bytes(b'[{"name": "\xff"}]')
    return [str(d / n) for n in ("latin one.csv", "a.csv", "b.csv", "same.csv", "lines.csv", "no.pdf", "bad.json")]


@pytest.fixture(scope="module")
def odd_run(spark, odd_files):
    return Engine(spark, Options(as_of="2024-06")).run(odd_files)


@pytest.mark.parametrize("policy", ["null", "omit", "error"])
def test_sinks_follow_the_policy(spark, odd_run, tmp_path, policy):
    from recordloom.plans.engine import under, write_json

    config = {"fields": [{"path": "full_name", "required": True}, {"from": "emails[0]", "path": "email", "required": True}, {"path": "location"}], "missing_value": policy}
    result = under(odd_run, config)
    write_json(result, str(tmp_path / policy))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / policy / "candidates")).collect()]
    one = json.loads(envelope(result))
    key = lambda d: d["full_name"]
    assert sorted(lines, key=key) == sorted(one["candidates"], key=key)
    ann = [d for d in lines if d["full_name"] == "Ann Lee"]
    want = {"null": [{"full_name": "Ann Lee", "email": None, "location": None}], "omit": [{"full_name": "Ann Lee"}], "error": []}
    assert ann == want[policy]
    assert {d["full_name"] for d in lines} >= {"José Peña", "Bo Roe"} and any("Cy" in d["full_name"] for d in lines)
    meta = json.loads(spark.read.text(str(tmp_path / policy / "metadata")).first()["value"])
    assert meta["candidate_count"] == len(lines) == 4 - (policy == "error") and meta["given_count"] == 7 and meta["source_count"] == 4
    said = " ".join(one["metadata"]["warnings"])
    assert ("required field email is missing" in said) == (policy == "error")
    assert "PDF cannot be opened" in said and "not valid UTF-8" in said
    assert meta["warning_count"] == len(one["metadata"]["warnings"])
    with pytest.raises(ValueError):
        envelope(result, most=1)


def test_readers_can_be_added(spark, odd_files, monkeypatch):
    from recordloom.sources import files, readers

    monkeypatch.setattr(readers, "READERS", {"csv": lambda s, f, o: readers.delimited(s, f.where("file_ord = 1"), o)})
    usable = files.usable(files.scan(spark, odd_files[:3]))
    assert [r["full_name"] for r in Engine(spark, Options()).extract(usable).collect()] == ["Ann Lee"]


def test_projected_rows_are_checked(spark):
    df = spark.createDataFrame([("a", None), (None, "x")], "full_name string, email string")
    config = {"fields": [{"path": "full_name", "required": True}, {"path": "email"}, {"path": "gone", "required": True}]}
    assert [r["errors"] for r in projection.check_required(df, config).collect()] == [["required field gone is missing"], ["required field full_name is null", "required field gone is missing"]]


def test_command_line(spark, odd_files, tmp_path, capsys):
    from recordloom.__main__ import main

    assert main(["--schema"]) == 0 and '"full_name"' in capsys.readouterr().out
    assert main(["-s", odd_files[2], "-o", str(tmp_path / "x" / "r.json"), "--as-of", "2024-01", "--master", spark.sparkContext.master]) == 0
    assert [c["full_name"] for c in json.loads((tmp_path / "x" / "r.json").read_text())["candidates"]] == ["Bo Roe"]
