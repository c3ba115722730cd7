"""Changes between the files of a feed, on a feed made by hand."""

import json

from pyspark.sql import functions as F
from recordloom.operators import drift

PEOPLE = ["Ann Lee", "Bob Ray", "Cy Dee", "Di Fox"]


def feed():
    rows = []
    for i, name in enumerate(PEOPLE):
        who = f"A{i}"
        rows += [
            (1, 1, who, {"name": name, "age": 30 + i, "experience": [{"company": f"Firm {i}"}]}),
            (1, 2, who, {"name": name, "age": str(30 + i), "flag": True, "experience": [{"company": f"Firm {i}"}]}),
            (1, 4, who, {"person": {"given": name.split()[0], "family": name.split()[1]}, "age": str(30 + i), "experience": [{"employer": {"label": f"Firm {i}", "city": "X"}}]}),
        ]
    rows.append((2, 1, "B", {"x": None}))
    out = [(n, f, k, w, json.dumps(d)) for n, (f, k, w, d) in enumerate(rows)]
    return [*out, (98, 1, 4, "A9", "not json"), (99, 1, 4, None, None), (100, 1, 4, "A8", "[1]")]


SCHEMA = "rec_id bigint, feed_id bigint, file_no int, applicant_ref string, payload string"


def test_changes(spark):
    df = spark.createDataFrame(feed(), SCHEMA)
    got = {tuple(r) for r in drift.changes(df).collect()}
    assert got == {
        (1, 2, "retyped", "age", "age"),
        (1, 2, "added", "", "flag"),
        (1, 4, "removed", "flag", ""),
        (1, 4, "renamed", "name", "person"),
        (1, 4, "renamed", "experience.company", "experience.employer"),
    }
    assert drift.changes(df.limit(0)).count() == 0


def test_unified_names(spark):
    df = spark.createDataFrame(feed(), SCHEMA)
    rows = {r["rec_id"]: r for r in drift.unify(df).collect()}
    last = rows[2]
    assert last["fields"]["name"] in ("Lee Ann", "Ann Lee") and last["fields"]["age"] == "30"
    assert list(last["experience"][0]) == ["company"]


def test_a_name_that_comes_back_is_told_apart(spark):
    rows = []
    for i, name in enumerate(PEOPLE):
        who = f"A{i}"
        rows += [(1, 1, who, {"a": name}), (1, 2, who, {"b": name}), (1, 3, who, {"b": name, "a": i * 7}), (1, 4, who, {"b": name, "c": i * 7})]
    df = spark.createDataFrame([(n, f, k, w, json.dumps(d)) for n, (f, k, w, d) in enumerate(rows)], SCHEMA)
    got = {tuple(r) for r in drift.changes(df).collect()}
    assert got == {(1, 2, "renamed", "a", "b"), (1, 3, "added", "", "a"), (1, 4, "renamed", "a", "c")}
    last = {r["rec_id"]: dict(r["fields"]) for r in drift.unify(df).collect()}
    assert last[1] == {"a": PEOPLE[0]} and last[2] == {"a": PEOPLE[0], "a#3": "0"} and last[3] == {"a": PEOPLE[0], "a#3": "0"}


def test_every_record_has_a_row(spark):
    odd = [(100, 1, 1, "A0", "{}"), (101, None, 1, "A0", '{"x": 1}'), (102, 1, None, "A0", '{"x": true}'), (103, 1, 1, "A0", None), (104, 1, 1, None, '{"x": [1, {"y": null}]}'), (105, 1, 2, "A0", '{"k\\ud800": "v\\ud800", "experience": [{}, 3, {"t": "%s"}]}' % ("é" * 50_000))]
    df = spark.createDataFrame(odd, SCHEMA).withColumn("want", F.lit(1)).withColumn("alias", F.lit(2))
    rows = {r["rec_id"]: r for r in drift.unify(df).collect()}
    assert set(rows) == set(range(100, 106))
    assert dict(rows[101]["fields"]) == {"x": "1"} and dict(rows[104]["fields"]) == {"x": '[1,{"y":null}]'} and dict(rows[100]["fields"]) == {}
    assert dict(rows[105]["fields"]) == {"k?": "v?"} and len(rows[105]["experience"]) == 2


def test_casts_follow_the_first_type():
    assert [drift.cast(v, "number") for v in ("5", " 7.5 ", "x", [1], None)] == ["5", "7.5", None, None, None]
    assert [drift.cast(v, "boolean") for v in ("Yes", "0", 1, "x")] == ["true", "false", "true", None]
    assert [drift.cast(v, "string") for v in ({"a": "x", "b": ["y", 2]}, 3, True)] == ["x y 2", "3", "true"]


def test_small_and_large_catalogues_agree(spark, monkeypatch):
    df = spark.createDataFrame([*feed(), *[(n, 1, f, "n/a", json.dumps({"name" if f < 4 else "person": f"N{n}"})) for n, f in ((200 + k, 1 + k % 4) for k in range(300))]], SCHEMA)
    small = {tuple(r) for r in drift.changes(df).collect()}
    monkeypatch.setattr(drift, "SMALL", 0)
    assert {tuple(r) for r in drift.changes(df).collect()} == small
