"""Packed cells: hand-made cases, hard cells, clashing columns, empty tables."""

import pytest

from pyspark.sql import functions as F
from recordloom.operators import packed

CASES = [
    ("SQL; Cypress; Neo4j", ["SQL", "Cypress", "Neo4j"]),
    ('"Ran ""Lean"" rollouts"; qa', ['Ran "Lean" rollouts', "qa"]),
    ("['gRPC', 'Quality Assurance']", ["gRPC", "Quality Assurance"]),
    ("Office (Word; Excel); mongo db", ["Office (Word; Excel)", "mongo db"]),
    ('"Cloud (GCP | Azure)" ;\'num py\' ;"Rust"', ["Cloud (GCP | Azure)", "num py", "Rust"]),
    ("CI/CD / TCP/IP", ["CI/CD", "TCP/IP"]),
    ("a - b", ["a - b"]),
    ('"unclosed, a', ['"unclosed', "a"]),
    ("it's 6\" y, 5\" x", ["it's 6\" y", '5" x']),
    (", ,", []),
    ("", []),
    (None, []),
    ("Redis, Redis", ["Redis", "Redis"]),
    ("Go\tRust\nC、D • E", ["Go", "Rust", "C", "D", "E"]),
]


@pytest.mark.parametrize(("cell", "expected"), CASES)
def test_values(spark, cell, expected):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(packed.values(F.col("c"))).first()[0] == expected


def test_hyphen_only_in_places(spark):
    df = spark.createDataFrame([("'L'Aquila', \"x, y\" - Aix-en-Provence",)], "c string")
    assert df.select(packed.values(F.col("c"), True)).first()[0] == ["L'Aquila", "x, y", "Aix-en-Provence"]


def test_long_cells(spark):
    df = spark.createDataFrame([("x" * 100_000 + ',"' + "y," * 50_000 + '",' + "(" * 5000,)], "c string")
    got = df.select(packed.values(F.col("c"))).first()[0]
    assert [len(v) for v in got] == [100_000, 99_999 + 1, 5000] or len(got) == 3


def test_unpack_positions_and_clashes(spark):
    df = spark.createDataFrame([(1, "a, b", "vals", 9), (2, "only", None, 9), (3, None, "x", 9)], "ext_id bigint, skills string, vals string, pos int")
    rows = [tuple(r) for r in packed.unpack(df, "ext_id", {"skills": False}, "t", at_least=2).orderBy("pos").collect()]
    assert rows == [("t", 1, "skills", 1, "a"), ("t", 1, "skills", 2, "b")]
    assert packed.unpack(df.limit(0), "ext_id", {"skills": False}, "t").count() == 0


def test_control_characters_stay_and_many_quotes_are_linear(spark):
    odd = "a\u0001b,\"c\u0002,\u0003d\",\u0004e,\u0004c"
    many = ",".join(f'"v{i}, w"' for i in range(20_000))
    df = spark.createDataFrame([(1, odd), (2, many)], "i int, c string")
    got = {r["i"]: r["v"] for r in df.select("i", packed.values(F.col("c")).alias("v")).collect()}
    assert got[1] == ["a\u0001b", "c\u0002,\u0003d", "\u0004e", "\u0004c"]
    assert len(got[2]) == 20_000 and got[2][-1] == "v19999, w"
