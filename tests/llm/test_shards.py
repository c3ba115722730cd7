"""Shards of a reference list give what one list gives."""

import pytest

from recordloom.llm import canon

CANON = "canon_id int, kind string, label string, aliases array<string>, region_name string, country string"
ENTRIES = [
    (1, "skill", "Planning", None, None, None), (2, "skill", "Plannong", None, None, None), (3, "skill", "JavaScript", ["js"], None, None), (4, "skill", "Java", None, None, None), (5, "skill", "Data Modelling", [None, "modelling"], None, None), (6, "skill", "Data Modeling", None, None, None),
    (11, "location", "Cordoba, Spain", ["Córdoba, Spain"], "Andalusia", "Spain"), (12, "location", "Cordoba, Argentina", None, "Cordoba Province", "Argentina"), (13, "location", "Munich, Germany", ["München, Germany"], "Bavaria", "Germany"), (14, "location", "Granada, Spain", None, "Andalusia", "Spain"), (15, "location", "Bavaria City, Mexico", None, "Granada", "Mexico"),
]
ASKED = {
    "skill": ["planning", "Plannang", "plannxng", "js", "JavaScript (5 yrs)", "good modelling", "Data Modelin", "data modelng - advanced", "n/a", "?", "x" * 3000],
    "location": ["Cordoba", "Cordoba, Spain", "cordoba (AR)", "Munihc, Bavaria", "Munich, France", "Granada", "Granada, Andalusia", "Bavaria", "Spain", "Munich / Cordoba", "Cordboa, Argentina", "Remote", ",", "Bavaria City"],
    "title": ["Clerk"],
}


@pytest.mark.parametrize("shard", [1, 3])
def test_shards_agree_with_one_list(spark, shard):
    values = spark.createDataFrame([(k, v, n) for k, own in ASKED.items() for n, v in enumerate(own + own[:2])], "kind string, val string, part int")
    entries = spark.createDataFrame(ENTRIES, CANON)
    rows = lambda df: sorted((r["kind"], r["val"], r["part"], r["canon_id"], r["far"]) for r in df.collect())
    whole = rows(canon.match(values, entries))
    assert rows(canon.match(values, entries, shard)) == whole
    meant = {(k, v): c for k, v, _, c, _ in whole}
    assert meant["skill", "Plannang"] == 0 and meant["location", "Cordoba"] == 0 and meant["location", "Cordoba, Spain"] == 11
