"""The rounds in Spark and inside one task give the same groups."""

import random

import pytest

from recordloom.llm import components


@pytest.mark.parametrize("few", [0, 40])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_rounds_agree_wherever_they_run(spark, few, kind):
    rng = random.Random(5)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(55)] + [(200 + k, 201 + k) for k in range(40)] + [(400, 500 + k) for k in range(60)] + [(7, 7)]
    as_ = str if kind == "string" else int
    df = spark.createDataFrame([*((as_(a), as_(b)) for a, b in pairs), (None, as_(1))], f"u {kind}, v {kind}")
    rows = lambda n: sorted(tuple(r) for r in components.groups(df, n).collect())
    assert rows(few) == rows(10**6)
