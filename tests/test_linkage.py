"""The groups of linked records do not depend on where the rounds run, and the rounds leave nothing behind in the plan."""

import random

import pytest

from recordloom.operators import linkage


def groups_of(pairs):
    root = {x: x for p in pairs for x in p}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("few", [0, 60, 10**6])
def test_long_chains_and_stars_in_few_rounds(spark, few, monkeypatch):
    ids = random.Random(3).sample(range(1000), 300)
    pairs = [*zip(ids, ids[1:]), *((2000, 3000 + k) for k in range(40)), (5001, 5000), (5001, 5000), (5000, 5001)]
    kept = []
    monkeypatch.setattr(linkage, "checkpoint", lambda df, real=linkage.checkpoint, **how: kept.append(real(df, **how)) or kept[-1])
    found = linkage.components(spark.createDataFrame([*pairs, (7, 7)], "u bigint, v bigint"), few)
    assert {tuple(r) for r in found.collect()} == groups_of(pairs)
    assert len(kept) < 50
    # joins multiply estimated sizes: over rounds that keep them they grow to numbers that fill the driver
    sizes = [df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for df in [*kept, found]]
    assert max(int(x).bit_length() for x in sizes) < 1000


def test_each_token_is_sent_once(spark):
    rows = [(1, "m", "a"), (2, "m", "a"), (3, "m", "a"), (3, "m", "a"), (3, "p", "b"), (4, "p", "b"), (5, "p", "c"), (None, "p", "b")]
    found = linkage.edges(spark.createDataFrame(rows, "ext_id bigint, kind string, key string"))
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1), (4, 3)]
    # both sides of a join would send every token, and keep a copy on disk for the second
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
