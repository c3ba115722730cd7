"""Pairwise matches consolidated into groups by randomized contraction.

Every round orders the vertices by a fresh hash; each vertex hooks to the smallest vertex of its closed
neighbourhood, edges are relabelled and deduplicated, loops vanish.  The graph shrinks by a constant factor in
expectation whatever its shape (chains, stars, cliques), so the rounds are logarithmic.  The rounds' mappings
are then expanded back to front.  Each round is cut off with checkpoint(); nothing is collected.  What is left when
the edges are counted to be few is contracted by the same rounds inside one task.

Records that share a token (mailbox, profile) become a star around the token's smallest record, so a token held
by a third of all rows gives as many edges as it has rows; tokens are counted map-side before any shuffle.

Defined results: null ids link nothing, self pairs and repeats change nothing, records without a partner are in
no group, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.runtime import checkpoint

#: Edges (both ways) that one task may contract.
FEW = 200_000


def _fresh_order(n: int, turn: int) -> np.ndarray:
    """A place for each of ``n`` vertices, another one in every round (a 64-bit mix of their numbers)."""
    x = np.arange(n, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    place = np.empty(n, np.int64)
    place[np.argsort(x ^ (x >> np.uint64(31)), kind="stable")] = np.arange(n)
    return place


def _contract_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rounds over edges that fit one task: hook, relabel, deduplicate, and expand."""
    edges = [(u, v) for b in batches for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    names = sorted({x for e in edges for x in e})
    number = {x: k for k, x in enumerate(names)}
    u, v = (np.array([number[e[k]] for e in edges], np.int64) for k in (0, 1))
    rep, turn = np.arange(len(names)), 0
    while len(u):
        turn += 1
        place = _fresh_order(len(names), turn)
        best = place.copy()
        np.minimum.at(best, u, place[v])
        hook = np.argsort(place)[best]
        rep, u, v = hook[rep], hook[u], hook[v]
        pairs = np.unique(np.stack([u, v], 1)[u != v], axis=0)
        u, v = pairs[:, 0], pairs[:, 1]
    kind = pa.string() if names and isinstance(names[0], str) else pa.int64()
    yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([names[r] for r in rep], kind)], names=["u", "r"])


def contract(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(v, rep) for every vertex of ``edges`` (u, v); equal rep exactly for connected vertices."""
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    live = edges.where("u is not null and v is not null and u <> v").select(both.alias("e")).select("e.u", "e.v").distinct()
    live = checkpoint(live)
    maps: list[DataFrame] = []
    while (left_over := live.count()) > few:
        rank = lambda c: F.struct(F.xxhash64(F.lit(7919 * (len(maps) + 1)), c).alias("h"), c.alias("x"))  # noqa: E731, B023
        hook = live.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m")).select("u", F.least(F.col("m"), rank(F.col("u")))["x"].alias("r"))
        hook = checkpoint(hook)
        maps.append(hook)
        left = live.join(hook, "u").select(F.col("r").alias("a"), "v")
        live = left.join(hook.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("r").alias("v")).where("u <> v").distinct()
        live = checkpoint(live)
    if left_over:
        kind = live.schema["u"].dataType.simpleString()
        kind = kind if kind == "string" else "bigint"
        both = live.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"))
        maps.append(checkpoint(both.coalesce(1).mapInArrow(_contract_here, f"u {kind}, r {kind}")))
    if not maps:
        return live.select("v", F.col("u").alias("rep"))
    done = maps[0].select(F.col("u").alias("v"), F.col("r").alias("rep"))
    for later in maps[1:]:
        done = done.join(later.select(F.col("u").alias("rep"), "r"), "rep", "left").select("v", F.coalesce("r", "rep").alias("rep"))
    return done


def groups(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(v, group_key): the smallest vertex of each vertex's group."""
    found = checkpoint(contract(edges, few))
    least = found.groupBy("rep").agg(F.min("v").alias("group_key"))
    return found.join(least, "rep").select("v", "group_key")


def shared_token_edges(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(u, v): each record tied to the smallest record that has a token in common with it."""
    long = df.select(F.col(f"`{key}`").alias("u"), F.explode(tokens).alias("t")).where("t is not null and u is not null")
    shared = long.groupBy("t").agg(F.min("u").alias("v"), F.max("u").alias("last")).where("v <> last").select("t", "v")
    return long.join(shared, "t").where("u <> v").select("u", "v")


def pair_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    """(u, v) of a table of decided pairs; ids compared without case and outer space."""
    clean = lambda c: F.nullif(F.lower(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"(?U)^\s+|\s+$", "")), F.lit(""))
    return df.select(clean(left).alias("u"), clean(right).alias("v"))
