"""Values fused by how far their sources can be trusted, with votes of copying sources discounted.

Each source's accuracy and each pair's dependence are estimated together with the values' probabilities: sources
that share values which turn out false are likely to copy, and a copied vote counts little.  The value with the
largest posterior stands for its object.

Scale: what an object says is its pattern: which sets of sources bear its values, and how many values each set bears.
Objects are counted by pattern, map-side first, and every round of the estimation reads these counts alone, never a
claim; one number per source and per pair of sources that meet reaches the driver (``MOST`` bounds the sources).
Values are reduced to one row per set of sources before an object is put together, so an object that holds a third
of all claims is as small there as any other.

Defined results: null and unusable values are no claims; a value whose source is not named is a claim of the source
UNKNOWN, whose accuracy stays low and which copies nobody; an object with one value has that value; equal posteriors
go to the smaller value.  Every skill of a candidate is an object of its own, under its canonical name: its posterior
tells how far the sources that name it bear it out; a source that does not name it says nothing about it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import normalize as N
from recordloom.functions.cells import present, strip
from recordloom.llm.survivor import usable_headline, usable_name
from recordloom.runtime import checkpoint

#: Sources that a model may have; their pairs must fit on the driver.
MOST = 500
#: Wrong values an object may have, prior of copying, share of its values that a copier copies.
WRONG, PRIOR, COPIES = 20, 0.1, 0.8
#: The source of values that name none, and its fixed accuracy: a little better than a guess among WRONG values.
UNKNOWN, DOUBTED = "", 0.1
#: Rounds at most, and the change of an accuracy that ends them.
ROUNDS, SETTLED = 12, 0.002
#: Sets of sources, up to which their scores are broadcast.
SMALL = 50_000


def claims(df: DataFrame, key: str, fields: dict[str, tuple[str, Column]], provenance: str = "provenance") -> DataFrame:
    """(object, field, k, value, sources): what each source says; ``fields``: name -> (column, whether it is usable)."""
    parts = []

    def about(name: str) -> Column:
        return F.filter(provenance, lambda p: F.lower(strip(p["field_name"])) == name)

    for name, (column, usable) in fields.items():
        said = about(name)
        parts.append(df.where(usable & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("object"), F.lit(name).alias("field"), strip(F.col(column)).alias("value"), _named(F.transform(said, lambda p: p["source"])).alias("sources")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("k", F.lower("value"))


def skill_claims(df: DataFrame, key: str = "candidate_id", skills: str = "skills") -> DataFrame:
    """(object, field, k, value, sources): the sources of each skill; ``field`` is ``skill:`` and its canonical name."""
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("object"), F.explode(skills).alias("s"))
    rows = rows.select("object", N.skill_name(present(F.col("s.name"))).alias("value"), _named(F.col("s.sources")).alias("sources")).where("value is not null")
    return rows.withColumn("k", F.lower("value")).withColumn("field", F.concat(F.lit("skill:"), F.col("k")))


def _named(sources: Column) -> Column:
    """The distinct sources in their order, UNKNOWN where none is named."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(sources, lambda s: F.lower(strip(s))), lambda s: s.isNotNull() & (s != ""))))
    return F.when(F.size(F.coalesce(clean, F.array().cast("array<string>"))) > 0, clean).otherwise(F.array(F.lit(UNKNOWN)))


def _copying(stats: list[tuple], accuracy: dict[str, float]) -> dict[tuple[str, str], float]:
    """The posterior that two sources depend on each other, from shared true, shared false and different values."""
    found = {}
    for s, t, true, false, apart in stats:
        a = min(max((accuracy[s] + accuracy[t]) / 2, 0.05), 0.95)
        alone = (a * a, (1 - a) ** 2 / WRONG, 1 - a * a - (1 - a) ** 2 / WRONG)
        copied = (a * COPIES + alone[0] * (1 - COPIES), (1 - a) * COPIES + alone[1] * (1 - COPIES), alone[2] * (1 - COPIES))
        odds = math.log(PRIOR / (1 - PRIOR)) + sum(n * math.log(max(c, 1e-9) / max(b, 1e-9)) for n, c, b in zip((true, false, apart), copied, alone))
        found[s, t] = 1 / (1 + math.exp(-max(min(odds, 50), -50)))
    return found


class Model:
    """What is believed of the sources: their accuracies and which depend on each other."""

    def __init__(self, accuracy: dict[str, float], copying: dict[tuple[str, str], float]) -> None:
        self.accuracy, self.copying = accuracy, copying

    def score(self, sources: list[str]) -> float:
        """The vote of a set of sources: log-odds of each, discounted for what it may have copied from a better one."""
        order, total = sorted(sources, key=lambda s: (-self.accuracy[s], s)), 0.0
        for i, s in enumerate(order):
            free = 1.0
            for other in order[:i]:
                dependent = self.copying.get((min(s, other), max(s, other)), 0.0)
                free *= 1 - COPIES * dependent if dependent > 0.01 else 1.0
            total += math.log(WRONG * self.accuracy[s] / (1 - self.accuracy[s])) * free
        return total


def _tally(model: Model):
    """(what, s, t, x): sums over patterns of what the next estimate of the sources needs."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        scores: dict[tuple[str, ...], float] = {}
        for batch in batches:
            for pattern, objects in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets = [(tuple(p["sources"]), p["n"]) for p in pattern]
                for own, _ in sets:
                    if own not in scores:
                        scores[own] = model.score(list(own))
                top = max(scores[own] for own, _ in sets)
                others = max(WRONG + 1 - sum(n for _, n in sets), 0)
                mass = sum(n * math.exp(scores[own] - top) for own, n in sets) + others * math.exp(min(-top, 700.0))
                for own, n in sets:
                    p = math.exp(scores[own] - top) / mass
                    for s in own:
                        sums["n", s, ""] += n * objects
                        sums["p", s, ""] += n * objects * p
                    for s, t in combinations(own, 2):
                        sums["true" if p > 0.5 else "false", s, t] += n * objects
                for s, t in combinations(sorted({s for own, _ in sets for s in own}), 2):
                    sums["met", s, t] += objects
        rows = [(*key, float(x)) for key, x in sums.items()]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:3]], pa.array(cols[3], pa.float64())], names=["what", "s", "t", "x"])

    return tally


def _scores(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(s) for s in batch.column(0).to_pylist()], pa.float64())], names=["sources", "score"])

    return score


def fuse(said: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, float], dict[tuple[str, str], float]]:
    """(object, field, value, posterior), the sources' accuracies, and the pairs' dependence; ``said`` has source or sources."""
    if "source" in said.columns:
        said = said.withColumn("sources", F.array("source"))
    votes = said.groupBy("object", "field", "k").agg(F.min("value").alias("value"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))
    # one row per object and set of sources: how many values it bears, and the least of them
    borne = checkpoint(votes.groupBy("object", "field", "sources").agg(F.count("*").alias("n"), F.min(F.struct("k", "value")).alias("least")))
    each = F.array_sort(F.collect_list(F.struct("sources", "n")))
    patterns = checkpoint(borne.groupBy("object", "field").agg(each.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("objects")))
    sets = checkpoint(borne.select("sources").distinct())
    known = [r["s"] for r in sets.select(F.explode("sources").alias("s")).distinct().take(MOST + 1)]
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} sources")
    model = Model({s: DOUBTED if s == UNKNOWN else 0.8 for s in sorted(known)}, {})
    for _ in range(rounds - 1 if known else 0):
        rows = patterns.mapInArrow(_tally(model), "what string, s string, t string, x double").groupBy("what", "s", "t").agg(F.sum("x").alias("x")).collect()  # one row a source or pair
        sums = {(r["what"], r["s"], r["t"]): r["x"] for r in rows}
        accuracy = {s: DOUBTED if s == UNKNOWN else min(max(sums["p", s, ""] / sums["n", s, ""], 0.05), 0.95) for s in model.accuracy}
        stats = []
        for what, s, t in sums:
            if what == "met" and UNKNOWN not in (s, t):
                true, false = sums.get(("true", s, t), 0.0), sums.get(("false", s, t), 0.0)
                stats.append((s, t, true, false, max(0.0, sums["met", s, t] - true - false)))
        change = max(abs(accuracy[s] - model.accuracy[s]) for s in accuracy)
        model = Model(accuracy, _copying(stats, accuracy))
        if change < SETTLED:
            break
    scored = sets.mapInArrow(_scores(model), "sources array<string>, score double")
    scored = borne.join(F.broadcast(scored) if sets.count() <= SMALL else scored, "sources")
    own = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "least", "n")))  # one entry a set of sources
    best = scored.groupBy("object", "field").agg(own.alias("sets"))
    top = F.get("sets", F.lit(0))
    values = F.aggregate("sets", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    mass = F.aggregate("sets", F.lit(0.0), lambda acc, x: acc + x["n"] * F.exp(F.col("top") - x["score"]))
    best = best.select("object", "field", "sets", top["score"].alias("top"), top["least"]["value"].alias("value"), F.greatest(F.lit(WRONG + 1) - values, F.lit(0)).alias("others"))
    mass = mass + F.col("others") * F.exp(F.least(F.col("top"), F.lit(700.0)))
    return best.select("object", "field", "value", (F.lit(1.0) / mass).alias("posterior")), model.accuracy, model.copying


def names_and_headlines(df: DataFrame) -> DataFrame:
    """The claims of a table of result versions."""
    return claims(df, "candidate_id", {"full_name": ("full_name", usable_name(F.col("full_name"))), "headline": ("headline", usable_headline(F.col("headline")))})
