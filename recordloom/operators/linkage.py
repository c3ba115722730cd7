"""Which extractions describe the same person: connected components over shared tokens.

Every identifier (mail, phone, linkedin, github) and every pair of name and company or title becomes a token;
records that share a token are tied to the token's smallest record, so the edges are linear in the tokens
however many records share one.  In every round each record hooks to the least of its closed neighbourhood by a
fresh hash and the links are drawn between what was hooked to, so they shrink by a constant factor in expectation
whatever the shape of the groups; each round is cut off with checkpoint().  Links that are counted to be few are
followed in one task, with the same result.

``ignore_stand_ins`` leaves out cells such as ``n/a`` that would tie strangers together; without it only blanks
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import normalize as N
from recordloom.functions.cells import present
from recordloom.runtime import checkpoint


#: Links (both ways) that one task may follow.
FEW = 4_000_000


def tokens(ext: DataFrame, ignore_stand_ins: bool = False) -> DataFrame:
    """(ext_id, kind, key1, key2), one row per token of an extraction."""
    clean = present if ignore_stand_ins else N.blank_to_null
    low = lambda c: F.lower(clean(c))

    def of(kind: str, keys: Column, name: Column | None = None) -> Column:
        return F.transform(F.filter(F.array_distinct(keys), lambda k: k.isNotNull()), lambda k: F.struct(F.lit(kind).alias("kind"), (k if name is None else name).alias("key1"), (F.lit("") if name is None else k).alias("key2")))

    # lambdas work out what they name once for each element: what a record has once is worked out before
    once = {c: low(F.col(c)) for c in ("full_name", "company", "title", "headline")} | {c: N.url_key(clean(F.col(c))) for c in ("linkedin", "github")}
    ext = ext.select("ext_id", "emails", "phones", "experience", *[v.alias(c) for c, v in once.items()])
    name = F.col("full_name")
    none = F.array().cast("array<string>")
    jobs = lambda f: F.coalesce(F.transform("experience", lambda e: low(e[f])), none)
    named = lambda kind, keys: F.when(name.isNotNull(), of(kind, keys, name)).otherwise(F.array().cast("array<struct<kind:string,key1:string,key2:string>>"))
    every = F.concat(
        of("email", F.coalesce(F.transform("emails", low), none)),
        of("phone", F.coalesce(F.transform("phones", lambda p: N.phone_e164(clean(p))), none)),
        of("linkedin", F.array("linkedin")),
        of("github", F.array("github")),
        named("name_company", F.concat(F.array("company"), jobs("company"))),
        named("name_title", F.concat(F.array("title", "headline"), jobs("title"))),
    )
    return ext.select("ext_id", F.inline(every))


def edges(toks: DataFrame) -> DataFrame:
    """(u, v): each extraction and the smallest extraction that shares a token (all columns but ext_id) with it."""
    one = Window.partitionBy(*[c for c in toks.columns if c != "ext_id"]).orderBy("ext_id")
    return toks.select(F.col("ext_id").alias("u"), F.min("ext_id").over(one).alias("v")).where("u <> v").distinct()


def _least_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that fit one task: roots hook to the least root that they are linked to, then all labels become roots."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    ids, at = np.unique(np.concatenate([x for p in parts for x in p]) if parts else np.zeros(0, np.int64), return_inverse=True)
    cut = np.cumsum([0] + [len(p[0]) for p in parts for _ in (0, 1)])
    u = np.concatenate([at[cut[2 * k] : cut[2 * k + 1]] for k in range(len(parts))]) if parts else at
    v = np.concatenate([at[cut[2 * k + 1] : cut[2 * k + 2]] for k in range(len(parts))]) if parts else at
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, label[u], label[v])
        np.minimum.at(low, label[v], label[u])
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            break
        label = low
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[label], pa.int64())], names=["u", "r"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(ext_id, root) for every extraction that has a link; root is the least of its component."""
    kept = lambda df: checkpoint(df, estimates=False)

    def drawn(df: DataFrame) -> DataFrame:  # each link once, from the larger end
        u, v = F.col("u").cast("long"), F.col("v").cast("long")
        return kept(df.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())

    live = drawn(links)
    hooks: list[DataFrame] = []
    while 2 * live.count() > few:
        rank = lambda c: F.struct(F.xxhash64(F.lit(7919 * (len(hooks) + 1)), c).alias("h"), c.alias("x"))  # noqa: E731, B023
        both = live.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        hook = kept(both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m")).select("u", F.least(F.col("m"), rank(F.col("u")))["x"].alias("r")))
        hooks.append(hook)
        half = live.join(hook, "u").select(F.col("r").alias("a"), "v")
        live = drawn(half.join(hook.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("r").alias("v")))
    found = kept(live.coalesce(1).mapInArrow(_least_labels, "u long, r long"))
    if not hooks:
        return found.select(F.col("u").alias("ext_id"), F.col("r").alias("root"))
    for hook in reversed(hooks):  # from the few that were left back to all
        later = found.select(F.col("u").alias("r"), F.col("r").alias("s"))
        found = hook.join(later, "r", "left").select("u", F.coalesce("s", "r").alias("r"))
    found = kept(found)
    least = found.groupBy("r").agg(F.min("u").alias("root"))
    return found.join(least, "r").select(F.col("u").alias("ext_id"), "root")


def link(ext: DataFrame, ignore_stand_ins: bool = False) -> DataFrame:
    """(ext_id, root) for every extraction; one that shares nothing is its own root."""
    toks = tokens(ext, ignore_stand_ins)
    # 128 bits of each token are sent and sorted, once
    found = components(edges(toks.select("ext_id", F.xxhash64("kind", "key1", "key2").alias("h"), F.xxhash64("key2", "key1", "kind").alias("g"))))
    return ext.select("ext_id").join(found, "ext_id", "left").select("ext_id", F.coalesce("root", "ext_id").alias("root"))
