"""Documents filled into containers of a fixed number of tokens, planned on counts of lengths.

The plan never sees documents: best-fit decreasing runs over the histogram of lengths, moving whole intervals of
containers with the same free space at once.  There are no more lengths than tokens in a container, so the
histogram and the plan are bounded by the capacity whatever the corpus' size.  Documents then take the planned
slots by their rank within their length.  The rank is counted in two steps (bucket offsets, then a rank within the
bucket), so a length that a third of all documents share is ranked by many tasks.

Only a text longer than the capacity is divided: into full containers and one rest that is packed like any other.

Defined results: null and empty texts have no tokens and share container 0; equal texts are packed each; the
numbering is the same for the same documents however they are partitioned.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.runtime import checkpoint

CAPACITY = 2048
#: Rank file of a public byte-level BPE; it is sent to the workers that have none at this path.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level BPE of that file cuts a text before merging (public, fixed).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _counter(ranks: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks if os.path.exists(ranks) else SparkFiles.get(os.path.basename(ranks)), "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n"])

    return count


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, n): the tokens of every whole text."""
    df.sparkSession.sparkContext.addFile(ranks)
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_counter(ranks), "id long, n long")


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Slots by length, and the number of containers.

    A slot is (first rank, first container, place in the container): the items of that length from that rank on go
    to one container each from that one on, until the next slot begins.
    """
    slots: dict[int, list[tuple[int, int, int]]] = {}
    free: dict[int, list[tuple[int, int, int]]] = {}  # free space -> intervals (first container, how many, items in each)
    used = 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank, own = counts[length], 0, slots.setdefault(length, [])
        # best fit: the least free space that holds the item; what was just filled may take another one
        while left:
            space = min((s for s in free if s >= length), default=None)
            if space is None:
                per = capacity // length
                full, rest = divmod(left, per)
                for k in range(per):  # new containers hold as many of this length as fit
                    if full:
                        own.append((rank, used, k + 1))
                        rank += full
                if full and capacity - per * length:
                    free.setdefault(capacity - per * length, []).append((used, full, per))
                used += full
                for k in range(rest):
                    own.append((rank, used, k + 1))
                    rank += 1
                if rest:
                    free.setdefault(capacity - rest * length, []).append((used, 1, rest))
                    used += 1
                left = 0
                break
            first, many, depth = free[space].pop()
            take = min(many, left)
            if take < many:
                free[space].append((first + take, many - take, depth))
            if not free[space]:
                del free[space]
            own.append((rank, first, depth + 1))
            rank += take
            left -= take
            if space - length:
                free.setdefault(space - length, []).append((first, take, depth + 1))
    return slots, used


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], full: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("n").to_numpy(), batch.column("rank").to_numpy()
            container, order = np.zeros(len(n), np.int64), rank + 1
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                if length in slots:
                    first, where, depth = slots[int(length)]
                    k = np.searchsorted(first, rank[at], "right") - 1
                    container[at], order[at] = full + 1 + where[k] + rank[at] - first[k], depth[k]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(container), pa.array(order), pa.array(n)], names=["id", "part", "container", "ord", "n_tokens"])

    return place


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str = RANKS, per_bucket: int = 200_000) -> DataFrame:
    """(key, part, container, ord, n_tokens): part counts the pieces of a divided text from 0; containers from 1."""
    sized = checkpoint(token_counts(df, key, text, ranks))
    long = sized.where(F.col("n") >= capacity)
    rest = sized.select("id", F.when(F.col("n") < capacity, 0).otherwise(F.floor(F.col("n") / capacity)).cast("long").alias("part"), F.when(F.col("n") < capacity, F.col("n")).otherwise(F.col("n") % capacity).alias("n"))
    rest = rest.where("n > 0 or part = 0")
    histogram = {r["n"]: r["c"] for r in rest.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most capacity rows
    total = sum(histogram.values())
    buckets = max(1, -(-total // per_bucket))
    # rank within a length: the rows of the buckets before it, then a rank inside the bucket
    cut = rest.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sizes = cut.groupBy("n", "bucket").agg(F.count("*").alias("c"))
    before = sizes.select("n", "bucket", (F.sum("c").over(Window.partitionBy("n").orderBy("bucket")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("id")) - 1
    ranked = cut.withColumn("inside", inside).join(before, ["n", "bucket"]).select("id", "part", "n", (F.col("before") + F.col("inside")).alias("rank"))
    # full pieces of divided texts: numbered the same way, by document
    pieces = long.select("id", F.floor(F.col("n") / capacity).cast("long").alias("k"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    of = pieces.groupBy("bucket").agg(F.sum("k").alias("k"))
    ahead = of.select("bucket", (F.sum("k").over(Window.orderBy("bucket")) - F.col("k")).alias("ahead"))  # one row a bucket
    full = int(of.agg(F.sum("k")).first()[0] or 0)
    numbered = pieces.withColumn("own", F.sum("k").over(Window.partitionBy("bucket").orderBy("id")) - F.col("k")).join(ahead, "bucket")
    whole = numbered.select("id", (F.col("ahead") + F.col("own")).alias("first"), F.posexplode(F.sequence(F.lit(1), "k")).alias("part", "x")).select(
        "id", F.col("part").cast("long").alias("part"), (F.col("first") + F.col("x")).alias("container"), F.lit(1).cast("long").alias("ord"), F.lit(capacity).cast("long").alias("n_tokens")
    )
    slots, _ = plan(histogram, capacity)
    if sum(map(len, slots.values())) > 5_000_000:
        raise ValueError("the plan is too large to send to every worker: lower the capacity")
    tables = {length: tuple(np.array(c, np.int64) for c in zip(*own)) for length, own in slots.items()}
    placed = ranked.mapInArrow(_place(tables, full), "id long, part long, container long, ord long, n_tokens long")
    return placed.unionByName(whole).withColumnRenamed("id", key)
