"""Schemas that drift between the files of a feed: a catalogue of column lifespans, the changes, one table.

Footer-like metadata is taken out of every record (path and value type of each field), counted before any shuffle to
one catalogue row per producer, file, field and type; lag finds the islands of files over which a field, and a field
of one type, lived.  Starts and endings of a field's islands are the added and removed fields, a typed island that
follows another at once is a retyped field.  An ending and a start at the same boundary are one renamed field if the
applicants that occur on both sides carry the same values.  The lifespans with the name and type each began with are
the alias table, from which the casts of the unified table are generated.

Scale: three narrow passes over the records.  The first sends counts to the shuffle; the second 64-bit keys of the
values of fields that start or end, grouped by value, so that neither many fields at a boundary nor one applicant of
very many records meet in one task; the third only the presence of fields that may be renamed.  Fields of one record
never leave its row.  What each file needs from the catalogue reaches its records by a join, broadcast only if it is
counted to be small.

Defined results: a record that is no JSON object has no fields, but its file still counts as a file and it keeps its
row; of a key that a record repeats the last counts; a field whose values are all null has no type and is never
retyped; numbers that come as text are strings; records without feed or file change nothing and keep their own names;
a name that comes back while its first field lives on under another name is told apart by the number of its file.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.runtime import checkpoint

NESTED = "experience"
#: Share of the comparable values that must agree for a rename, and how many must agree at least.
AGREE, LEAST = 0.6, 2
#: Fields over all files, up to which the catalogue is broadcast to the records; beyond, records are shuffled to it.
SMALL = 200_000
_WORDS = re.compile(r"[^\W_]+")
#: How a value of one type is written in the type its field began with; other pairs keep the value's text.
CASTS: dict[tuple[str, str], Callable] = {}


# ------------------------------------------------------------------ records, in Arrow batches


def _no_number(word: str) -> None:
    raise ValueError(word)


def record_of(payload: str | None) -> dict | None:
    """The object a text holds, or nothing."""
    try:
        doc = json.loads(payload or "", parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def _utf8(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def kind_of(v: object) -> str | None:
    if v is None:
        return None
    return "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "list" if isinstance(v, list) else "object"


def _entries(doc: dict, nested: str) -> list[tuple[int, dict]]:
    own = doc.get(nested)
    return [(k, e) for k, e in enumerate(own, 1) if isinstance(e, dict)] if isinstance(own, list) else []


def leaves(v: object) -> list[str]:
    """The single values of a value as text, in their order."""
    out, todo = [], [v]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo.extend(reversed(x.values()))
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif x is not None:
            out.append(x if isinstance(x, str) else str(x).lower())
    return out


def said(v: object) -> set[str]:
    """What a value says without keys, marks and case: all of it, its words in order of the alphabet, and its single values."""
    own = [_WORDS.findall(leaf.lower()) for leaf in leaves(v)]
    words = [w for leaf in own for w in leaf]
    return {"".join(words), "".join(sorted(words)), *map("".join, own)} - {"", "null"}


def _metadata(nested: str, feed: pa.DataType, file: pa.DataType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*((*key, n) for key, n in seen.items()))) or [()] * 5
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (feed, file, pa.string(), pa.string(), pa.int64()))], names=["feed", "file", "path", "kind", "n"])

        for batch in batches:
            for a, b, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc = record_of(payload)
                if doc is None:
                    continue
                for key, v in doc.items():
                    seen[a, b, _utf8(key), kind_of(v)] += 1
                for _, entry in _entries(doc, nested):
                    for key, v in entry.items():
                        seen[a, b, _utf8(f"{nested}.{key}"), kind_of(v)] += 1
            if len(seen) > 100_000:
                yield out()
        yield out()

    return read


def _evidence(nested: str, values: bool):
    """k (boundary, applicant, entry), id (field and side) and, with ``values``, h of each value of a wanted field."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        key = lambda text: signed(xxh64_intdigest(text.encode("utf-8", "replace")))
        parsed: dict[str, list[tuple]] = {}
        for batch in batches:
            ks, ids, hs = [], [], []
            for who, payload, want in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc = record_of(payload)
                if doc is None:
                    continue
                wanted = parsed.get(want)
                if wanted is None:  # one text for each file
                    if len(parsed) > 1000:
                        parsed.clear()
                    wanted = parsed[want] = [(w["path"].startswith(f"{nested}."), w["path"].removeprefix(f"{nested}."), w["b"], w["id"]) for w in json.loads(want)]
                entries = _entries(doc, nested)
                known: dict[tuple[int, str], list[int]] = {}
                for deep, name, b, number in wanted:
                    for k, part in entries if deep else ((0, doc),):
                        v = part.get(name)
                        if v is None:
                            continue
                        tell = known.get((k, name))
                        if tell is None:
                            tell = known[k, name] = [key(text) for text in said(v)] if values else [0][: len(said(v))]
                        if tell:
                            place = key(f"{b}\x01{who}\x01{k}")
                            ks += [place] * len(tell)
                            ids += [number] * len(tell)
                            hs += tell
            cols = [pa.array(ks, pa.int64()), pa.array(ids, pa.int64())] + ([pa.array(hs, pa.int64())] if values else [])
            yield pa.RecordBatch.from_arrays(cols, names=["k", "id", "h"][: len(cols)])

    return read


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _as_number(v: object) -> str | None:
    try:
        float(_text(v))
    except ValueError:
        return None
    return _text(v).strip()


def _as_boolean(v: object) -> str | None:
    low = _text(v).strip().lower()
    return "true" if low in ("true", "t", "yes", "y", "1") else "false" if low in ("false", "f", "no", "n", "0") else None


CASTS |= {(a, "number"): _as_number for a in ("string", "boolean", "list", "object")}
CASTS |= {(a, "boolean"): _as_boolean for a in ("string", "number", "list", "object")}
CASTS |= {(a, "string"): lambda v: " ".join(leaves(v)) for a in ("list", "object")}


def cast(v: object, kind: str | None) -> str | None:
    """The value as text in the type its field began with; null where it cannot be that."""
    own = kind_of(v)
    if own is None:
        return None
    text = CASTS.get((own, kind), _text)(v)
    return text if text is None else _utf8(text)


def _under_first_names(nested: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.map_(pa.string(), pa.string())
        parsed: dict[str | None, dict] = {}
        for batch in batches:
            tops, inner = [], []
            for payload, alias in zip(batch.column("payload").to_pylist(), batch.column("alias").to_pylist()):
                doc = record_of(payload) or {}
                names = parsed.get(alias)
                if names is None:  # one text for each file
                    if len(parsed) > 1000:
                        parsed.clear()
                    names = parsed[alias] = {a["path"]: (a["original"], a.get("kind")) for a in json.loads(alias or "[]")}

                def renamed(part: dict, before: str, names: dict = names) -> list[tuple]:
                    row = {}
                    for key, v in part.items():
                        name, kind = names.get(_utf8(before + key), (_utf8(before + key), None))
                        row[name[len(before) :]] = cast(v, kind)
                    return sorted(row.items())

                tops.append(renamed({k: v for k, v in doc.items() if k != nested}, ""))
                inner.append([renamed(e, f"{nested}.") for _, e in _entries(doc, nested)])
            kept = [batch.column(c) for c in ("key", "feed", "file")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tops, pairs), pa.array(inner, pa.list_(pairs))], names=["key", "feed", "file", "fields", "entries"])

    return read


# ------------------------------------------------------------------ the catalogue


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _named(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def _files(df: DataFrame, feed: str, file: str) -> DataFrame:
    """Each file of a feed with its place in the order of the files."""
    w = Window.partitionBy("feed").orderBy("file")
    files = _named(df, feed=feed, file=file).where("feed is not null and file is not null").distinct()
    return files.withColumn("ord", F.row_number().over(w)).withColumn("last", F.count("*").over(Window.partitionBy("feed")))


def catalogue(df: DataFrame, files: DataFrame, feed: str, file: str, payload: str, nested: str) -> DataFrame:
    """feed, file, ord, last, path, kind, retyped, the island (lo to hi) of the field and the typed island in it."""
    rows = _named(df, feed=feed, file=file, payload=payload).where("feed is not null and file is not null")
    types = [rows.schema[c].dataType for c in ("feed", "file")]
    seen = rows.mapInArrow(_metadata(nested, *map(_arrow, types)), f"feed {types[0].simpleString()}, file {types[1].simpleString()}, path string, kind string, n bigint")
    by_kind = seen.groupBy("feed", "file", "path", "kind").agg(F.sum("n").alias("n"))
    top = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))["kind"]
    rows = by_kind.groupBy("feed", "file", "path").agg(top.alias("kind")).join(files, ["feed", "file"])
    w = Window.partitionBy("feed", "path").orderBy("ord")
    rows = rows.withColumn("before", F.lag("ord").over(w)).withColumn("kind_before", F.lag("kind").over(w))
    rows = rows.withColumn("starts", F.coalesce(F.col("before") < F.col("ord") - 1, F.lit(True)))
    rows = rows.withColumn("retyped", ~F.col("starts") & F.coalesce(F.col("kind") != F.col("kind_before"), F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.col("starts").cast("int")).over(w)).withColumn("typed", F.sum((F.col("starts") | F.col("retyped")).cast("int")).over(w))
    whole = Window.partitionBy("feed", "path", "island")
    rows = rows.withColumn("lo", F.min("ord").over(whole)).withColumn("hi", F.max("ord").over(whole))
    return rows.drop("before", "kind_before", "starts", "island")


def _with_files(df: DataFrame, per_file: DataFrame, how: str) -> DataFrame:
    """Records with what their file has in the catalogue: broadcast if counted to be small, else by a shuffle."""
    n = per_file.agg(F.sum("n")).first()[0] or 0
    return df.join(F.broadcast(per_file) if n <= SMALL else per_file, ["feed", "file"], how)


def _votes(df: DataFrame, wanted: DataFrame, files: DataFrame, feed: str, file: str, who: str, payload: str, nested: str) -> DataFrame:
    """old, new (ids of wanted), n applicants and entries with values on both sides, same of them with a common one, kinds of these."""
    rows = _named(df, feed=feed, file=file, who=who, payload=payload).where("feed is not null and file is not null and who is not null").withColumn("who", F.col("who").cast("string"))

    def asked(which: DataFrame, values: bool) -> DataFrame:
        alive = which.select("feed", F.explode(F.sequence("lo", "hi")).alias("ord"), F.struct("path", "b", "id").alias("w")).join(files.select("feed", "file", "ord"), ["feed", "ord"])
        per_file = alive.groupBy("feed", "file").agg(F.to_json(F.collect_list("w")).alias("want"), F.count("*").alias("n"))  # the fields of one file
        return _with_files(rows, checkpoint(per_file), "inner").select("who", "payload", "want").mapInArrow(_evidence(nested, values), "k bigint, id bigint" + (", h bigint" if values else ""))

    side = wanted.select("id", "is_new")
    sides = lambda e, *by: e.groupBy(*by).agg(F.collect_set(F.when(~F.col("is_new"), F.col("id"))).alias("olds"), F.collect_set(F.when(F.col("is_new"), F.col("id"))).alias("news")).where("size(olds) > 0 and size(news) > 0")
    meet = lambda g, *by: g.select(*by, F.explode("olds").alias("old"), "news").select(*by, "old", F.explode("news").alias("new"))
    # one shuffle by place and value: what follows stays in its partition, and one applicant's many values are spread
    told = asked(wanted, True).repartition("k", "h").groupBy("k", "h", "id").agg(F.lit(1)).join(_hint(side), "id")
    shared = meet(sides(told, "k", "h"), "k", "h").groupBy("old", "new", "k").agg(F.min("h").alias("h"))
    may_be = checkpoint(shared.groupBy("old", "new").agg(F.count("*").alias("same"), F.approx_count_distinct("h").alias("kinds")).where(F.col("same") >= LEAST))
    left = wanted.join(may_be.select(F.explode(F.array("old", "new")).alias("id")).distinct(), "id", "left_semi")
    there = asked(left, False).distinct().join(_hint(side), "id")
    both = meet(sides(there, "k")).groupBy("old", "new").agg(F.count("*").alias("n"))
    return may_be.join(both, ["old", "new"])


def _hint(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SMALL else small


def _lifespans(df: DataFrame, feed: str, file: str, who: str, payload: str, nested: str) -> tuple[DataFrame, ...]:
    """files, catalogue, renamed (feed, ord, old_path, new_path), and all starts and endings."""
    files = checkpoint(_files(df, feed, file))
    cat = checkpoint(catalogue(df, files, feed, file, payload, nested))  # small: files x fields
    starts = cat.where("lo = ord and ord > 1").select("feed", "ord", F.col("path").alias("new_path"), "lo", "hi")
    ends = cat.where("hi = ord and ord < last").select("feed", (F.col("ord") + 1).alias("ord"), F.col("path").alias("old_path"), "lo", "hi")
    edge = lambda df, c, new: df.select("feed", F.col("ord").alias("at"), F.col(c).alias("path"), F.lit(new).alias("is_new"), "lo", "hi")
    edges = edge(starts, "new_path", True).unionByName(edge(ends, "old_path", False)).withColumn("deep", F.col("path").startswith(f"{nested}."))
    level = Window.partitionBy("feed", "at", "deep")
    edges = edges.withColumn("x", F.min("is_new").over(level)).withColumn("y", F.max("is_new").over(level)).where("x <> y")
    wanted = checkpoint(edges.select("feed", "at", "path", "is_new", "lo", "hi", F.xxhash64("feed", "at").alias("b"), F.xxhash64("feed", "at", "path", "is_new").alias("id")))
    votes = _votes(df, wanted, files, feed, file, who, payload, nested)
    named = lambda side, new: wanted.where(F.col("is_new") == new).select(F.col("id").alias(side), *([] if new else ["feed", "at"]), F.col("path").alias(f"{side}_path"))
    votes = votes.join(named("old", False), "old").join(named("new", True), "new").where(F.col("old_path").startswith(f"{nested}.") == F.col("new_path").startswith(f"{nested}."))
    votes = (
        votes.where((F.col("same") >= AGREE * F.col("n")) & ((F.col("kinds") >= LEAST) | (F.col("same") == F.col("n"))))
        # few distinct values (flags, short codes) agree by chance: these must agree without exception
        .where((F.col("kinds") > 3) | (F.col("same") == F.col("n")))
    )
    strength = F.struct(F.col("same") / F.col("n"), F.col("same"))
    best = votes.withColumn("a", F.row_number().over(Window.partitionBy("feed", "at", "old_path").orderBy(strength.desc(), "new_path")))
    best = best.withColumn("c", F.row_number().over(Window.partitionBy("feed", "at", "new_path").orderBy(strength.desc(), "old_path"))).where("a = 1 and c = 1")
    renamed = checkpoint(best.select("feed", F.col("at").alias("ord"), "old_path", "new_path"))
    return files, cat, renamed, starts, ends


def changes(df: DataFrame, feed: str = "feed_id", file: str = "file_no", who: str = "applicant_ref", payload: str = "payload", nested: str = NESTED) -> DataFrame:
    """(feed, file, change_kind, old_path, new_path) of each file against the file before it."""
    files, cat, renamed, starts, ends = _lifespans(df, feed, file, who, payload, nested)
    order = files.select("feed", "ord", "file")
    retyped = cat.where("retyped").select("feed", "ord", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    added = starts.join(renamed.select("feed", "ord", "new_path"), ["feed", "ord", "new_path"], "left_anti").select("feed", "ord", F.lit("added").alias("change_kind"), F.lit("").alias("old_path"), "new_path")
    removed = ends.join(renamed.select("feed", "ord", "old_path"), ["feed", "ord", "old_path"], "left_anti").select("feed", "ord", F.lit("removed").alias("change_kind"), "old_path", F.lit("").alias("new_path"))
    moved = renamed.select("feed", "ord", F.lit("renamed").alias("change_kind"), "old_path", "new_path")
    rows = retyped.unionByName(added).unionByName(removed).unionByName(moved)
    return rows.join(order, ["feed", "ord"]).select(F.col("feed").alias(feed), F.col("file").alias(file), "change_kind", "old_path", "new_path")


def alias_table(cat: DataFrame, renamed: DataFrame, files: DataFrame) -> DataFrame:
    """(feed, path, lo, hi, original, kind): every lifespan with the name and type its field began with.

    Renames form chains; pointers to the lifespan before are jumped until all of them point to a beginning.  Only
    the catalogue is read.
    """
    spans = cat.groupBy("feed", "path", "lo", "hi").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("ord"))).alias("kind"))
    came = renamed.select("feed", F.col("ord").alias("lo"), F.col("new_path").alias("path"), F.col("old_path"), (F.col("ord") - 1).alias("hi_before"))
    before = spans.select("feed", F.col("path").alias("old_path"), F.col("hi").alias("hi_before"), F.struct("path", "lo").alias("parent"))
    parents = spans.join(came, ["feed", "path", "lo"], "left").join(before, ["feed", "old_path", "hi_before"], "left")
    links = checkpoint(parents.select("feed", F.struct("path", "lo").alias("me"), "hi", "kind", F.coalesce("parent", F.struct("path", "lo")).alias("root")))
    while True:
        up = links.select("feed", F.col("me").alias("root"), F.col("root").alias("above"))
        moved = checkpoint(links.join(up, ["feed", "root"]).select("feed", "me", "hi", "kind", "above", (F.col("above") != F.col("root")).alias("moved")))
        links = moved.select("feed", "me", "hi", "kind", F.col("above").alias("root"))
        if moved.where("moved").isEmpty():
            break
    # a name that begins again while what first bore it lives on under another name is another field
    chains = links.groupBy("feed", "root").agg(F.max("hi").alias("till"), F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("me.lo"))).alias("kind"))
    earlier = Window.partitionBy("feed", "root.path").orderBy("root.lo").rowsBetween(Window.unboundedPreceding, -1)
    chains = chains.withColumn("apart", F.coalesce(F.max("till").over(earlier) >= F.col("root.lo"), F.lit(False)))
    begun = files.select(F.col("feed").alias("f"), F.col("ord").alias("o"), "file")
    chains = chains.join(begun, (F.col("feed") == F.col("f")) & (F.col("root.lo") == F.col("o"))).select("feed", "root", "kind", F.when(F.col("apart"), F.concat("root.path", F.lit("#"), F.col("file").cast("string"))).otherwise(F.col("root.path")).alias("original"))
    return links.drop("kind").join(chains, ["feed", "root"]).select("feed", F.col("me.path").alias("path"), F.col("me.lo").alias("lo"), "hi", "original", "kind")


def unify(df: DataFrame, key: str = "rec_id", feed: str = "feed_id", file: str = "file_no", who: str = "applicant_ref", payload: str = "payload", nested: str = NESTED) -> DataFrame:
    """One row per record under the original field names: key, feed, file, fields (map), and the nested entries (array of maps)."""
    files, cat, renamed, _, _ = _lifespans(df, feed, file, who, payload, nested)
    spans = alias_table(cat, renamed, files)
    alive = spans.select("feed", F.explode(F.sequence("lo", "hi")).alias("ord"), F.struct("path", "original", "kind").alias("a")).join(files.select("feed", "file", "ord"), ["feed", "ord"])
    per_file = checkpoint(alive.groupBy("feed", "file").agg(F.to_json(F.collect_list("a")).alias("alias"), F.count("*").alias("n")))  # the fields of one file
    rows = _named(df, key=key, feed=feed, file=file, payload=payload)
    types = {c: rows.schema[c].dataType.simpleString() for c in ("key", "feed", "file")}
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", fields map<string,string>, entries array<map<string,string>>"
    done = _with_files(rows, per_file, "left").select("key", "feed", "file", "payload", "alias").mapInArrow(_under_first_names(nested), schema)
    return done.select(F.col("key").alias(key), F.col("feed").alias(feed), F.col("file").alias(file), "fields", F.col("entries").alias(nested))
