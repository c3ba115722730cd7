"""Profiles reshaped by a small path language, compiled once to column expressions.

Paths: ``a.b.c``, ``emails[0]`` (from 0), ``skills[].name`` (over all entries), ``skills[]``.  What does not exist
is null; a fan-out that gives nothing is missing.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import normalize as N

POLICIES = ("null", "omit", "error")
_INDEX, _EACH = re.compile(r"^(\w+)\[(\d+)\]$"), re.compile(r"^(\w+)\[\]$")
TYPES = {"string": (T.StringType,), "number": (T.DoubleType, T.FloatType, T.IntegerType, T.LongType), "integer": (T.IntegerType, T.LongType, T.BooleanType), "boolean": (T.BooleanType,), "array": (T.ArrayType,), "object": (T.StructType, T.MapType)}


def load_config(path: str) -> dict[str, Any]:
    """A projection read from a JSON file and checked."""
    with open(path, encoding="utf-8-sig") as f:
        return check_config(json.load(f))


def check_config(config: Any) -> dict[str, Any]:
    if not isinstance(config, dict) or not isinstance(config.get("fields"), list):
        raise ValueError("a projection needs a list of fields")
    for spec in config["fields"]:
        if not isinstance(spec, dict) or not (spec.get("path") or spec.get("from")):
            raise ValueError(f"a field needs a path or a from: {spec}")
    if config.get("missing_value", "null") not in POLICIES:
        raise ValueError(f"missing_value is none of {', '.join(POLICIES)}")
    return config


def _walk(value: Column | None, kind: T.DataType | None, parts: list[str]) -> tuple[Column | None, T.DataType | None]:
    if not parts or value is None:
        return value, kind
    part, rest = parts[0], parts[1:]
    plain = _INDEX.match(part) or _EACH.match(part)
    field = plain.group(1) if plain else part
    if not isinstance(kind, T.StructType) or field not in kind.fieldNames():
        return None, None
    inner, child = value[field], kind[field].dataType
    if not plain:
        return _walk(inner, child, rest)
    if not isinstance(child, T.ArrayType):
        return None, None
    if _INDEX.match(part):
        return _walk(F.get(inner, F.lit(int(plain.group(2)))), child.elementType, rest)
    if not rest:
        return inner, child
    probe, element = _walk(F.lit(None), child.elementType, rest)
    if element is None:
        return None, None
    each = F.transform(inner, lambda x: _walk(x, child.elementType, rest)[0])
    return F.when(F.size(each) > 0, each), T.ArrayType(element)


def resolve(df: DataFrame, path: str) -> Column:
    """The column a path means in ``df``; null where there is no such path."""
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    found = _walk(whole, df.schema, path.split("."))[0]
    return F.lit(None) if found is None else found


def output_key(spec: dict[str, Any]) -> str:
    path = spec.get("path") or spec.get("from", "")
    return re.sub(r"\[\d*\]", "", path.rsplit(".", 1)[-1]) or path


def _normalised(value: Column, kind: T.DataType, how: str | None) -> Column:
    rule = {"E164": lambda c: F.coalesce(N.phone_e164(c), c), "canonical": N.skill_name}.get(how or "")
    if rule is None:
        return value
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(value, rule)
    return rule(value) if isinstance(kind, T.StringType) else value


def project(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The projected rows.  With the policy ``error`` rows that lack a required field are left out (see ``rejects``)."""
    config = check_config(config)
    out: dict[str, Column] = {}
    needed: list[Column] = []
    for spec in config["fields"]:
        key, path = output_key(spec), spec.get("from") or spec["path"]
        if key in out:
            warnings.warn(f"two fields are named {key}; the last one is kept", stacklevel=2)
        value = resolve(df, path)
        kind = df.select(value.alias("x")).schema["x"].dataType
        value = _normalised(value, kind, spec.get("normalize"))
        out.pop(key, None)
        out[key] = value.cast("string") if isinstance(kind, T.NullType) else value
        if spec.get("required") and config.get("missing_value") == "error":
            needed.append(value.isNotNull())
    if config.get("include_confidence") and "overall_confidence" not in out and "overall_confidence" in df.columns:
        out["overall_confidence"] = F.col("overall_confidence")
    out.pop("provenance", None) if not config.get("include_provenance") else out.update({"provenance": F.col("provenance")} if "provenance" in df.columns else {})
    rows = df
    for n in needed:
        rows = rows.where(n)
    return rows.select(*[v.alias(k) for k, v in out.items()])


def rejects(df: DataFrame, config: dict[str, Any], key: str = "candidate_id") -> DataFrame:
    """(key, missing) of the rows that ``error`` leaves out."""
    specs = [s for s in check_config(config)["fields"] if s.get("required")]
    missing = F.array_compact(F.array(*[F.when(resolve(df, s.get("from") or s["path"]).isNull(), F.lit(output_key(s))) for s in specs]))
    return df.select(F.col(key), missing.alias("missing")).where(F.size("missing") > 0)


def as_json(rows: DataFrame, left_out: Iterable[str] = ()) -> DataFrame:
    """(json): rows as documents; keys in ``left_out`` are absent where they have no value, others are null."""
    keep = {"ignoreNullFields": "false"}
    # each key is its own small document, so that one can be absent while nulls inside another stay
    parts = [F.to_json(F.struct(F.col(f"`{c}`").alias(c)), keep) for c in rows.columns]
    parts = [F.when(F.col(f"`{c}`").isNotNull(), p) if c in set(left_out) else p for c, p in zip(rows.columns, parts)]
    kept = F.transform(F.array_compact(F.array(*parts)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    return rows.select(F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}")).alias("json"))


def to_json(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(json): projected rows as documents; with the policy ``omit`` keys without a value are absent, else they are null.

    Confidence and provenance that were only asked for by include_* are absent where there is none.
    """
    rows = project(df, config)
    asked = {output_key(s) for s in config["fields"]}
    extra = [c for c in rows.columns if c not in asked]
    return as_json(rows, rows.columns if config.get("missing_value") == "omit" else extra)


def check_output(df: DataFrame, config: dict[str, Any]) -> dict[str, str]:
    """Output fields whose type is not the declared one, with what they are."""
    wrong = {}
    for spec in check_config(config)["fields"]:
        key, declared = output_key(spec), spec.get("type")
        if declared in TYPES and key in df.columns and not isinstance(df.schema[key].dataType, TYPES[declared]):
            wrong[key] = f"expected {declared}, got {df.schema[key].dataType.simpleString()}"
    return wrong


def check_required(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The projected rows with ``errors``: required fields that are absent or null."""
    needed = [output_key(s) for s in check_config(config)["fields"] if s.get("required")]
    of = lambda k: F.when(F.col(f"`{k}`").isNull(), F.lit(f"required field {k} is null")) if k in df.columns else F.lit(f"required field {k} is missing")
    return df.withColumn("errors", F.array_compact(F.array(*map(of, needed))) if needed else F.array().cast("array<string>"))
