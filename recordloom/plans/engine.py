"""Files in, canonical profiles out: validation, extraction, linkage, fusion, checks and projection in one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import fusion, linkage, projection, validation
from recordloom.operators.schema import EXTRACTION
from recordloom.runtime import checkpoint
from recordloom.sources import files as F_
from recordloom.sources import readers


@dataclass
class Options:
    """``dedup_mode``: 'reference' or 'full' (see fusion).  ``text_documents``: read DOCX and TXT too."""

    as_of: str = field(default_factory=lambda: date.today().strftime("%Y-%m"))
    dedup_mode: str = "reference"
    phone_profile: str = "digits"
    text_documents: bool = True
    ignore_stand_ins: bool = False


@dataclass
class Result:
    """``projected`` follows ``config``; rows that its policy leaves out are among the warnings."""

    profiles: DataFrame
    warnings: DataFrame
    projected: DataFrame | None
    metadata: dict[str, int]
    config: dict[str, Any] | None = None

    def documents(self) -> DataFrame:
        """(json): one document a row, missing values as the policy wants them."""
        return projection.to_json(self.profiles, self.config) if self.config else projection.as_json(self.profiles.drop("root"))


class Engine:
    def __init__(self, spark: SparkSession, options: Options | None = None) -> None:
        self.spark, self.options = spark, options or Options()

    def extract(self, usable: DataFrame) -> DataFrame:
        """Extractions of all usable files, numbered in the order of the files and of the records in them."""
        return readers.read_all(self.spark, usable, self.options).select(*EXTRACTION)

    def run(self, paths: list[str], config: dict[str, Any] | None = None) -> Result:
        config = projection.check_config(config) if config else None
        scanned = checkpoint(F_.scan(self.spark, paths))
        usable = F_.usable(scanned)
        ext = checkpoint(self.extract(usable))
        groups = linkage.link(ext, self.options.ignore_stand_ins)
        profiles = checkpoint(fusion.fuse(ext, groups, self.options.as_of, self.options.dedup_mode, self.options.phone_profile)).orderBy("root")
        no_reader = usable.where(~F.col("kind").isin(*readers.READERS)).select(F.lit("source").alias("stage"), F.col("path").alias("ref"), F.lit(0).alias("seq"), F.lit("no reader for this kind of file").alias("message"))
        notes = F_.file_warnings(scanned).unionByName(no_reader)
        notes = notes.unionByName(ext.select(F.lit("extract").alias("stage"), F.col("ext_id").cast("string").alias("ref"), F.posexplode("warnings").alias("seq", "message"))).unionByName(validation.warnings_of(profiles))
        meta = {"source_count": usable.count(), "given_count": len(paths), "candidate_count": profiles.count()}
        result = Result(profiles, notes, None, meta)
        return under(result, config) if config else result


def under(result: Result, config: dict[str, Any]) -> Result:
    """The same run projected by ``config``; what its policy leaves out is among the warnings."""
    config = projection.check_config(config)
    notes, meta = result.warnings, dict(result.metadata)
    if config.get("missing_value") == "error":
        left_out = checkpoint(projection.rejects(result.profiles, config))
        first = F.concat(F.lit("left out of the projection: required field "), F.get("missing", F.lit(0)), F.lit(" is missing"))
        notes = notes.unionByName(left_out.select(F.lit("project").alias("stage"), F.col("candidate_id").alias("ref"), F.lit(0).alias("seq"), first.alias("message")))
        meta["candidate_count"] -= left_out.count()
    return Result(result.profiles, notes, projection.project(result.profiles, config), meta, config)


def write_json(result: Result, folder: str) -> None:
    """The scalable sink: documents as JSON lines, the warnings, and the metadata beside them."""
    result.documents().write.mode("overwrite").text(f"{folder}/candidates")
    result.warnings.write.mode("overwrite").json(f"{folder}/warnings")
    meta = result.metadata | {"warning_count": result.warnings.count()}
    spark = result.profiles.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def envelope(result: Result, most: int = 10_000) -> str:
    """One document {candidates, metadata} for small runs; refuses more than ``most`` profiles or warnings (use write_json)."""
    found, notes = result.documents().take(most + 1), result.warnings.take(most + 1)
    if max(len(found), len(notes)) > most:
        raise ValueError(f"more than {most} profiles or warnings for one document")
    said = [f"{r['stage']}: {r['ref']}: {r['message']}" for r in notes]
    return json.dumps({"candidates": [json.loads(r["json"]) for r in found], "metadata": result.metadata | {"warnings": said}}, ensure_ascii=False, indent=2)
