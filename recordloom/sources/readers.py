"""The readers of the kinds of files, in a registry that others can be added to.

A reader takes the files of its kinds (see ``files.scan``) and gives extractions (see ``schema.EXTRACTION``) with
``file_ord``; ``ext_id`` numbers the records of a file in their order and is below 2**46.
"""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources import files as files_
from recordloom.sources import records


class Reader(Protocol):
    def __call__(self, spark: SparkSession, files: DataFrame, options: Any) -> DataFrame: ...


READERS: dict[str, Reader] = {}


def reader(*kinds: str):
    """Registers a reader for kinds of files; the last one registered for a kind is used."""

    def register(read: Reader) -> Reader:
        READERS.update(dict.fromkeys(kinds, read))
        return read

    return register


def read_all(spark: SparkSession, files: DataFrame, options: Any) -> DataFrame:
    """Extractions of all files; file and record are in one number, so that nothing is sorted or counted."""
    by_reader: dict[Reader, list[str]] = {}
    for kind, read in READERS.items():
        by_reader.setdefault(read, []).append(kind)
    every = None
    for read, kinds in by_reader.items():
        part = read(spark, files.where(F.col("kind").isin(*kinds)), options)
        if part is not None:
            every = part if every is None else every.unionByName(part)
    return every.withColumn("ext_id", F.shiftleft(F.col("file_ord").cast("long"), 46) + F.col("ext_id"))


def _with_file(read, df: DataFrame, column: str, **more) -> DataFrame:
    """A reader's extractions with the file_ord of the row they came from."""
    packed = df.withColumn("__key", F.shiftleft(F.col("file_ord").cast("long"), 46) + F.col("__id"))
    ext = read(packed, "__key", column, **more)
    return ext.withColumn("file_ord", F.shiftright(F.col("ext_id"), 46).cast("int")).withColumn("ext_id", F.col("ext_id").bitwiseAND(F.lit(2**46 - 1)))


@reader("csv")
def delimited(spark: SparkSession, files: DataFrame, options: Any) -> DataFrame | None:
    """Files of one header, encoding and kind of quoting are read together; a file is cut into splits unless its quotes span lines."""
    rows = files.select("file_ord", "path", "head", "utf8", "multi").orderBy("file_ord").collect()  # the list of files
    alike: dict[tuple, list] = {}
    for r in rows:
        alike.setdefault((r["head"], r["utf8"], r["multi"]), []).append(r)
    every = None
    for (_, utf8, multi), own in alike.items():
        df = records.read_csv(spark, [r["path"] for r in own], bool(multi), "UTF-8" if utf8 else "ISO-8859-1")
        if len(own) == 1:
            df = df.withColumn("file_ord", F.lit(own[0]["file_ord"]))
        else:
            known = spark.createDataFrame([(r["path"], r["file_ord"]) for r in own], "path string, file_ord int").withColumn("__real", files_._real(F.col("path"))).drop("path")
            df = df.withColumn("__real", files_._real(F.col("__file"))).join(known, "__real").drop("__real")
        packed = df.withColumn("__key", F.shiftleft(F.col("file_ord").cast("long"), 46) + F.col("__row")).drop("__file", "__row", "file_ord")
        ext = records.from_rows(packed, "__key")
        ext = ext.withColumn("file_ord", F.shiftright(F.col("ext_id"), 46).cast("int")).withColumn("ext_id", F.col("ext_id").bitwiseAND(F.lit(2**46 - 1)))
        every = ext if every is None else every.unionByName(ext)
    return every


@reader("json")
def nested(spark: SparkSession, files: DataFrame, options: Any) -> DataFrame:
    text = files.select("file_ord", files_.decode(F.col("content")).alias("text"))
    return _with_file(records.from_json_records, records.unwrap(text, "text").withColumn("__id", F.col("rec_ord").cast("long")), "payload")


def _documents(files: DataFrame, source: str, contacts_only: bool) -> DataFrame:
    texts = records.document_texts(files).withColumn("__id", F.lit(0).cast("long"))
    return _with_file(records.from_text, texts, "text", source=source, contacts_only=contacts_only)


@reader("pdf")
def pdf(spark: SparkSession, files: DataFrame, options: Any) -> DataFrame:
    return _documents(files, "resume_pdf", False)


@reader("docx")
def docx(spark: SparkSession, files: DataFrame, options: Any) -> DataFrame | None:
    return _documents(files, "resume_docx", True) if options.text_documents else None


@reader("txt")
def txt(spark: SparkSession, files: DataFrame, options: Any) -> DataFrame | None:
    return _documents(files, "resume_pdf", False) if options.text_documents else None
