"""Source files: what is there, what kind it is, whether it can be read, and which are the same file twice."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"csv": "csv", "json": "json", "pdf": "pdf", "docx": "docx", "txt": "txt"}
MANY_COLUMNS = 100


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_ord, path, name, length, kind, what speaks against each file, and what its reader needs.

    Delimited files are looked at line by line where they lie (header, first row, encoding, whether quotes span
    lines, and a digest of the lines), so they may be of any size; of the other kinds the content is read, which is
    one record or document a file.  Only the list of paths is on the driver.
    """
    sizes = [_size(spark, p) for p in paths]
    wanted = spark.createDataFrame([(i, p, p.rsplit("/", 1)[-1], n) for i, (p, n) in enumerate(zip(paths, sizes))], "file_ord int, path string, name string, length bigint")
    wanted = wanted.withColumn("real", _real(F.col("path")))
    there = [p for p, n in zip(paths, sizes) if n]
    lined = [p for p in there if p.lower().endswith(".csv")]
    whole = [p for p in there if not p.lower().endswith(".csv")]
    wanted = wanted.join(_lines(spark, lined), "real", "left") if lined else wanted.select("*", *[F.lit(None).cast(t).alias(n) for n, t in _LINED.items()])
    if whole:
        content = spark.read.format("binaryFile").load(whole).select(_real(F.col("path")).alias("real"), "content")
        wanted = wanted.join(content, "real", "left")
    else:
        wanted = wanted.withColumn("content", F.lit(None).cast("binary"))
    pages = _pages(wanted) if any(p.lower().endswith(".pdf") for p in whole) else None
    wanted = wanted.join(pages, "file_ord", "left") if pages is not None else wanted.withColumn("pages", F.lit(None).cast("int"))
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    wanted = wanted.withColumn("digest", F.coalesce(F.md5("content"), F.col("digest")))
    return wanted.withColumn("kind", F.when(ext.isin(*KINDS), ext)).withColumn("warnings", _warnings()).drop("real")


def _real(path: Column) -> Column:
    """A path as all readers write it."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


_LINED = {"head": "string", "first": "string", "utf8": "boolean", "multi": "boolean", "digest": "string"}


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of each delimited file its first two lines that are not blank, whether all is UTF-8, whether quotes span lines, a digest."""
    rows = spark.read.text(paths).select(_real(F.col("_metadata.file_path")).alias("real"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"), "value")
    odd = F.length(F.regexp_replace("value", r'[^"]', "")) % 2 == 1
    # a file whose lines are those of another holds the same records, so their order is no part of the digest
    digest = F.concat_ws("-", F.count("*"), F.bit_xor(F.xxhash64("value")), F.sum(F.xxhash64("value", F.lit(1)).cast("decimal(38,0)")))
    all_ = rows.groupBy("real").agg(F.min(F.is_valid_utf8("value")).alias("utf8"), F.max(odd).alias("multi"), digest.alias("digest"))
    # the first two lines that are not blank; the window keeps two rows a file and task before anything is shuffled
    nth = F.row_number().over(Window.partitionBy("real").orderBy("at", "nth"))
    two = rows.where(F.trim("value") != "").withColumn("n", nth).where("n <= 2").groupBy("real").agg(F.max(F.when(F.col("n") == 1, F.col("value"))).alias("head"), F.max(F.when(F.col("n") == 2, F.col("value"))).alias("first"))
    two = two.withColumn("head", F.regexp_replace("head", "^\ufeff", ""))
    return all_.join(two, "real", "left")


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a regular file, null where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    status = fs.getFileStatus(hadoop)
    return status.getLen() if status.isFile() else None


def _pages(files: DataFrame) -> DataFrame:
    """file_ord, pages of each PDF: -1 where it cannot be opened, -2 where no library can look."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_pdf_pages(c) for c in b.column(1).to_pylist()], pa.int32())], names=["file_ord", "pages"])

    return files.where(F.lower("name").endswith(".pdf") & F.col("content").isNotNull()).select("file_ord", "content").mapInArrow(count, "file_ord int, pages int")


def _pdf_pages(content: bytes) -> int:
    try:
        import pdfplumber
    except ImportError:
        return -2 if content.startswith(b"%PDF-") else -1
    try:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return len(pdf.pages)
    except Exception:  # noqa: BLE001 - a broken file is a warning, not a failed job
        return -1


def decode(content: Column) -> Column:
    """Text of a file: a byte-order mark is dropped, and what is no UTF-8 is read as Latin-1."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def _warnings() -> Column:
    text = decode(F.col("content"))
    parsed = F.try_parse_json(text)
    shape = F.schema_of_variant(parsed)
    width = lambda line: F.size(F.split(F.regexp_replace(line, r'"[^"]*"', ""), ","))
    head, first, kind = F.col("head"), F.col("first"), F.col("kind")
    return F.array_compact(F.array(
        F.when(F.col("length").isNull(), F.lit("CRITICAL: file not found")),
        F.when(F.col("length") == 0, F.lit("CRITICAL: file is empty")),
        F.when(kind.isNull(), F.lit("CRITICAL: unknown file type")),
        F.when((kind == "json") & (F.col("length") > 0) & parsed.isNull(), F.lit("CRITICAL: not valid JSON")),
        F.when((kind == "json") & F.try_validate_utf8(F.col("content").cast("string")).isNull() & F.col("content").isNotNull(), F.lit("CRITICAL: not valid UTF-8")),
        F.when((kind == "json") & ~(shape.startswith("ARRAY") | shape.startswith("OBJECT")), F.lit("JSON root is neither object nor array")),
        F.when((kind == "json") & F.trim(text).rlike(r"^(?:\[\s*\]|\{\s*\})$"), F.lit("JSON is empty")),
        F.when((kind == "csv") & (F.col("length") > 0) & head.isNull(), F.lit("CRITICAL: no header row")),
        F.when((kind == "csv") & (width(head) > MANY_COLUMNS), F.lit("unusually many columns")),
        F.when((kind == "csv") & head.isNotNull() & first.isNull(), F.lit("header only")),
        F.when((kind == "csv") & (width(first) != width(head)), F.lit("first row and header differ in width")),
        F.when(F.col("pages") == -1, F.lit("CRITICAL: PDF cannot be opened")),
        F.when(F.col("pages") == 0, F.lit("PDF has no pages")),
        F.when(F.col("pages") == -2, F.lit("PDF was not looked into: no library for it")),
    ))


def usable(files: DataFrame) -> DataFrame:
    """The files without a critical warning, each content once (the first path wins)."""
    kept = files.where(~F.exists("warnings", lambda w: w.startswith("CRITICAL:")))
    once = kept.withColumn("nth", F.row_number().over(Window.partitionBy("digest", "length").orderBy("file_ord")))
    return once.where("nth = 1").drop("nth")


def file_warnings(files: DataFrame) -> DataFrame:
    return files.select(F.lit("source").alias("stage"), F.col("path").alias("ref"), F.posexplode("warnings").alias("seq", "message"))


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row (by ``order``) of each distinct value, by aggregation rather than by sorting whole groups."""
    rest = [c for c in df.columns if c != order]
    best = df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__r"), F.min(order).alias(order))
    return best.select(order, "__r.*")
