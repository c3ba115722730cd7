"""Readers: delimited files, nested JSON, résumé text; each gives extractions of one shape."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import dims, resume
from recordloom.functions import normalize as N
from recordloom.functions.cells import strip
from recordloom.operators.schema import EDUCATION, EXPERIENCE, conform


def _clean_cell(c: Column) -> Column:
    """A cell without outer white space and wrapping quotes; null where nothing is left."""
    v = strip(F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'")))
    return F.nullif(v, F.lit(""))


def split_multi(c: Column, marks: str = ";,") -> Column:
    """The parts of a cell between any of ``marks``; one mark is split at without a regular expression."""
    one = F.translate(c, marks[1:], marks[0] * (len(marks) - 1)) if len(marks) > 1 else c
    parts = F.filter(F.transform(F.split(one, marks[0]), strip), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def place_parts(city: Column, region: Column, country: Column, whole: Column) -> dict[str, Column]:
    """Explicit parts of a place, or, where there are none, the parts of a place written in one."""
    parts = split_multi(whole, ",")
    none = F.coalesce(city, region, country).isNull()
    part = lambda k: F.get(parts, F.lit(k))
    return {
        "location_city": F.when(none, part(0)).otherwise(city),
        "location_region": F.when(none, part(1)).otherwise(region),
        "location_country": F.when(none, part(2)).otherwise(country),
    }


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """field -> column: the first alias that a header has wins; of equal headers the last."""
    by = {c.strip().lower(): c for c in columns}
    return {f: next(by[a] for a in names if a in by) for f, names in dims.HEADERS.items() if any(a in by for a in names)}


def from_rows(df: DataFrame, id_col: str, source: str = "csv", file_col: str | None = None, lists: bool = False) -> DataFrame:
    """Extractions from rows whose columns are named in any of the known ways; all-blank rows are left out.

    With ``lists`` the columns experience and education hold lists of entries that are taken over as they are.
    """
    given = {c: F.col(c) if lists else F.array().cast(t) for c, t in (("experience", EXPERIENCE), ("education", EDUCATION))}
    at = resolve_headers([c for c in df.columns if c not in (id_col, file_col)])
    cell = lambda f: _clean_cell(F.col(f"`{at[f]}`").cast("string")) if f in at else F.lit(None).cast("string")
    filled = F.coalesce(*[_clean_cell(F.col(f"`{c}`").cast("string")) for c in at.values()]) if at else F.lit(None)
    name = F.coalesce(cell("full_name"), F.nullif(F.concat_ws(" ", cell("first_name"), cell("last_name")), F.lit("")))
    mails = split_multi(cell("email"))
    return conform(
        df.where(filled.isNotNull()), ext_id=F.col(f"`{id_col}`"), source_name=F.lit(source), source_file=F.col(f"`{file_col}`") if file_col else F.lit(None), full_name=name, emails=mails, phones=split_multi(cell("phone")),
        company=cell("company"), title=cell("title"), skills=split_multi(cell("skills"), ";,|"), linkedin=cell("linkedin"), github=cell("github"), 
        warnings=F.when(name.isNull() & (F.size(mails) == 0), F.array(F.lit("neither name nor mail"))), is_valid=F.lit(True), **given, **place_parts(cell("location_city"), cell("location_region"), cell("location_country"), cell("location")),
    )


def read_csv(spark: SparkSession, paths: list[str], multi_line: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Delimited files of one header, everything as text; quotes are doubled, with ``multi_line`` records may span lines.

    __file is the file's path, __row numbers the rows of a file in their order (with gaps).
    """
    df = spark.read.csv(
        paths, header=True, multiLine=multi_line, encoding=encoding, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=False, mode="PERMISSIVE", maxCharsPerColumn=-1
    )
    # the place of a split in units of 2 MB, then the row in its task
    row = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 21), 27) + F.monotonically_increasing_id().bitwiseAND(F.lit(2**27 - 1))
    return df.select("*", F.col("_metadata.file_path").alias("__file"), row.alias("__row"))


def key_map(json_text: Column) -> Column:
    """map<string,string> of a JSON object with keys in lower case; nested values stay JSON."""
    entries = F.map_entries(F.from_json(json_text, "map<string,string>"))
    fresh = F.array().cast("array<struct<key:string,value:string>>")

    def step(acc: Column, e: Column) -> Column:  # of keys that differ in case only the last wins
        low = F.lower(e["key"])
        return F.concat(F.filter(acc, lambda o: o["key"] != low), F.array(F.struct(low.alias("key"), e["value"].alias("value"))))

    return F.map_from_entries(F.aggregate(entries, fresh, step))


def first_key(m: Column, names: list[str]) -> Column:
    """The value of the first of the names that has one."""
    return F.coalesce(*[m[n] for n in names])


def text_list(value: Column) -> Column:
    """A list that came as JSON array or as one separated text; nulls are dropped, objects give their name."""
    items = F.from_json(value, "array<string>")
    name = lambda x: F.coalesce(F.get_json_object(x, "$.name"), x)
    listed = F.filter(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: strip(F.when(x.startswith("{"), name(x)).otherwise(x))), lambda x: x != "")
    return F.when(value.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(split_multi(value))


def _entries(value: Column, keys: dict[str, list[str]], kind: str) -> Column:
    """Entries of a list of objects, texts or lines in one shape."""
    from pyspark.sql import types as T

    names = [f.name for f in T._parse_datatype_string(kind).elementType.fields]

    def of(text: Column, m: Column | None) -> Column:
        joined = lambda v: F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), "\n")).otherwise(strip(v))
        return F.struct(*[(joined(first_key(m, keys[n])) if m is not None and n in keys else text if n == "summary" else F.lit(None)).cast("string").alias(n) for n in names])

    items = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull() & (strip(x) != ""))
    none = F.lit(None).cast("string")
    # the inner transform binds the map of an entry, so that it is built once and not once per field
    listed = F.transform(items, lambda x: F.when(x.startswith("{"), F.element_at(F.transform(F.array(key_map(x)), lambda m: of(none, m)), 1)).otherwise(of(strip(x), None)))
    rows = F.transform(F.filter(F.transform(F.split(value, r"\r?\n"), strip), lambda x: x != ""), lambda x: of(x, None))
    return F.when(value.isNull(), F.array().cast(kind)).when(value.startswith("["), listed).otherwise(rows).cast(kind)


def from_json_records(df: DataFrame, id_col: str, payload: str, source: str = "ats_json", file_col: str | None = None) -> DataFrame:
    """Extractions from one JSON object per row, whatever its keys are called."""
    rows = df.withColumn("__m", key_map(F.col(f"`{payload}`"))).withColumn("__l", key_map(first_key(F.col("__m"), dims.KEYS["location"])))
    m = F.col("__m")
    val = lambda f: F.nullif(strip(first_key(m, dims.KEYS[f])), F.lit(""))
    inside = lambda f: F.nullif(strip(first_key(F.col("__l"), dims.KEYS[f])), F.lit(""))
    name = F.coalesce(val("full_name"), F.nullif(F.concat_ws(" ", val("first_name"), val("last_name")), F.lit("")))
    lists = {f: F.coalesce(text_list(first_key(m, dims.KEYS[f])), F.array().cast("array<string>")) for f in ("emails", "phones", "skills")}
    whole = F.when(~val("location").startswith("{"), val("location"))
    place = place_parts(F.coalesce(val("location_city"), inside("location_city")), F.coalesce(val("location_region"), inside("location_region")), F.coalesce(val("location_country"), inside("location_country")), whole)
    return conform(
        rows, ext_id=F.col(f"`{id_col}`"), source_name=F.lit(source), source_file=F.col(f"`{file_col}`") if file_col else F.lit(None), full_name=name, company=val("company"), title=val("title"), linkedin=val("linkedin"), github=val("github"),
        experience=_entries(first_key(m, dims.KEYS["experience"]), dims.EXPERIENCE_KEYS, EXPERIENCE), education=_entries(first_key(m, dims.KEYS["education"]), dims.EDUCATION_KEYS, EDUCATION),
        warnings=F.when(name.isNull() & (F.size(lists["emails"]) == 0), F.array(F.lit("neither name nor mail"))), is_valid=F.lit(True), **lists, **place,
    )


def unwrap(df: DataFrame, text: str) -> DataFrame:
    """(…, rec_ord, payload): the records of a JSON text that is an object, an array, or an object that wraps one."""
    m = F.from_json(F.col(text), "map<string,string>")
    wrapped = F.coalesce(*[F.when(m[w].startswith("["), m[w]) for w in dims.WRAPPERS])
    records = F.when(F.ltrim(F.col(text)).startswith("["), F.from_json(F.col(text), "array<string>")).when(wrapped.isNotNull(), F.from_json(wrapped, "array<string>")).otherwise(F.array(F.col(text)))
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(records).alias("rec_ord", "payload"))
    return rows.where(F.ltrim("payload").startswith("{"))


def from_text(df: DataFrame, id_col: str, text: str, source: str = "resume_pdf", file_col: str | None = None, contacts_only: bool = False) -> DataFrame:
    """Extractions from free text, one per row; a blank text is an invalid extraction with a warning."""
    fields = resume.person(F.col(f"`{text}`"))
    if contacts_only:
        fields = {k: v for k, v in fields.items() if k in ("full_name", "emails", "phones", "linkedin", "github")}
    blank = F.coalesce(strip(F.col(f"`{text}`")) == "", F.lit(True))
    shown = {k: F.when(~blank, v) for k, v in fields.items()}
    return conform(df, ext_id=F.col(f"`{id_col}`"), source_name=F.lit(source), source_file=F.col(f"`{file_col}`") if file_col else F.lit(None), warnings=F.when(blank, F.array(F.lit("no text"))), is_valid=~blank, **shown)


def _docx_text(content: bytes | None) -> str | None:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in body.iter(f"{word}p"))


def _pdf_text(content: bytes | None) -> str | None:
    try:
        import pdfplumber
    except ImportError:  # an optional reader: without it a PDF gives an invalid extraction
        return None
    try:
        with pdfplumber.open(io.BytesIO(content or b"")) as pdf:
            return "\n".join(page.extract_text() or "" for page in pdf.pages)
    except Exception:  # noqa: BLE001 - a broken file is an invalid extraction, not a failed job
        return None


def document_texts(files: DataFrame) -> DataFrame:
    """file_ord, path, kind, text of PDF, DOCX and plain-text files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, contents = b.column("kind").to_pylist(), b.column("content").to_pylist()
            texts = [_docx_text(c) if k == "docx" else _pdf_text(c) for k, c in zip(kinds, contents)]
            yield pa.RecordBatch.from_arrays([b.column("file_ord"), b.column("path"), b.column("kind"), pa.array(texts, pa.string())], names=["file_ord", "path", "kind", "text"])

    from recordloom.sources.files import decode

    binary = files.where("kind in ('pdf', 'docx')").select("file_ord", "path", "kind", "content").mapInArrow(read, "file_ord int, path string, kind string, text string")
    return binary.unionByName(files.where("kind = 'txt'").select("file_ord", "path", "kind", decode(F.col("content")).alias("text")))
