"""What free text says about a person: contacts, name, headline, sections and their entries, as column expressions.

A text is taken apart into lines once; sections are slices between header positions and entries are array folds,
so a document of any length is one row of one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.cells import strip

# Patterns that decide what counts as a contact, a header or a range of dates.
MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{2,4}\)?[\s\-.]?)?\d{3,4}[\s\-.]?\d{3,4}"
LINKEDIN = r"(?iU)(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-%.]+/?"
GITHUB = r"(?iU)(?:https?://)?(?:www\.)?github\.com/[\w\-%.]+/?"
LOCATION = r"(?<city>[A-Z][a-zA-Z\s]+),\s*(?<region>[A-Z]{2}|[A-Za-z\s]+)(?:,\s*(?<country>[A-Za-z\s]+))?"
_SKILLS = r"skills|technical\s+skills|technologies|core\s+competencies|areas?\s+of\s+expertise"
_WORK = r"experience|work\s+experience|employment(?:\s+history)?|professional\s+experience|career\s+history|history|work"
_STUDY = r"education|academic(?:\s+background)?|qualifications|degrees?|scholastic"
_REST = r"projects?|certifications?|awards?|publications?|interests|hobbies|references?|summary|objective|profile|about(?:\s+me)?|personal\s+information|languages?|volunteer(?:ing)?|achievements?"
HEADER = {name: rf"(?i)^\s*(?:{words})\s*:?\s*$" for name, words in {"skills": _SKILLS, "experience": _WORK, "education": _STUDY, "any": "|".join([_SKILLS, _WORK, _STUDY, _REST])}.items()}
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
RANGE = rf"(?i)({_MONTH}\s+\d{{4}}|\d{{4}})\s*[\-–—to]+\s*({_MONTH}\s+\d{{4}}|\d{{4}}|present|current)"
NOT_NAMES = ("resume", "cv", "curriculum vitae", "profile")
SEPARATORS = (" at ", " @ ", " – ", " - ", ", ")


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")


def mails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MAIL), F.lit(0)))


def phones(text: Column) -> Column:
    """Phone-like runs of 7 to 15 digits, in their order, once each."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), strip)
    return F.array_distinct(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(7, 15)))


def link(text: Column, pattern: str) -> Column:
    return _none(F.regexp_extract(text, pattern, 0))


def location(text: Column) -> dict[str, Column]:
    part = lambda k: _none(strip(F.regexp_extract(text, LOCATION, k)))
    return {"location_city": part(1), "location_region": part(2), "location_country": part(3)}


def _contact(line: Column, phone_too: bool = True) -> Column:
    is_contact = line.rlike(f"^(?:{MAIL})$") | line.startswith("http") | line.contains("@")
    return is_contact | line.rlike(f"^(?:{PHONE})$") if phone_too else is_contact


def _divider(line: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.replace(line, F.lit(" "), F.lit("")), ""))) <= 1


def _name_like(line: Column, phone_too: bool = True) -> Column:
    letters = F.length(F.regexp_replace(line, r"(?U)[^\p{L}\s]", ""))
    return (line != "") & ~_contact(line, phone_too) & ~F.lower(line).isin(*NOT_NAMES) & ~_divider(line) & (F.length(line) <= 60) & (letters > 0.7 * F.length(line))


def name(text: Column) -> Column:
    """The first line that reads like a name."""
    return F.get(F.filter(F.transform(lines(text), strip), lambda x: _name_like(x)), F.lit(0))


def headline(text: Column) -> Column:
    """The next line after the name that is no contact; null if that is a section header."""
    own = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    at = F.array_position(F.transform(own, lambda x: _name_like(x, False)), True)
    after = F.filter(F.slice(own, (at + 1).cast("int"), F.greatest(F.size(own), F.lit(1))), lambda x: ~_contact(x) & ~_divider(x))
    first = F.get(after, F.lit(0))
    return F.when((at > 0) & ~first.rlike(HEADER["any"]), first)


def section(text: Column, which: str) -> Column:
    """The lines from the first header of a kind to the next other header."""
    own = F.transform(lines(text), strip)
    at = F.array_position(F.transform(own, lambda x: x.rlike(HEADER[which])), True)
    rest = F.slice(own, (at + 1).cast("int"), F.greatest(F.size(own), F.lit(1)))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(HEADER["any"]) & ~x.rlike(HEADER[which])), True)
    inside = F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)
    return F.when(at > 0, F.filter(inside, lambda x: ~x.rlike(HEADER[which]))).otherwise(F.array().cast("array<string>"))


def skills(text: Column) -> Column:
    marks = "•●▪◦-–— \t"
    parts = F.flatten(F.transform(section(text, "skills"), lambda x: F.split(x, r"[,|;•●▪◦\-–—]\s*")))
    return F.filter(F.transform(parts, lambda p: F.btrim(strip(p), F.lit(marks))), lambda p: (p != "") & (F.length(p) < 80))


def experience(text: Column) -> Column:
    """array<struct<company,title,start_date,end_date,summary>>: every line with a range of dates opens an entry."""
    headed = section(text, "experience")
    own = lines(text)
    first = F.array_position(F.transform(own, lambda x: x.rlike(RANGE)), True)
    tail = F.slice(own, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(own), F.lit(1)))
    stop = F.array_position(F.transform(tail, lambda x: x.rlike(HEADER["any"])), True)
    loose = F.when(first > 0, F.when(stop > 0, F.slice(tail, 1, (stop - 1).cast("int"))).otherwise(tail)).otherwise(F.array().cast("array<string>"))
    chosen = F.filter(F.transform(F.when(F.size(headed) > 0, headed).otherwise(loose), strip), lambda x: x != "")
    kind = "array<struct<head:string,body:array<string>>>"
    nothing = F.array().cast(kind)

    def step(acc: Column, line: Column) -> Column:
        fresh = F.concat(acc, F.array(F.struct(line.alias("head"), F.array().cast("array<string>").alias("body"))))
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["head"].alias("head"), F.concat(last["body"], F.array(line)).alias("body"))))
        return F.when(line.rlike(RANGE), fresh).when(F.size(acc) > 0, longer).otherwise(acc)

    def entry(e: Column) -> Column:
        head = strip(F.btrim(strip(F.regexp_replace(e["head"], RANGE, "")), F.lit("|–—-,")))
        title, company = _none(head), F.lit(None).cast("string")
        for sep in reversed(SEPARATORS):  # the first of them that occurs decides
            has = head.contains(sep)
            title = F.when(has, strip(F.substring_index(head, sep, 1))).otherwise(title)
            company = F.when(has, strip(F.substr(head, F.instr(head, sep) + len(sep)))).otherwise(company)
        return F.struct(
            company.alias("company"),
            title.alias("title"),
            F.regexp_extract(e["head"], RANGE, 1).alias("start_date"),
            F.regexp_extract(e["head"], RANGE, 2).alias("end_date"),
            _none(F.array_join(e["body"], "\n")).alias("summary"),
        )

    return F.transform(F.aggregate(chosen, nothing, step), entry)


def education(text: Column) -> Column:
    """array<struct<institution,degree,field_of_study,year>>: blocks of lines between blank lines."""
    own = F.transform(section(text, "education"), strip)
    blocks = F.filter(F.split(F.array_join(own, "\n"), r"\n(?:\n)+|^\n+|\n+$"), lambda b: strip(b) != "")

    def entry(block: Column) -> Column:
        rows = F.filter(F.split(block, "\n"), lambda x: x != "")
        second = F.get(rows, F.lit(1))
        inside = r"(?i)^(.+?)\s+in\s+(.+)"
        return F.struct(
            F.get(rows, F.lit(0)).alias("institution"),
            F.when(second.rlike(inside), strip(F.regexp_extract(second, inside, 1))).otherwise(second).alias("degree"),
            F.when(second.rlike(inside), strip(F.regexp_extract(second, inside, 2))).alias("field_of_study"),
            _none(F.regexp_extract(block, r"\b(?:19|20)\d{2}\b", 0)).alias("year"),
            F.lit(None).cast("string").alias("summary"),
        )

    return F.transform(blocks, entry)


def person(text: Column) -> dict[str, Column]:
    """All fields of a text under the names of an extraction."""
    return {
        "full_name": name(text), "headline": headline(text), "emails": mails(text), "phones": phones(text), "linkedin": link(text, LINKEDIN), "github": link(text, GITHUB),
        "skills": skills(text), "experience": experience(text), "education": education(text), **location(text),
    }
