"""The best representative of each group of versions, field by field.

``survivors`` keeps, for each field, the version that wins an explicit order of trust, completeness and recency.
Every field is one max over a struct, so the whole operator is a single aggregation with map-side combine: a key
that holds a third of all rows is reduced before it is shuffled.

``truth.fuse`` is the probabilistic alternative for values that no order of trust settles.

Defined results: versions without a key are no group; a key with one row has nothing to decide; a field without a
usable version has no row; ties end at the smaller row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import is_stand_in, strip

#: Headings of sections and documents that readers take for a name or a headline, without case and marks.
HEADINGS = (
    "resume", "résumé", "resumé", "cv", "curriculum", "curriculum vitae", "vitae", "lebenslauf", "hoja de vida", "currículum", "currículo", "curriculo", "bewerbung", "anschreiben",
    "cover letter", "application", "job application", "candidature", "portfolio", "biodata", "bio data", "bio", "personal profile", "profile", "profil", "perfil", "professional profile", "candidate profile",
    "about", "about me", "about us", "summary", "professional summary", "executive summary", "career summary", "career objective", "objective", "resumen", "zusammenfassung",
    "experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history", "berufserfahrung", "werdegang", "experiencia", "experiencia laboral", "experiencia profesional", "expérience", "expériences", "expérience professionnelle", "expériences professionnelles", "experiência", "experiência profissional", "опыт работы", "резюме",
    "education", "academic background", "qualifications", "ausbildung", "bildung", "studium", "formation", "formación", "educación", "formação", "formação académica", "образование",
    "skills", "technical skills", "key skills", "core skills", "core competencies", "competencies", "kenntnisse", "fähigkeiten", "compétences", "habilidades", "competencias", "competências", "навыки",
    "contact", "contacts", "contact details", "contact information", "contact info", "personal details", "personal information", "personal data", "kontakt", "kontaktdaten", "persönliche daten", "contacto", "datos personales", "coordonnées", "контакты",
    "references", "referenzen", "references available on request", "languages", "sprachen", "idiomas", "langues", "interests", "hobbies", "projects", "projekte", "proyectos", "projets", "certificates", "certifications", "zertifikate", "publications", "awards", "achievements", "training", "courses", "volunteering", "motivation", "motivationsschreiben",
    "name", "full name", "headline", "title", "job title", "position", "table of contents", "contents", "inhalt", "page", "seite", "confidential", "vertraulich",
)
_PAGE = r"(?iu)^\W*(?:page|seite|página|pagina|pág|pag|pg|p|blatt|sheet|стр|страница)\W*\d+(?:\W*(?:of|von|de|sur|di|из|/)?\W*\d+)?\W*$|^\W*\d+\s*(?:/|of|von|de|sur)\s*\d+\W*$"
_FILE = r"(?iu)^\S(?:.*\S)?\.(?:pdf|docx?|odt|rtf|txt|md|tex|html?|pages|png|jpe?g|gif|csv|xlsx?|json|xml|zip)$"
_MAIL = r"(?iu)[^\s@]+@[^\s@]+\.[^\s@]+"
_LINK = r"(?iu)\bhttps?:|\bwww\.|\b(?:linkedin|github|gitlab|xing|twitter|facebook)\.[a-z]{2,}|\b[a-z0-9-]+\.(?:com|org|net|io|dev|me|eu|de|es|fr|uk|in|example|test)/"
_PHONE = r"^\W*(?:(?i:tel|phone|mobile|cell|fon|telefon|tél)\W*)?[+(]?\d[\d\s().\-/]{5,}\d(?:\s*(?i:ext)\.?\s*\d+)?\W*$"
_PHONE_IN = r"(?iu)\b(?:tel|phone|mobile|cell|telefon|tél|teléfono)\b\W*[+(]?\d|\+\d[\d\s().\-]{6,}\d|\(\d{2,4}\)\s?\d{3}|\b\d{3}[ .\-]\d{3}[ .\-]\d{4}\b"


def _no_text(c: Column) -> Column:
    v = strip(c)
    bare = F.regexp_replace(F.lower(v), r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    letters = F.regexp_replace(F.lower(v), r"(?U)\s+", "")
    run = letters.rlike(r"^(.)\1{2,}$")
    return c.isNull() | is_stand_in(c) | F.regexp_replace(bare, r"(?U)\s+", " ").isin(*HEADINGS) | v.rlike(_PAGE) | v.rlike(_FILE) | run


def usable_name(c: Column) -> Column:
    v = strip(c)
    return ~(_no_text(c) | v.rlike(_MAIL) | v.rlike(_LINK) | v.rlike(_PHONE) | ~v.rlike(r"\p{L}"))


def usable_headline(c: Column) -> Column:
    v = strip(c)
    return ~(_no_text(c) | v.rlike(_MAIL) | v.rlike(_LINK) | v.rlike(_PHONE) | v.rlike(_PHONE_IN) | ~v.rlike(r"\p{L}"))


def _trust(provenance: str, field: str, trust: dict[str, int]) -> Column:
    """The highest trust among the sources that a row names for a field, 0 if none."""
    clean = lambda c: F.lower(strip(c))
    of = F.create_map(*[F.lit(x) for pair in trust.items() for x in pair]) if trust else F.create_map().cast("map<string,int>")
    scores = F.transform(F.filter(F.col(provenance), lambda p: clean(p["field_name"]) == field), lambda p: F.coalesce(of[clean(p["source"])], F.lit(0)))
    return F.greatest(F.coalesce(F.array_max(scores), F.lit(0)), F.lit(0))


def trust_table(source_trust: DataFrame, most: int = 10_000) -> dict[str, int]:
    """The trust of each source; a table of more than ``most`` rows is no trust table and is refused."""
    rows = source_trust.where("source is not null and trust is not null").groupBy(F.lower(strip(F.col("source"))).alias("s")).agg(F.max("trust").alias("t")).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return {r["s"]: int(r["t"]) for r in rows}


def skill_pairs(skills: Column) -> Column:
    """The distinct pairs of skill name and source of a row, both trimmed and in lower case."""
    clean = lambda c: F.nullif(F.lower(strip(c)), F.lit(""))
    each = F.transform(skills, lambda s: F.transform(s["sources"], lambda x: F.struct(clean(s["name"]).alias("n"), clean(x).alias("s"))))
    flat = F.flatten(F.filter(each, lambda a: a.isNotNull()))
    return F.size(F.array_distinct(F.filter(F.coalesce(flat, F.array().cast("array<struct<n:string,s:string>>")), lambda p: p["n"].isNotNull() & p["s"].isNotNull())))


def survivors(df: DataFrame, trust: dict[str, int], key: str = "candidate_id", row: str = "result_id", time: str = "updated_at") -> DataFrame:
    """(key, field_name, row): the row that gives each field of a key with two or more rows."""
    last = [F.col(f"`{time}`").alias("t"), (-F.col(f"`{row}`")).alias("r")]
    words = F.size(F.split(strip(F.col("full_name")), r"(?U)\s+"))
    pairs = skill_pairs(F.col("skills"))
    ranks = {
        "full_name": F.when(usable_name(F.col("full_name")), F.struct(_trust("provenance", "full_name", trust).alias("a"), words.alias("b"), *last)),
        "headline": F.when(usable_headline(F.col("headline")), F.struct(_trust("provenance", "headline", trust).alias("a"), *last)),
        "skills": F.when(pairs > 0, F.struct(pairs.alias("a"), *last)),
    }
    best = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias(key), *[rank.alias(name) for name, rank in ranks.items()])
    best = best.groupBy(key).agg(F.count("*").alias("n"), *[F.max(name).alias(name) for name in ranks]).where("n >= 2")
    kept = F.inline(F.array(*[F.struct(F.lit(name).alias("field_name"), (-F.col(f"{name}.r")).alias(row)) for name in ranks]))
    return best.select(key, kept).where(F.col(row).isNotNull())
