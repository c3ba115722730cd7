"""The shapes of extractions and profiles."""

EXPERIENCE = "array<struct<company:string,title:string,start_date:string,end_date:string,summary:string>>"
EDUCATION = "array<struct<institution:string,degree:string,field_of_study:string,year:string,summary:string>>"
#: One row per record of a source, whatever it looked like.
EXTRACTION = {
    "ext_id": "bigint", "source_name": "string", "source_file": "string", "full_name": "string", "emails": "array<string>", "phones": "array<string>", "company": "string", "title": "string",
    "headline": "string", "location_city": "string", "location_region": "string", "location_country": "string", "skills": "array<string>", "experience": EXPERIENCE, "education": EDUCATION,
    "linkedin": "string", "github": "string", "total_years_experience": "double", "warnings": "array<string>", "is_valid": "boolean",
}
PROFILE = """candidate_id string, full_name string, emails array<string>, phones array<string>, location struct<city:string,region:string,country:string>,
links struct<linkedin:string,github:string,portfolio:string,other:array<string>>, headline string, total_years_experience double,
skills array<struct<name:string,confidence:double,sources:array<string>>>, experience array<struct<company:string,title:string,start:string,end:string,summary:string>>,
education array<struct<institution:string,degree:string,field:string,end_year:int>>, provenance array<struct<field:string,source:string,method:string>>, overall_confidence double"""


def conform(df, **given):
    """``df`` with exactly the columns of an extraction; ``given`` columns by name, the rest null."""
    from pyspark.sql import functions as F

    return df.select(*[(given[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in EXTRACTION.items()])


def profile_schema() -> str:
    """The shape of a profile as Spark's JSON schema, for whoever serves it."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(PROFILE.replace("\n", " ")).json()
