"""The queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.cells import STAND_INS, emails_of, profile_key
from recordloom.llm import canon, components, leakage, linkage, lookalike, pack, survivor, truth
from recordloom.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version to keep of each field of each candidate with several."""
    return survivor.survivors(table(spark, sf_dir, "result_with_pdfs"), survivor.trust_table(table(spark, sf_dir, "source_trust")))


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable name and headline of each candidate and each of its skills, with their posteriors."""
    versions = table(spark, sf_dir, "result_with_pdfs")
    best = truth.fuse(truth.names_and_headlines(versions))[0].unionByName(truth.fuse(truth.skill_claims(versions))[0])
    field = F.when(F.col("field").startswith("skill:"), F.lit("skills")).otherwise(F.col("field"))
    return best.select(F.col("object").alias("candidate_id"), field.alias("field_name"), "value", F.round("posterior", 6).alias("posterior"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a candidates row and a student row of one person."""
    return p4_confidence(spark, sf_dir).select("ext_id_a", "ext_id_b")


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with the model's confidence."""
    same = linkage.same_skills(table(spark, sf_dir, "canon_values"))
    a = linkage.raw(table(spark, sf_dir, "candidates"), "ext_id", "name", "email", "phone", "linkedin", "current_company", "title", "location", "skills")
    b = linkage.raw(table(spark, sf_dir, "student1_english"), "ext_id", "name", "email", "phone", "linkedin", "company", "title", "location", "skills")
    return linkage.link(a, b, same).select(F.col("a").alias("ext_id_a"), F.col("b").alias("ext_id_b"), F.round("confidence", 6).alias("confidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the canonical list that each typed value means, 0 where none is meant."""
    people, merged, entries = table(spark, sf_dir, "student1_english"), table(spark, sf_dir, "result_with_pdfs"), table(spark, sf_dir, "canon_values")
    values = canon.typed_values(people, "student1_english", "ext_id", "skills", "skill", F.split("skills", ","))
    for field in ("title", "location"):
        values = values.unionByName(canon.typed_values(people, "student1_english", "ext_id", field, field, F.array(field)))
    values = values.unionByName(canon.typed_values(merged, "result_with_pdfs", "result_id", "skills.name", "skill", F.col("skills.name")))
    return canon.match(canon.unlabelled(values, entries), entries).select("src_table", "row_id", "field_name", "pos", "canon_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every record that decided pairs or shared mailboxes and profiles link to another."""
    pairs = table(spark, sf_dir, "match_pairs").where("decision = 'match'")
    one = components.groups(components.pair_edges(pairs, "left_id", "right_id")).select(F.lit("result_with_pdfs").alias("src_table"), F.col("v").alias("rec_key"), "group_key")
    tag = lambda kind, c: F.concat(F.lit(kind), c)
    tokens = F.array_compact(F.concat(F.transform(emails_of(F.col("email")), lambda e: tag("e:", e)), F.array(tag("l:", profile_key(F.col("linkedin"))))))
    people = table(spark, sf_dir, "student1_english")
    two = components.groups(components.shared_token_edges(people, "ext_id", tokens)).select(
        F.lit("student1_english").alias("src_table"), F.col("v").cast("string").alias("rec_key"), F.col("group_key").cast("string").alias("group_key")
    )
    return one.unionByName(two)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container and a place in it for every document, 2,048 tokens to a container."""
    return pack.pack(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items that leaked into them."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that leak nothing."""
    return leakage.clean(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items")).select("doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look the same but are not the same characters."""
    return lookalike.same_look_pairs(table(spark, sf_dir, "documents"))


def p10_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in one readable form."""
    return lookalike.uniform(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_fused": p3_fused, "p4_found": p4_found, "p4_confidence": p4_confidence, "p5_found": p5_found, "p6_found": p6_found, "p8_packed": p8_packed, "p9_found": p9_found, "p9_clean": p9_clean, "p10_found": p10_found, "p10_uniform": p10_uniform}

def _p6_sql() -> str:
    mail = r"regexp_extract(lower(email), '([^\s<>\"''()\[\],;:@]+@[^\s<>\"''()\[\],;:@]+\.[^\s<>\"''()\[\],;:@.]{2,})', 1)"
    profile = r"regexp_extract(lower(linkedin), 'linkedin\.[a-z.]+/(?:[a-z]{2}/)?(?:in|pub|profile)/+([^/?#\s]+)', 1)"
    clean = lambda c: f"lower(trim({c}, ' ' || chr(9) || chr(10)))"
    return (
        f"with recursive p as (select {clean('left_id')} as u, {clean('right_id')} as v from match_pairs where decision = 'match'), "
        f"t as (select ext_id, 'e' || {mail} as k from student1_english where {mail} <> '' union all select ext_id, 'l' || {profile} from student1_english where {profile} not in ('', 'me')), "
        "s as (select 's' || ext_id as u, 's' || min(ext_id) over (partition by k) as v from t), "
        "e as (select u, v from p where u <> v union select v, u from p where u <> v union select u, v from s where u <> v union select v, u from s where u <> v), "
        "r(a, b) as (select u, u from e union select r.a, e.v from r join e on e.u = r.b), "
        "g as (select a, min(b) as least, min(case when a like 's%' then substr(b, 2)::bigint end) as least_id from r group by a) "
        "select case when least_id is null then 'result_with_pdfs' else 'student1_english' end as src_table, case when least_id is null then a else substr(a, 2) end as rec_key, case when least_id is null then least else least_id::varchar end as group_key from g"
    )


def _p3_sql() -> str:
    quote = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    rx = lambda p: p.replace("(?iu)", "(?i)").replace("'", "''")
    ws = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
    strip = lambda c: f"trim({c}, {ws})"

    def usable(c: str, more: tuple[str, ...]) -> str:
        v = strip(c)
        low, tight = f"lower({v})", f"regexp_replace(lower({v}), '\\s+', '', 'g')"
        bare = f"regexp_replace(regexp_replace({low}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '\\s+', ' ', 'g')"
        tests = [f"{low} in ('', {quote(STAND_INS)})", f"not regexp_matches({low}, '\\p{{L}}')", f"{bare} in ({quote(survivor.HEADINGS)})", f"length({tight}) >= 3 and replace({tight}, left({tight}, 1), '') = ''"]
        tests += [f"regexp_matches({v}, '{rx(p)}')" for p in (survivor._PAGE, survivor._FILE, survivor._MAIL, survivor._LINK, survivor._PHONE, *more)]
        return f"{c} is not null and not ({' or '.join(tests)})"

    trust = lambda f: f"greatest(coalesce(list_max(list_transform(list_filter(provenance, lambda p: lower(trim(p.field_name)) = '{f}'), lambda p: coalesce(t[lower(trim(p.source))], 0))), 0), 0)"
    pairs = "len(list_distinct(list_filter(flatten(list_transform(list_filter(skills, lambda k: k.sources is not null), lambda k: list_transform(k.sources, lambda x: {'n': lower(" + strip("k.name") + "), 's': lower(" + strip("x") + ")}))), lambda q: q.n <> '' and q.s <> '')))"
    order = "updated_at desc nulls last, result_id"
    pick = lambda f, ok, by: f"select candidate_id, '{f}' as field_name, result_id from (select *, row_number() over (partition by candidate_id order by {by} {order}) as nth from r where {ok}) where nth = 1"
    return (
        "with tm as (select map(list(lower(trim(source))), list(trust)) as t from source_trust), r as (select result_with_pdfs.*, t from result_with_pdfs, tm where candidate_id in (select candidate_id from result_with_pdfs group by 1 having count(*) >= 2)) "
        + pick("full_name", usable("full_name", ()), f"{trust('full_name')} desc, len(regexp_split_to_array({strip('full_name')}, '\\s+')) desc,")
        + " union all " + pick("headline", usable("headline", (survivor._PHONE_IN,)), f"{trust('headline')} desc,")
        + " union all " + pick("skills", f"{pairs} > 0", f"{pairs} desc,")
    )


#: SQL on whole tables where SQL can say it; the other operators are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {"p3_found": _p3_sql(), "p6_found": _p6_sql()}
