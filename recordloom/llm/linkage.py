"""Rows of two tables that describe the same person, without a shared key, each with a confidence.

Many matching functions vote on every candidate pair, each with a few levels (agrees, nearly, silent, against).
A generative model learns from the votes alone how often each level occurs among matches and among others: a
two-class latent model fitted by expectation-maximisation on the counts of vote patterns.  Functions whose votes
depend on each other within the classes are merged into one joint function, so that agreeing twice for the same
reason counts once.  The posterior of a pair's pattern is its confidence.

Scale: candidates come from several blocking keys (hashes of mailboxes, phones, profiles, name with company or place,
initials with company and place).  The pairs of a key with many rows on both sides are spread over tasks by their
number and voted on within the join; those whose names are wholly different while at most one other function agrees
are counted there by their votes and not written.  Such a pair is no match under any key, and the model sees it in the
counts all the same; a pair that several keys have in common is met once.  So a key's size decides nothing, and which
keys are hot is told from one row in some, as it only chooses the way.  The model sees the patterns' counts: as many
rows as there are combinations of levels, whatever the data's size; it never sees pairs.

Defined results: a blank cell or stand-in is silent, never an agreement; repeated rows pair like any other row;
an empty table gives no pairs.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import emails_of, present, profile_key
from recordloom.runtime import checkpoint

#: Pairs of a blocking key, beyond which they are voted on where they meet, and how many of them one task takes.
HOT, SHARE = 4_000_000, 4_000_000
_ODD = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "s", "æ": "a", "œ": "o", "ı": "i", "þ": "t", "ħ": "h", "ŧ": "t", "ŋ": "n", "ĸ": "k"}
_BASE = {c: _ODD.get(c) or unicodedata.normalize("NFKD", c)[0] for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c.islower()}
_FROM, _TO = "".join(_BASE), "".join(_BASE.values())
_TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "phd", "md", "mba", "pmp", "msc", "bsc", "cpa", "eng", "ing", "jr", "sr", "ii", "iii", "iv", "he", "him", "she", "her", "they", "them", "sir", "herr", "frau", "don", "dona")
_FIRM = r"\b(?:ltd|limited|inc|incorporated|llc|gmbh|ag|s\.?\s?l\.?|s\.?\s?a\.?|b\.?\s?v\.?|n\.?\s?v\.?|ab|oy|as|plc|corp|co|company|pvt|pty|sarl|srl|spa|kg|se|lda|ltda|sas|kft|zrt|sro|aps|oyj|asa|pte|bhd|lp|llp)\b\.?"


def _plain(c: Column) -> Column:
    return F.translate(F.lower(c), _FROM, _TO)


def _words(c: Column, sep: str) -> Column:
    return F.filter(F.array_distinct(F.transform(F.split(F.coalesce(c, F.lit("")), sep), F.trim)), lambda w: w != "")


#: What is compared, in the order in which ``raw`` takes the columns.
RAW = ("name", "email", "phone", "linkedin", "company", "title", "location", "skills")


def raw(df: DataFrame, row: str, *columns: str) -> DataFrame:
    """id and the columns to compare, under one name each; columns of the same names in ``df`` do not clash."""
    return df.select(F.col(f"`{row}`").alias("id"), *[F.col(f"`{c}`").alias(n) for n, c in zip(RAW, columns, strict=True)])


def forms(same_skill: dict[str, str] | None = None, name: str = "name", email: str = "email", phone: str = "phone", linkedin: str = "linkedin", company: str = "company", title: str = "title", location: str = "location", skills: str = "skills") -> list[Column]:
    """The comparable forms of what a row says about a person; ``same_skill`` maps other names of a skill to one."""
    tokens = F.filter(_words(F.regexp_replace(_plain(present(F.col(name))), r"\([^)]*\)|'", ""), r"[^\p{L}]+"), lambda w: ~w.isin(*_TITLES))
    mails = F.transform(emails_of(F.col(email)), lambda m: F.regexp_replace(m, r"\+[^@]*@", "@"))
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(phone), F.lit("")), r"(?i)\s*ext.*$", ""), r"\D", "")
    firm = F.trim(F.regexp_replace(F.regexp_replace(_plain(present(F.col(company))), _FIRM, " "), r"[^\p{L}\p{N}]+", " "))
    parts = _words(F.regexp_replace(_plain(present(F.col(location))), r"\b(?:area|city centre|greater|district \d+|old town|north|metro|centre)\b", ""), r"""[,;|/\n()"\[\]']+|\s-\s""")
    known = _words(F.regexp_replace(_plain(present(F.col(skills))), r"[^\p{L}\p{N}+#,;|/\n\t•、()\[\]\"' ]", ""), r"""[,;|/\n\t•、()\[\]"']+""")
    known = F.transform(known, lambda w: F.trim(F.regexp_replace(F.regexp_replace(w, r"^(?:good|basic|experience with|core skills:|tools:)\s+|\s*(?:\(.*|- advanced| knowledge|[.*:]+)$", ""), r"[\s_-]+", " ")))
    if same_skill:
        names = F.create_map(*[F.lit(x) for pair in sorted(same_skill.items()) for x in pair])
        known = F.transform(known, lambda w: F.coalesce(names[w], w))
    return [
        F.array_sort(tokens).alias("name"),
        mails.alias("mails"),
        F.when(F.length(digits) >= 9, F.right(digits, F.lit(10))).alias("phone"),
        F.regexp_replace(profile_key(F.col(linkedin)), r"[^a-z0-9]", "").alias("profile"),
        F.nullif(firm, F.lit("")).alias("firm"),
        F.trim(F.regexp_replace(F.regexp_replace(_plain(present(F.col(title))), r"^(?:sr|senior|role:)\.?\s+", ""), r"\s+", " ")).alias("title"),
        parts.alias("places"),
        F.array_distinct(known).alias("skills"),
    ]


def same_skills(canon: DataFrame, most: int = 5_000) -> dict[str, str]:
    """Other names of the skills of a canonical list; a list of more than ``most`` entries is refused."""
    rows = canon.where("kind = 'skill' and label is not null").select("label", "aliases").take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} skills: put the canonical name in place of each skill first")
    clean = lambda w: " ".join(w.lower().replace("_", " ").replace("-", " ").split())
    return {clean(a): clean(r["label"]) for r in rows for a in [r["label"], *(r["aliases"] or [])] if a}


def _key_list() -> Column:
    """The hashed blocking keys of a row's forms."""
    key = lambda kind, *c: F.xxhash64(F.lit(kind), *c)
    local = lambda m: F.substring_index(m, "@", 1)
    none = F.array().cast("array<bigint>")
    full = F.when(F.size("name") >= 2, F.array_join("name", " "))
    initials = F.array_join(F.transform("name", lambda w: F.left(w, F.lit(1))), "")
    every = F.concat(
        F.transform("mails", lambda m: key("m", m)),
        F.transform(F.filter("mails", lambda m: F.length(local(m)) >= 6), lambda m: key("l", local(m))),
        F.array(
            F.when(F.col("phone").isNotNull(), key("p", F.col("phone"))),
            F.when(F.length("profile") > 3, key("k", F.col("profile"))),
            F.when(full.isNotNull() & F.col("firm").isNotNull(), key("f", full, F.col("firm"))),
        ),
        F.when(full.isNotNull(), F.transform("places", lambda x: key("c", full, x))).otherwise(none),
        # a typing error or a short form seldom changes how the parts of a name begin
        F.when(full.isNotNull() & F.col("firm").isNotNull(), F.transform("places", lambda x: key("i", initials, F.col("firm"), x))).otherwise(none),
    )
    return F.array_distinct(F.array_compact(every))


def _keys(rows: DataFrame) -> DataFrame:
    """(key, id): hashed blocking keys."""
    return rows.select("id", *forms()).select("id", F.explode(_key_list()).alias("key"))  # what no key needs is pruned


def _hot_keys(a: DataFrame, b: DataFrame, hot: int) -> DataFrame:
    """(key, tasks) of the keys with more than about ``hot`` pairs.

    One of the sides of such a key has the square root of that many rows; one row in ``step`` still shows many.
    """
    step = max(1, int(hot**0.5) // 64)
    some = lambda df, x, y: _keys(df.where(F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(step)) == 0)).select("key", F.lit(x).alias("x"), F.lit(y).alias("y"))
    pairs = F.col("x") * F.col("y") * F.lit(step * step)
    sizes = some(a, 1, 0).unionByName(some(b, 0, 1)).groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return sizes.where(pairs > hot).select("key", F.ceil(pairs / F.lit(SHARE)).alias("tasks"))


def _cold(a: DataFrame, b: DataFrame, many: DataFrame | None) -> DataFrame:
    """(a, b): the distinct pairs of rows that share a key which is not hot."""
    few = lambda rows, side: (_keys(rows) if many is None else _keys(rows).join(many, "key", "left_anti")).select("key", F.col("id").alias(side))
    return few(a, "a").join(few(b, "b"), "key").select("a", "b").distinct()


def _hot(a: DataFrame, b: DataFrame, many: DataFrame, same_skill: dict[str, str] | None) -> DataFrame:
    """(a, b, votes, n) of the pairs that share hot keys only, each once; hopeless ones are counted without a and b."""

    def spread(rows: DataFrame, side: str, place: str, task) -> DataFrame:
        said = rows.select("id", *forms(same_skill))
        said = said.select("id", F.struct(*said.columns[1:]).alias(side), _key_list().alias(f"{side}_keys"))
        own = _keys(rows).join(many, "key").groupBy("id").agg(F.collect_set(F.struct("key", "tasks")).alias("own"))
        each = said.join(own, "id").select(F.col("id").alias(place), side, f"{side}_keys", F.col("own.key").alias(f"{side}_hot"), F.inline("own"))
        return each.withColumn("task", task(F.col("tasks"))).drop("tasks")

    left = spread(a, "l", "a", lambda n: F.pmod(F.xxhash64("a"), n))
    right = spread(b, "r", "b", lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    common = F.array_intersect("l_hot", "r_hot")
    here = (F.col("key") == F.array_min(common)) & (F.size(common) == F.size(F.array_intersect("l_keys", "r_keys")))
    cast = votes()
    met = left.join(right, ["key", "task"]).where(here).select("a", "b", *[v.cast("tinyint").alias(n) for n, v in cast.items()])
    written = lambda c: F.when(~_hopeless([F.col(n) for n in cast if n != "v_name"], F.col("v_name")), F.col(c)).alias(c)
    return met.select(written("a"), written("b"), *cast).groupBy("a", "b", *cast).agg(F.count("*").alias("n"))


def candidates(a: DataFrame, b: DataFrame, hot: int = HOT, same_skill: dict[str, str] | None = None) -> DataFrame:
    """(a, b): the distinct pairs of rows (see ``raw``) that share a blocking key, without the hopeless ones that share hot keys only."""
    many = checkpoint(_hot_keys(a, b, hot))
    if many.isEmpty():
        return _cold(a, b, None)
    return _cold(a, b, many).unionByName(_hot(a, b, many, same_skill).where("a is not null").select("a", "b"))


def _hopeless(others: list[Column], name: Column) -> Column:
    """The names are wholly different and at most one other function agrees."""
    agreeing = F.lit(0)
    for v in others:
        agreeing = agreeing + (v > 0).cast("int")
    return (name <= -2) & (agreeing <= 1)


def _covers(small: Column, large: Column) -> Column:
    """Every token of one name stands in the other, whole or as an initial."""
    return F.forall(small, lambda s: F.exists(large, lambda t: (s == t) | ((F.length(s) == 1) & t.startswith(s)) | ((F.length(t) == 1) & s.startswith(t))))


def _near_tokens(small: Column, large: Column) -> Column:
    """As _covers, with a typing error or a short form (the beginning of the other) allowed in each token."""
    short = lambda s, t: (F.length(s) >= 3) & t.startswith(s)
    close = lambda s, t: (F.levenshtein(s, t) <= F.when(F.greatest(F.length(s), F.length(t)) >= 5, 2).when(F.greatest(F.length(s), F.length(t)) >= 4, 1).otherwise(0)) | short(s, t) | short(t, s)
    return F.forall(small, lambda s: F.exists(large, lambda t: (s == t) | ((F.length(s) == 1) & t.startswith(s)) | ((F.length(t) == 1) & s.startswith(t)) | close(s, t)))


def votes() -> dict[str, Column]:
    """The matching functions over columns l.* and r.*: small integers, 0 is silence, negative is against."""
    x, y = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    an, bn = x("name"), y("name")
    fewer, more = F.when(F.size(an) <= F.size(bn), an).otherwise(bn), F.when(F.size(an) <= F.size(bn), bn).otherwise(an)
    whole = lambda n: F.filter(n, lambda w: F.length(w) > 1)
    silent = lambda c: x(c).isNull() | y(c).isNull()
    none = lambda c: (F.size(x(c)) == 0) | (F.size(y(c)) == 0)
    local = lambda m: F.transform(m, lambda e: F.substring_index(e, "@", 1))
    common = F.size(F.array_intersect(x("skills"), y("skills")))
    return {
        "v_name": F.when((F.size(an) == 0) | (F.size(bn) == 0), 0)
        .when(an == bn, F.when(F.size(whole(an)) >= 2, 4).otherwise(2))
        .when(_covers(fewer, more), F.when(F.size(whole(fewer)) >= 2, 3).when(F.size(fewer) >= 2, 2).otherwise(1))
        .when(_near_tokens(fewer, more), F.when(F.size(whole(fewer)) >= 2, 3).otherwise(1))
        .when(F.arrays_overlap(whole(an), whole(bn)), -1)
        .otherwise(-2),
        "v_mail": F.when(none("mails"), 0).when(F.arrays_overlap(x("mails"), y("mails")), 2).when(F.arrays_overlap(local(x("mails")), local(y("mails"))), 1).otherwise(-1),
        "v_phone": F.when(silent("phone"), 0).when(x("phone") == y("phone"), 1).otherwise(-1),
        "v_profile": F.when(silent("profile"), 0).when(x("profile") == y("profile"), 1).otherwise(-1),
        "v_firm": F.when(silent("firm"), 0).when(x("firm") == y("firm"), 1).otherwise(-1),
        "v_place": F.when(none("places"), 0).when(F.arrays_overlap(x("places"), y("places")), 1).otherwise(-1),
        "v_title": F.when(silent("title"), 0).when((x("title") == y("title")) | (F.levenshtein(x("title"), y("title")) <= 2), 1).otherwise(-1),
        "v_skills": F.when(none("skills"), 0).when(common >= 0.5 * F.least(F.size(x("skills")), F.size(y("skills"))), 2).when(common > 0, 1).otherwise(-1),
    }


class LabelModel:
    """Two latent classes over vote patterns; ``groups`` are the functions that vote jointly."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, names: list[str], rounds: int = 100, dependent: float = 0.05, merges: int = 3) -> None:
        self.names, self.groups = names, [(k,) for k in range(len(names))]
        for _ in range(merges + 1):
            start = self._fit(patterns, counts, start, rounds)
            pair = self._most_dependent(patterns, counts, start, dependent)
            if pair is None:
                break
            self.groups = [g for g in self.groups if g not in pair] + [pair[0] + pair[1]]
        self.posterior = start

    def _codes(self, patterns: np.ndarray) -> list[np.ndarray]:
        return [np.unique(patterns[:, g], axis=0, return_inverse=True)[1].ravel() for g in self.groups]

    def _fit(self, patterns: np.ndarray, counts: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
        codes = self._codes(patterns)
        for _ in range(rounds):
            prior = (counts * p).sum() / counts.sum()
            log1, log0 = np.log(prior + 1e-12), np.log(1 - prior + 1e-12)
            for code in codes:
                n = code.max() + 1
                # one pseudo-count spread over the levels keeps an unseen level from deciding alone
                t1 = np.bincount(code, counts * p, n) + 1.0 / n
                t0 = np.bincount(code, counts * (1 - p), n) + 1.0 / n
                log1 = log1 + np.log(t1 / t1.sum())[code]
                log0 = log0 + np.log(t0 / t0.sum())[code]
            new = 1 / (1 + np.exp(np.clip(log0 - log1, -60, 60)))
            if np.abs(new - p).max() < 1e-6:
                return new
            p = new
        return p

    def _most_dependent(self, patterns: np.ndarray, counts: np.ndarray, p: np.ndarray, least: float):
        codes, best = self._codes(patterns), (least, None)
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                if len(self.groups[i]) + len(self.groups[j]) > 2:
                    continue
                mutual = 0.0
                for w in (counts * p, counts * (1 - p)):
                    joint = np.zeros((codes[i].max() + 1, codes[j].max() + 1))
                    np.add.at(joint, (codes[i], codes[j]), w)
                    joint /= max(joint.sum(), 1e-12)
                    outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                    mutual += w.sum() / counts.sum() * float((joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum())
                if mutual > best[0]:
                    best = (mutual, (self.groups[i], self.groups[j]))
        return best[1]


def _start(patterns: np.ndarray, names: list[str]) -> np.ndarray:
    """A first guess: the votes' plain majority, a contact and the name weighing most."""
    at = {n: patterns[:, k].astype(float) for k, n in enumerate(names)}
    score = 1.5 * at["v_name"] + 2.0 * np.maximum(at["v_mail"], 0) + 2.0 * at["v_phone"].clip(0) + 3.0 * at["v_profile"] + at["v_firm"] + at["v_place"] + 0.5 * at["v_title"] + 0.5 * at["v_skills"]
    score = np.where(at["v_name"] < 0, score - 8, score)
    return 1 / (1 + np.exp(-(score - 6.0)))


def link(a: DataFrame, b: DataFrame, same_skill: dict[str, str] | None = None, least: float = 0.5) -> DataFrame:
    """(a, b, confidence): the pairs of rows (see ``raw``) that are one person more likely than not."""
    many = checkpoint(_hot_keys(a, b, HOT))
    many = None if many.isEmpty() else many
    pairs = _cold(a, b, many)
    # the rows of the larger side meet their pairs as they are: only those that are in a pair are taken apart
    left = pairs.join(a.withColumnRenamed("id", "a"), "a").select("a", "b", F.struct(*forms(same_skill)).alias("l"))
    right = b.select(F.col("id").alias("b"), F.struct(*forms(same_skill)).alias("r"))
    cast = votes()
    names = list(cast)
    voted = left.join(right, "b").select("a", "b", *[v.cast("tinyint").alias(n) for n, v in cast.items()], F.lit(1).cast("long").alias("n"))
    voted = checkpoint(voted if many is None else voted.unionByName(_hot(a, b, many, same_skill)))
    rows = voted.groupBy(*names).agg(F.sum("n").alias("count")).collect()  # at most the product of the levels
    if not rows:
        return voted.select("a", "b", F.lit(0.0).alias("confidence"))
    patterns, counts = np.array([[r[n] for n in names] for r in rows]), np.array([float(r["count"]) for r in rows])
    model = LabelModel(patterns, counts, _start(patterns, names), names)
    spark = a.sparkSession
    table = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, model.posterior) if q > least], ", ".join(f"{n} tinyint" for n in names) + ", confidence double")
    hopeless = _hopeless([F.col(n) for n in names if n != "v_name"], F.col("v_name"))
    return voted.where("a is not null").join(F.broadcast(table.where(~hopeless)), names).select("a", "b", "confidence")
