"""The operators for training data against brute force on small inputs, and on hard inputs."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F
from recordloom.llm import canon, components, leakage, linkage, lookalike, pack, survivor, truth

# ------------------------------------------------------------------ components


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for x in list(parent):
        groups[find(x)].append(x)
    return {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 6000 + k) for k in range(300)]
    df = spark.createDataFrame([*pairs, *pairs[:20], (None, 3), (7, 7)], "u bigint, v bigint")
    got = {r["v"]: r["group_key"] for r in components.groups(df).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]])
    assert components.groups(df.limit(0)).count() == 0


def test_pair_ids_and_shared_tokens(spark):
    df = spark.createDataFrame([(" A ", "b", 1), ("B", "c", 2), (None, "z", 3), ("d", "D ", 4)], "left_id string, right_id string, u int")
    got = {r["v"]: r["group_key"] for r in components.groups(components.pair_edges(df, "left_id", "right_id")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}
    rows = spark.createDataFrame([(i, ["hot"]) for i in range(2000)] + [(5000, ["x"]), (5001, ["x", None]), (5002, None)], "u bigint, toks array<string>")
    star = components.shared_token_edges(rows, "u", F.col("toks"))
    assert star.count() == 2000  # linear in the rows of a hot token
    assert {r["group_key"] for r in components.groups(star).collect()} == {0, 5000}


# ------------------------------------------------------------------ look-alikes


def look(text):
    text = "".join(c for c in text if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F)
    text = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text)
    return "".join(lookalike.LOOK_ALIKE.get(c, c) for c in unicodedata.normalize("NFKD", text))


TEXTS = ["Café noir", "Café noir", "Cafе́ noir", "Ｃafé noir", "Café noir", "Ca​fé nοir", "cafe noir", "Cafe noir", "Café noir ", "", "", None, "о", "o", "СОР", "COP", "ё", "ë", "x" * 100_000, "x" * 100_000 + "​", "2²", "22", "ﬁn", "fin"]  # noqa: RUF001


def test_pairs_against_brute_force(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, "e", b"k") for i, t in rows], "doc_id bigint, text string, look_key string, raw_key binary").repartition(3)
    got = sorted((r[0], r[1]) for r in lookalike.same_look_pairs(df).collect())
    assert got == [(a, b) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and x != y and look(x) == look(y)]
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0


def test_hot_copies_pair_only_with_variants(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.lit("sаme text")).otherwise(F.lit("same text")).alias("text"))
    pairs = lookalike.same_look_pairs(df)
    assert pairs.count() == 2 * 2998


def test_script_aware_repair(spark):
    df = spark.createDataFrame([(1, "the role is open"), (2, "thе rоle is оpen"), (3, "Москва role"), (4, "xzеq")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["uniform_text"] for r in lookalike.uniform(df).collect()}
    assert got == {1: "the role is open", 2: "the role is open", 3: "Москва role", 4: "xzеq"}


# ------------------------------------------------------------------ leakage

WORDS = [f"{a}{b}" for a in ("bor", "kel", "min", "tas", "ver", "zul", "pom", "dra", "hic", "lon") for b in ("ad", "em", "ix", "ok", "un", "ar", "is", "et")]


def passage(rng, n=70):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, f"Use only the passage to answer. {passage(rng).capitalize()}. What is it?") for i in range(12)]
    own = {i: leakage.words_of(t.split(". ")[1]) for i, t in items}
    docs, truth_ = [], set()

    def noisy(words, rate):
        return [w if rng.random() > rate else rng.choice((w[::-1][:1] + w[1:], w[0] + w[2] + w[1] + w[3:], w.upper())) for w in words]

    for d in range(200):
        body = [passage(rng, 40)]
        if d % 4 == 0:
            i, n = rng.randrange(12), rng.choice((10, 12, 26, 40, 70))
            at = rng.randrange(0, 71 - n)
            piece = noisy(own[i][at : at + n], 0.1)
            body.append(rng.choice((" ", ", ", "\n", " <p>")).join(piece))
            if n >= 26:
                truth_.add((d, i))
        if d % 5 == 0:
            body.append("Use only the passage to answer. What is it?")
        docs.append((d, ". ".join([*body, passage(rng, 30)]), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, items[0][1], "x"), (903, items[0][1], "x"), (904, (passage(rng, 20_000) + " " + items[1][1]), "x")]
    truth_ |= {(902, 0), (903, 0), (904, 1)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(5)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    rows = leakage.leaks(df, tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == truth_
    assert len(rows) == len(truth_)
    whole = next(r for r in rows if r["doc_id"] == 902)
    assert whole["longest"] >= 70 and whole["item_from"] == 0
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, tests, block=2000).collect()} == truth_
    assert leakage.clean(df, tests).count() == len(docs) - len({d for d, _ in truth_})
    assert leakage.leaks(df.limit(0), tests).count() == 0 and leakage.leaks(df, tests.limit(0)).count() == 0


def test_words_ignore_layout():
    assert leakage.words_of("The Ｃa​fé-\nteria, <b>Nо</b>&nbsp;5") == ["the", "cafeteria", "no", "5"]


# ------------------------------------------------------------------ packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_each_slot_once(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, 101), 40)}
    slots, used = pack.plan(counts, 100)
    room, seen = defaultdict(int), set()
    for n, c in counts.items():
        first = np.array([s[0] for s in slots[n]])
        for rank in range(c):
            k = np.searchsorted(first, rank, "right") - 1
            box, place = slots[n][k][1] + rank - slots[n][k][0], slots[n][k][2]
            assert (box, place) not in seen
            seen.add((box, place))
            room[box] += n
    assert max(room.values()) <= 100 and len(room) == used
    boxes = []  # the same strategy document by document
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [k for k, free in enumerate(boxes) if free >= n]
        if fits:
            boxes[min(fits, key=lambda k: boxes[k])] -= n
        else:
            boxes.append(100 - n)
    assert used <= len(boxes) * 1.02 + 1


def test_packing_holds_every_token(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice((0, 1, 5, 50, 200)))) for _ in range(300)] + ["same text"] * 200 + [None, "", "word " * 3000, "é" * 5000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, rank int").repartition(4)
    rows = pack.pack(df, capacity=256, per_bucket=90).collect()
    sizes = {r["id"]: r["n"] for r in pack.token_counts(df).collect()}
    per, boxes = defaultdict(int), defaultdict(list)
    for r in rows:
        per[r["doc_id"]] += r["n_tokens"]
        boxes[r["container"]].append(r)
    assert dict(per) == sizes and len({(r["doc_id"], r["part"]) for r in rows}) == len(rows)
    for box, own in boxes.items():
        assert sum(r["n_tokens"] for r in own) <= 256
        assert sorted(r["ord"] for r in own) == list(range(1, len(own) + 1)), box
    assert all(sum(1 for r in rows if r["doc_id"] == d) == 1 for d in sizes if sizes[d] <= 256)
    assert pack.pack(df.limit(0)).count() == 0


def test_token_counts_follow_the_public_pattern(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = tiktoken.Encoding("own2", pat_str=pack.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ["I'm  here,\n\n you're\t 12 €", "  a  b   ", "don't 'stop", "ß é\n", ""]:
        assert ours.encode_ordinary(t) == public.encode_ordinary(t)


# ------------------------------------------------------------------ canonical values

ENTRIES = [
    (1, "skill", "JavaScript", ["js", "java script"], None, None), (2, "skill", "Java", [], None, None), (3, "skill", "Scala", None, None, None), (4, "skill", "Machine Learning", ["ml"], None, None),
    (11, "location", "Cordoba, Spain", ["Córdoba, Spain"], "Andalusia", "Spain"), (12, "location", "Cordoba, Argentina", [], "Cordoba Province", "Argentina"), (13, "location", "Munich, Germany", ["München, Germany"], "Bavaria", "Germany"),
]
CANON = "canon_id int, kind string, label string, aliases array<string>, region_name string, country string"
MEANT = {
    "skill": {"JS": 1, "javascritp": 1, "good Java_Script knowledge": 1, "java (5 yrs)": 2, "scla": 0, "machine learnig - advanced": 4, "Java island guiding": 0, "n/a": 0, "x" * 5000: 0},
    "location": {"Cordoba": 0, "CORDOBA (ES)": 11, "Argentina / Cordoba": 12, "Córdoba, AR": 12, "munchen area": 13, "Munihc, DE": 13, "Bavaria, Germany": 0, "Munich, France": 0, "Spain": 0, "Remote": 0},
}


@pytest.mark.parametrize("shard", [50_000, 2])
def test_meant_entries(spark, shard):
    values = spark.createDataFrame([(i, kind, v) for i, (kind, v) in enumerate((k, v) for k, own in MEANT.items() for v in own)], "far_id bigint, kind string, val string")
    entries = spark.createDataFrame(ENTRIES, CANON)
    got = {(r["kind"], r["val"]): r["canon_id"] for r in canon.match(values, entries, shard).collect()}
    if shard > 10:
        assert got == {(k, v): c for k, own in MEANT.items() for v, c in own.items()}
    else:  # shards cannot see each other's ties, only their winners
        assert all(got["skill", v] == c for v, c in MEANT["skill"].items())
    assert canon.match(values.limit(0), entries).count() == 0


def brute(a, b):
    """Unrestricted Damerau-Levenshtein by search over edits, for short words."""
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if i == 0 or j == 0:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for m in range(1, j):
                if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                    best = min(best, d(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return d(len(a), len(b))


def test_tree_returns_all_near_forms():
    rng = random.Random(9)
    forms = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(150)]
    forest = canon.BKForest(forms)
    for _ in range(60):
        q = "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9)))
        for most in (0, 1, 2):
            assert {f for _, f in forest.within(q, most)} == {f for f in forms if brute(q, f) <= most}


# ------------------------------------------------------------------ linkage


def people(spark, rows):
    return linkage.raw(spark.createDataFrame(rows, "id bigint, n string, e string, p string, l string, c string, t string, w string, s string"), "id", *"neplctws")


def test_linkage_tells_households_from_people(spark):
    rng = random.Random(11)
    firsts, lasts = ["anna", "boris", "celine", "dmitri", "elena", "farid", "greta", "hugo"], [f"{w}son" for w in WORDS]
    a, b, same = [], [], set()
    for k in range(400):
        f, l = rng.choice(firsts), rng.choice(lasts)
        mail, phone, firm, place, skills = f"{f}{k}@x.org", f"555{rng.randrange(10**7):07d}", f"Firm {rng.randrange(60)}", rng.choice(("Oslo", "Lima", "Kyiv")), "; ".join(rng.sample(WORDS, 4))
        a.append((k, f"{f} {l}".title(), mail, phone, None, firm, "Clerk", place, skills))
        if k % 2 == 0:
            b.append((1000 + k, f"{l.title()}, {f.title()}", rng.choice((mail.upper(), "n/a")), f"+44 {phone}", None, firm, "clerk", place, skills))
            same.add((k, 1000 + k))
        if k % 10 == 1:  # another one of the household: same phone, place and surname
            other = rng.choice([x for x in firsts if x != f])
            b.append((3000 + k, f"{other} {l}".title(), f"{other}{k}x@x.org", phone, None, f"Firm {rng.randrange(60, 99)}", "Pilot", place, "; ".join(rng.sample(WORDS, 4))))
    b.append((9000, None, None, None, None, None, None, None, None))
    got = linkage.link(people(spark, a), people(spark, b)).collect()
    assert {(r["a"], r["b"]) for r in got} == same
    assert all(0.5 < r["confidence"] <= 1 for r in got)
    assert linkage.link(people(spark, a[:0] or [(0, *[None] * 8)]), people(spark, b)).count() == 0


def test_hot_keys_are_split_without_loss(spark):
    name = lambda i: f"{WORDS[i % 50]} {WORDS[i % 80]}{WORDS[i // 8]}"
    a = people(spark, [(i, name(i), "shared@x.org", None, None, None, None, None, None) for i in range(300)])
    b = people(spark, [(1000 + i, name(i), "shared@x.org", None, None, None, None, None, None) for i in range(300)])
    pairs = {(r["a"], r["b"]) for r in linkage.candidates(a, b, hot=100).collect()}
    assert {(i, 1000 + i) for i in range(300)} <= pairs and len(pairs) < 300 * 20


def test_hot_keys_keep_what_cold_keys_keep(spark):
    mail, firm = "shared@x.org", "Foo"
    row = lambda i, name, **more: (i, name, *[more.get(c) for c in ("email", "phone", "linkedin", "company", "title", "location", "skills")])
    a = people(spark, [row(1, "Katherine Johnson", email=mail), row(2, "Peter Novak", email=mail), row(3, None, email=mail), row(4, "Maria Silva", company=firm), row(5, "Maria Silva", company=firm, skills="js"), row(6, "Old Name", email=mail, phone="5551234567"), row(7, "Ulf Berg", email=mail)])
    b = people(spark, [row(11, "Kathrine Jonson", email=mail), row(12, "P. N.", email=mail), row(13, "Someone Else", email=mail), row(14, "Maria Silva", company=firm, skills="SQL"), row(15, "Maria Silva", company=firm, skills="javascript"), row(16, "Wed Newly", email=mail, phone="5551234567")])
    found = lambda hot: {(r["a"], r["b"]) for r in linkage.candidates(a, b, hot, {"js": "javascript"}).collect()}
    hot, cold = found(2), found(10**6)
    assert hot >= {(1, 11), (2, 12), (3, 13), (4, 14), (4, 15), (5, 15), (6, 16)}
    assert hot <= cold and (7, 13) in cold - hot


# ------------------------------------------------------------------ survivors


def test_survivors_follow_the_order(spark):
    schema = "candidate_id string, result_id bigint, full_name string, headline string, skills array<struct<name:string,confidence:double,sources:array<string>>>, provenance array<struct<field_name:string,source:string,method:string>>, updated_at timestamp_ntz"
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    prov = lambda s: [("full_name", s, "m"), ("headline", s, "m")]
    rows = [
        ("a", 1, "Ann Lee", "Dev", [("x", 0.1, ["csv", "CSV "])], prov("csv"), t[0]),
        ("a", 2, "Ann M Lee", "Dev 2", [("x", 0.1, ["csv", "b"])], prov("csv"), None),
        ("a", 3, "RESUME", "Page 2", None, prov("linkedin"), t[2]),
        ("b", 4, None, "N/A", [], None, None),
        ("b", 5, "a@b.co", "x | github.com/y", [(None, 0.1, ["csv"])], prov("csv"), t[1]),
        ("c", 6, "Solo", "Dev", None, None, t[0]),
        ("d", 8, "Tie Tie", "Same", None, None, t[0]), ("d", 7, "Tie Two", "Same", None, None, t[0]),
        (None, 9, "X Y", "Z", None, None, None), (None, 10, "X Y", "Z", None, None, None),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("n", F.lit(1)).withColumn("t", F.lit(2))
    got = {(r[0], r[1]): r[2] for r in survivor.survivors(df, {"linkedin": 5, "csv": 2}).collect()}
    assert got == {("a", "full_name"): 2, ("a", "headline"): 1, ("a", "skills"): 2, ("d", "full_name"): 7, ("d", "headline"): 7}
    assert survivor.survivors(df.limit(0), {}).count() == 0


def test_fusion_finds_truth_and_copiers(spark):
    rng = random.Random(2)
    said = []
    for o in range(300):
        right = f"v{o}"
        good = {s: right if rng.random() < 0.8 else f"w{o}-{rng.randrange(20)}" for s in ("s1", "s2", "s3", "s4", "s5")}
        bad = right if rng.random() < 0.3 else f"w{o}-{rng.randrange(20)}"
        said += [(f"o{o}", "f", v, v, s) for s, v in good.items()] + [(f"o{o}", "f", bad, bad, s) for s in ("bad", "copy1", "copy2")]
    df = spark.createDataFrame(said, "object string, field string, k string, value string, source string")
    best, accuracy, copying = truth.fuse(df)
    right = best.where(F.col("value") == F.concat(F.lit("v"), F.substring("object", 2, 9))).count()
    assert right > 270 and min(accuracy[s] for s in ("s1", "s2", "s3")) > accuracy["bad"]
    assert copying["bad", "copy1"] > 0.9 and copying["s1", "s2"] < 0.5
    assert truth.fuse(df.limit(0))[0].count() == 0


def test_fusion_covers_skills_and_values_without_a_source(spark, tmp_path):
    from recordloom.llm import queries

    schema = "candidate_id string, full_name string, headline string, skills array<struct<name:string,confidence:double,sources:array<string>>>, provenance array<struct<field_name:string,source:string,method:string>>"
    prov = lambda *s: [("full_name", x, "m") for x in s]
    rows = [
        ("a", "Ann Lee", None, [("js", 0.1, ["csv", "ats"]), ("JavaScript ", 0.1, ["csv"]), ("SQL", 0.1, ["csv"]), ("Go", 0.1, None), ("n/a", 0.1, ["csv"])], prov("csv", "ats")),
        ("a", "Wrong Name", None, None, None),
        ("b", "Bo Roe", "Dev", None, None),
        ("c", "Cy Dee", None, [], prov(" ", None)),
        (None, "No Key", "Dev", [("SQL", 0.1, ["csv"])], prov("csv")),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/result_with_pdfs.parquet")
    got = {(r[0], r[1], r[2]): r[3] for r in queries.p3_fused(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", "full_name", "Ann Lee"), ("b", "full_name", "Bo Roe"), ("b", "headline", "Dev"), ("c", "full_name", "Cy Dee"), ("a", "skills", "JavaScript"), ("a", "skills", "SQL"), ("a", "skills", "Go")}
    assert got["b", "full_name", "Bo Roe"] < 0.5 < got["a", "full_name", "Ann Lee"]
    assert got["a", "skills", "Go"] < got["a", "skills", "SQL"] <= got["a", "skills", "JavaScript"]
