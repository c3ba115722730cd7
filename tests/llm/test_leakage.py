"""Leaks: the suffix array and the exact look against brute force, and what must not change a row."""

import random

import numpy as np

from recordloom.llm import leakage

WORDS = [f"{a}{b}" for a in ("bor", "kel", "min", "tas", "ver", "zul", "pom", "dra", "hic", "lon") for b in ("ad", "em", "ix", "ok", "un", "ar", "is", "et")]


def passage(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize()


def texts(rng, sizes):
    return [[rng.choice(WORDS[:12]) for _ in range(n)] for n in sizes]


def test_suffix_array_and_longest_matches():
    rng = random.Random(4)
    items = leakage.Items([(i, " ".join(w)) for i, w in enumerate(texts(rng, (40, 25, 3, 30)))])
    docs = texts(rng, (60, 0, 2, 90, 33)) + [items.words[0] + ["other"] + items.words[1], items.words[0]]
    row, begin, _ = leakage.as_row(items.vocab, docs)
    at = np.flatnonzero((row[:-2] > 0) & (row[1:-1] > 0) & (row[2:] > 0))
    at = at[np.isin(items.key(row, at), items.suffix_key)]
    sa = leakage.suffix_array(items, row, at)
    after = lambda r, p: tuple(r[p : p + items.longest].tolist())
    upto = lambda t: t[: t.index(0)] if 0 in t else t
    assert sorted(sa.tolist()) == at.tolist()
    whole = [upto(after(row, p)) for p in sa]
    assert all(a[: len(b)] <= b for a, b in zip(whole, whole[1:]) if a != b)
    longest, where = leakage.bisect(items, row, sa)

    def same(i, j):
        n = 0
        while items.row[i + n] > 0 and items.row[i + n] == row[j + n]:
            n += 1
        return n

    for i, n, j in zip(items.suffix, longest, where):
        assert n == max(same(i, p) for p in at) and (n < 3 or same(i, j) == n)
    hits = {tuple(map(int, h)) for part in leakage._matches(items, row, begin) for h in zip(*part)}
    brute = set()
    for d, doc in enumerate(docs):
        for t, own in enumerate(items.words):
            for x in range(len(own)):
                for y in range(len(doc)):
                    n = 0
                    while x + n < len(own) and y + n < len(doc) and own[x + n] == doc[y + n]:
                        n += 1
                    if n >= 3 and not (x and y and own[x - 1] == doc[y - 1]):
                        brute.add((d, t, x, y, n))
    assert hits == brute


def stretch(item, doc, diagonal):
    """The exact look, word by word."""
    best, weight, first = (0, 0, 0), 0, 0
    for k, word in enumerate(item):
        p = k + diagonal
        kept = p + 4 > 0 and (word in doc[max(0, p - 3) : p + 4] or any(leakage._alike(word, other) for other in doc[max(0, p - 1) : max(0, p + 2)]))
        weight += 1 if kept else leakage.LOST
        if weight <= 0:
            weight, first = 0, k + 1
        elif weight > best[0]:
            best = (weight, first, k)
    return best


def test_exact_look_against_word_by_word():
    rng = random.Random(8)
    spoil = lambda w: w if rng.random() < 0.7 else rng.choice((w[1:], w[::-1], w + "x", "7", w[0] + "q" + w[2:], ""))
    items = leakage.Items([(i, " ".join([*w, "19", "a"])) for i, w in enumerate(texts(rng, (50, 21, 80)))])
    docs = [[x for x in map(spoil, own) if x] for own in items.words] + [texts(rng, (5,))[0], ["19"] * 30]
    shard = leakage.Shard(items, docs)
    cases = [(d, t, g) for d in range(len(docs)) for t in range(3) for g in (-90, -30, -4, -1, 0, 1, 2, 5, 60)]
    got = leakage.align(items, shard, *(np.array(c) for c in zip(*cases)))
    assert [tuple(map(int, g)) for g in zip(*got)] == [stretch(items.words[t], docs[d], g) for d, t, g in cases]


def found(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id bigint, text string").repartition(2)
    return sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(df, tests, **more).collect())


def test_passages_that_many_items_carry(spark):
    rng = random.Random(3)
    items, docs, want = [], [], []
    for n in (1, 4, 10):  # so many items ask about one passage, each its own question
        text = f"{passage(rng, 30)}. {passage(rng, 25)}."
        docs.append((n, f"{passage(rng, 15)}. {text} {passage(rng, 15)}."))
        for k in range(n):
            number = 100 * n + k
            items.append((number, f"{'Use only the passage to answer. ' if k % 2 else ''}{text} Who is {WORDS[k]} of {WORDS[n]} and {WORDS[k + 20]}?"))
            want.append((n, number))
    items += [(900 + k, f"Use only the passage to answer. {passage(rng, 40)}. What is the name?") for k in range(8)] + [items[0], (950, None), (951, "")]
    docs += [(50, "Use only the passage to answer. What is the name? " + passage(rng, 50)), (51, None)]
    assert found(spark, docs, items) == sorted(want)
    assert found(spark, docs, items, block=150) == sorted(want)


def test_a_long_shared_instruction_is_no_passage_in_any_block(spark):
    rng = random.Random(6)
    frame = f"Read this. {passage(rng, 24)}."
    items = [(k, f"{frame} {passage(rng, 30)}. Is it so?") for k in range(6)]
    docs = [(1, f"{frame} {passage(rng, 20)}."), (2, items[3][1])]
    for block in (20_000_000, 300):
        assert found(spark, docs, items, block=block) == [(2, 3)]


def test_a_passage_repeated_at_many_places_is_found(spark):
    rng = random.Random(7)
    own = passage(rng, 40).lower().split()
    bits = [" ".join(own[k : k + 6]) for k in range(0, 36, 6)]
    text = " ".join(" ".join([b, passage(rng, 3 + k)]) for k in range(12) for b in bits) + " " + " ".join(own)
    assert found(spark, [(1, text), (2, " ".join(" ".join([b, passage(rng, 9)]) for b in bits))], [(5, " ".join(own))]) == [(1, 5)]


def test_wide_vocabularies_are_cut(monkeypatch):
    rows = [(k, f"{passage(random.Random(k), 30)}") for k in range(9)]
    monkeypatch.setattr(leakage, "WIDEST", 60)
    assert sorted(i for part in leakage.blocks_of(rows) for i in part.ids) == list(range(9))
