"""The uniform texts: equal exactly for texts that look the same, however repairs reach the workers."""

import random

from recordloom.llm import lookalike


def swapped(rng, text, rate):
    back = {}
    for a, b in lookalike.LOOK_ALIKE.items():
        back.setdefault(b, []).append(a)
    return "".join(rng.choice(back[c]) if c in back and rng.random() < rate else c for c in text)


def test_uniform_texts_are_equal_exactly_for_equal_looks(spark):
    rng = random.Random(1)
    plain = ["The cost of hope is a joke", "Москва и рост цен", "a", "I", "résumé of José", "αβγ και Ω", "cop", "role: 5 kg", "", "Zoë’s “naïve” café"]
    texts = plain + [swapped(rng, t, r) for t in plain for r in (0.3, 1.0) for _ in range(2)] + [None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, look string").repartition(3)
    few = {r["doc_id"]: r["uniform_text"] for r in lookalike.uniform(df).collect()}
    many = {r["doc_id"]: r["uniform_text"] for r in lookalike.uniform(df, few=0).collect()}
    assert few == many and len(few) == len(texts)
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            if x is not None and y is not None:
                assert (few[i] == few[j]) == (lookalike.skeleton(x) == lookalike.skeleton(y)), (x, y)
    assert few[texts.index(None)] is None
    assert few[0] == plain[0] and few[1] == plain[1] and few[9] == plain[9]
    assert lookalike.uniform(df.limit(0)).count() == 0


def test_documents_keep_to_their_script(spark):
    rows = [(1, "cop cop cop on the beat"), (2, "сор из избы"), (3, "сoр из избы"), (4, "сор on the beat"), (5, "x" * 200_000 + "е")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["uniform_text"] for r in lookalike.uniform(df).collect()}
    assert got[2] == got[3] == "сор из избы" and got[4] == "cop on the beat" and got[1] == rows[0][1]


def test_members_of_classes(spark):
    df = spark.createDataFrame([(3, "sаme"), (1, "same"), (2, "same"), (4, "other"), (5, "other"), (6, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in lookalike.members(df).collect()} == {(1, 1), (2, 1), (3, 1)}
