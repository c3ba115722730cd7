"""Which keys are hot chooses the way of their pairs and nothing else."""

import random

from recordloom.llm import linkage

COLUMNS = "id bigint, n string, e string, p string, l string, c string, t string, w string, s string"


def test_counts_and_confidences_do_not_depend_on_hot_keys(spark, monkeypatch):
    rng = random.Random(11)
    first, last = ["Kajeto", "Rimuna", "Solvei", "Tabore", "Wendeli", "Yorick"], ["Brandova", "Castelon", "Dormuth", "Eklundi", "Farquet"]

    def person(i):
        own = f"{rng.choice(first)} {rng.choice(last)}", rng.choice(["front.desk@x.org", "office.all@x.org", f"own.{i}@x.org"]), f"55512{i % 40:05d}"
        return (*own, None, f"Firm {i % 3}", None, rng.choice(["Oslo", "Lima"]), None)

    everyone = [person(i) for i in range(60)]
    table = lambda start: linkage.raw(spark.createDataFrame([(start + k, *p) for k, p in enumerate(everyone)], COLUMNS), "id", *"neplctws")
    a, b, real, model, seen = table(0), table(1000), linkage._hot_keys, linkage.LabelModel, []
    monkeypatch.setattr(linkage, "LabelModel", lambda patterns, counts, *more: seen.append({(*map(int, p), int(n)) for p, n in zip(patterns, counts)}) or model(patterns, counts, *more))

    def found(hot):
        monkeypatch.setattr(linkage, "_hot_keys", lambda x, y, _: real(x, y, hot))
        return {(r["a"], r["b"]): round(r["confidence"], 9) for r in linkage.link(a, b).collect()}

    none, some, most = found(10**9), found(300), found(2)
    assert len(none) >= 60 and any(p[0] == -2 for p in seen[0])
    assert none == some == most
    assert seen[0] == seen[1] == seen[2]
