"""Texts that look the same though their characters differ, brought to one form.

Compatibility forms, separate accents, invisible characters and odd spaces are folded everywhere.  Look-alike letters
are repaired word by word: all spellings of the corpus that look the same are one word of its vocabulary, and a word is
written as the spelling that keeps to one script, first to the script that dominates the document, then to the one the
corpus writes most.  A word whose spelling no other shares stays as it is, so foreign words stay intact.

A repair of mixed-script words alone would leave a word whose every letter was swapped; here the spelling depends on
nothing but the look of the word and of the document (its script is told by letters that look like no other), so two
texts get the same uniform text exactly if they look the same.

Scale: two narrow passes over the texts.  The first gathers the spellings, counted per task before they are shuffled;
only words that have several spellings go back to the texts, broadcast if they are counted to be few, else by a join.
``same_look_pairs`` shuffles 16-byte keys of the uniform texts.  ``members`` gives the class of each document and
``same_look_pairs`` pairs the texts of a class before their copies; the pairs asked for are as many as they are.

Defined results: null texts look like nothing and pair with nothing; the empty text is a text like any other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.runtime import checkpoint

#: Letters of other scripts (Cyrillic, Greek, Armenian, Cherokee, phonetic) and the Latin letter they look like.
LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏѵοϲϳɡɑαικρυ"
        "АВЕКМНОРСТУХІЈЅӀԚԜԌѴ"
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿνҮүօոսհց"
        "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ",
        "aeopcyxijshdqwlvocjgaaikpu" "ABEKMHOPCTYXIJSIQWGV" "ABEZHIKMNOPTYXJvYyonuhg" "ABCDEHJKLMPRSTVWZ",
        strict=True,
    )
)
#: Words with several spellings, up to which they are broadcast.
FEW = 500_000
#: What cannot be seen: format characters, joiners, variation selectors, fillers.
_HIDDEN = dict.fromkeys(
    [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE01F0)]
)
_SPACES = {c: " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]}
_FOLD = _HIDDEN | _SPACES
_SKELETON = {ord(a): b for a, b in LOOK_ALIKE.items()}
#: A word: letters with their accents, no marks of general punctuation.
_REST = "\xc0-\xd6\xd8-\xf6\xf8-\u1fff\u2c00-\u2dff\u2e80-\U0010ffff"
_WORD, _ODD = re.compile(f"[A-Za-z{_REST}]+"), re.compile(f"[{_REST}]")
_PLAIN = frozenset(map(chr, [*range(65, 91), *range(97, 123)]))


def _class(letters) -> str:
    return "".join(map(re.escape, sorted(letters)))


_ALIKE = {*LOOK_ALIKE, *LOOK_ALIKE.values()}
#: Letters of each script that look like none of another.
_SURE = {
    "L": re.compile(f"[{_class({c for c in map(chr, [*range(65, 91), *range(97, 123)]) if c not in _ALIKE})}]"),
    "C": re.compile(f"[{_class({c for c in map(chr, range(0x400, 0x530)) if c.isalpha() and c not in _ALIKE})}]"),
    "G": re.compile(f"[{_class({c for c in map(chr, range(0x370, 0x400)) if c.isalpha() and c not in _ALIKE})}]"),
}


_RUN = re.compile("[^\x00-\x7f]+")
_SEEN: dict[tuple[bool, str], str] = {}


def _apart(run: str) -> str:
    # accents are taken apart before letters are replaced: an accented look-alike equals the accented plain letter
    return unicodedata.normalize("NFKD", run.translate(_FOLD)).translate(_FOLD)


def _of_run(look: bool):
    def fold(match: re.Match) -> str:
        run = match.group()
        done = _SEEN.get((look, run))
        if done is None:
            if len(_SEEN) > 200_000:
                _SEEN.clear()
            done = _apart(run).translate(_SKELETON) if look else _apart(run)
            if len(run) < 40:
                _SEEN[look, run] = done
        return done

    return fold


_FOLD_RUN, _LOOK_RUN = _of_run(False), _of_run(True)


def plain(text: str) -> str:
    """Folded forms, accents apart, nothing invisible, plain spaces; letters of all scripts kept."""
    # apart, a run of other characters folds the same whatever plain letters stand around it, so runs are remembered
    return text if text.isascii() else _RUN.sub(_FOLD_RUN, text)


def skeleton(text: str) -> str:
    """The text's look: equal for two texts exactly if they look the same."""
    return text if text.isascii() else _RUN.sub(_LOOK_RUN, text)


@lru_cache(300_000)
def _look_of(word: str) -> str:
    return word.translate(_SKELETON)


def look_of(word: str) -> str:
    """The look of a word whose accents are apart."""
    return word if word.isascii() else _look_of(word) if len(word) < 40 else word.translate(_SKELETON)


def script_of(c: str) -> str:
    o = ord(c)
    return "L" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "G" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "C" if 0x400 <= o < 0x530 else "-"


def scripts_of(word: str) -> str:
    """The scripts that a word's letters belong to, in the order of the alphabet."""
    return "".join(sorted({script_of(c) for c in word if not unicodedata.combining(c)}))


def main_script(text: str) -> str:
    """The script of most letters that look like none of another; Latin where there are none, or as many."""
    counts = {s: len(_SURE[s].findall(text)) for s in "CG" if _SURE[s].search(text)}
    if not counts:
        return "L"
    counts["L"] = len(_SURE["L"].findall(text))
    return max("LCG", key=lambda s: (counts.get(s, 0), s == "L"))


# ------------------------------------------------------------------ the vocabulary of the corpus


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def out() -> pa.RecordBatch:
        spelled = list(words)
        looks = list(map(look_of, spelled))
        kinds = [k if len(k := scripts_of(w)) == 1 else "mixed" for w in spelled]
        batch = pa.RecordBatch.from_arrays([pa.array(looks, pa.string()), pa.array(spelled, pa.string()), pa.array(kinds, pa.string()), pa.array(list(words.values()), pa.int64())], names=["look", "word", "kind", "n"])
        words.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words.update(_WORD.findall(_utf8(plain(text))))
        if len(words) > 300_000:  # hand over early: the counts never grow with the partition
            yield out()
    yield out()


def _utf8(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def spellings(df: DataFrame, text: str = "text") -> DataFrame:
    """look, words: of every look that the corpus spells in several ways the spellings in order of preference."""
    found = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(_gather, "look string, word string, kind string, n long")
    # one shuffle: all that follows stays with the look
    counted = found.repartition("look").groupBy("look", "word", "kind").agg(F.sum("n").alias("n"))
    # of each script the most written spelling, of mixed ones one: a look has as many entries as there are scripts
    best = counted.groupBy("look", "kind").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("b"), F.count("*").alias("several"))
    entry = F.struct((F.col("kind") == "mixed").alias("mixed"), F.col("b.n").alias("n"), F.col("b.word").alias("word"), "kind")
    return best.groupBy("look").agg(F.sort_array(F.collect_list(entry)).alias("words"), F.sum("several").alias("several")).where("several >= 2").select("look", "words")


def choose(words: list[dict], script: str) -> str:
    """The spelling in the document's script, else the first that keeps to one script."""
    return next((w["word"] for w in words if w["kind"] == script), words[0]["word"])


def repair(text: str, known: dict[str, list[dict]]) -> str:
    """The uniform text: every word of several spellings in the one that is chosen for this document."""
    if text.isascii():
        return text
    done = plain(text)
    script = main_script(done)

    def write(word: str) -> str:
        words = known.get(look_of(word))
        return word if words is None else choose(words, script)

    if script != "L":
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: write(m.group()), done))
    # in a Latin text plain words are as they are to be: only words around another character are looked at
    parts, last, odd = [], 0, _ODD.search(done)
    while odd:
        at = odd.start()
        while at > last and done[at - 1] in _PLAIN:
            at -= 1
        word = _WORD.match(done, at).group()
        parts += [done[last:at], write(word)]
        last = at + len(word)
        odd = _ODD.search(done, last)
    return unicodedata.normalize("NFC", "".join([*parts, done[last:]]))


def _apply(known: dict[str, list[dict]] | None, keys: bool):
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [None] * batch.num_rows if known is not None else batch.column(2).to_pylist()
            texts = batch.column(1).to_pylist()
            done = [None if t is None else repair(t, known if known is not None else {x["look"]: x["words"] for x in own or ()}) for t, own in zip(texts, given)]
            if not keys:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if t is None else _utf8(t) for t in done], pa.string())], names=["id", "uniform_text"])
                continue
            rows = [(i, d if u is t else digest(u), d) for i, t, u, d in ((i, t, u, digest(t)) for i, t, u in zip(batch.column(0).to_pylist(), texts, done) if t is not None)]
            ids, look, raw = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], names=["id", "look_key", "raw_key"])

    return apply


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and not text.isascii():
                rows += [(i, look) for look in {look_of(_utf8(w)) for w in _WORD.findall(plain(text))}]
        ids, looks = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.string())], names=["id", "look"])


def _uniform(df: DataFrame, key: str, text: str, few: int, keys: bool) -> DataFrame:
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    known = checkpoint(spellings(docs))
    schema = "id long, look_key binary, raw_key binary" if keys else "id long, uniform_text string"
    if known.count() <= few:  # proven small: to every worker
        words = {r["look"]: [w.asDict() for w in r["words"]] for r in known.toLocalIterator()}
        return docs.mapInArrow(_apply(words, keys), schema)
    own = docs.mapInArrow(_looks, "id long, look string").join(known, "look")
    own = own.groupBy("id").agg(F.collect_list(F.struct("look", "words")).alias("own"))  # the words of one document
    return docs.join(own, "id", "left").select("id", "text", "own").mapInArrow(_apply(None, keys), schema)


def uniform(df: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """(key, uniform_text): every document's text in one form, equal for two documents exactly if they look the same."""
    return _uniform(df, key, text, few, False).select(F.col("id").alias(key), "uniform_text")


def look_keys(df: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """(id, look_key, raw_key): 128-bit keys of a document's uniform text and of its characters."""
    return _uniform(df, key, text, few, True)


def members(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_key): the documents whose look is spelled in several ways, and the smallest document of that look."""
    keyed = checkpoint(look_keys(df, key, text))
    several = keyed.groupBy("look_key").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi"), F.min("id").alias("class_key")).where("lo <> hi").select("look_key", "class_key")
    return keyed.join(several, "look_key").select(F.col("id").alias(key), "class_key")


def same_look_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), smaller first: documents that look the same but differ in their characters."""
    keyed = checkpoint(look_keys(df, key, text))
    several = keyed.groupBy("look_key").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).where("lo <> hi").select("look_key")
    members = checkpoint(keyed.join(several, "look_key", "left_semi"))
    texts = members.select("look_key", "raw_key").distinct()
    other = texts.select("look_key", F.col("raw_key").alias("raw_b"))
    a = members.select("look_key", "raw_key", F.col("id").alias("a"))
    b = members.select("look_key", F.col("raw_key").alias("raw_b"), F.col("id").alias("b"))
    pairs = a.join(texts.join(other, "look_key").where("raw_key <> raw_b"), ["look_key", "raw_key"]).join(b, ["look_key", "raw_b"]).where("a < b")
    return pairs.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
