"""Passages of held-out test items inside a training corpus, whole or in part, letter by letter or nearly so.

Every lot of documents is a shard with its own suffix array: the positions of its words in the order of all words
that follow, as far as a passage is long.  (Positions whose next three words stand nowhere in a passage can match no
three words and are left out first.)  Every suffix of every passage is searched in it by bisection, which gives its
longest verbatim match; all matches of three words and more are extended to their full length, and those of a document
and a passage near one diagonal are chained.  An exact look then aligns the passage along every diagonal with chained
matches of ``CHAIN`` words, a changed letter or word costing little and other particulars much; a document leaks an
item if the aligned stretch runs over ``RUNNING`` words and all but few of them are kept.

What stands around a passage is told by its company, counted over all items: a beginning that ``SHARED`` or more
different sentences follow is an instruction, an end that as many different ones precede is a question, as long as
most of these items keep a passage of RUNNING words without it.  A passage that many items carry is searched once.

Scale: one narrow pass over the texts for each ``BLOCK`` of passages, nothing of a text is shuffled; how passages are
cut into blocks changes no row, as each is searched by itself.

Defined results: null and empty texts leak nothing; repeated documents and items each count; an item whose passage has
fewer than RUNNING words cannot leak.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.lookalike import skeleton
from recordloom.runtime import checkpoint

#: Words that a stretch must run over, and the weight it must reach: a kept word counts 1, a lost one LOST.
RUNNING, LEAST, LOST = 20, 17, -2
#: Different neighbours that make a beginning an instruction or an end a question.
SHARED = 5
#: Words that verbatim matches near one diagonal must cover before the exact look, and how near that is.
CHAIN, NEAR = 8, 3
#: Characters of passages that go to each worker at once, matches that are aligned at once, characters of a shard.
BLOCK, MATCHES, SLICE = 20_000_000, 4_000_000, 4_000_000

_OTHER = re.compile("[^\x00-\x7f]+")
_MARKUP = re.compile(r"<[^<>]{1,200}>|[-‐\xad]\r?\n|&(?:#\w+|\w+);")
_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))
_FOLDED: dict[str, str] = {}


def _fold(match: re.Match) -> str:
    run = match.group()
    folded = _FOLDED.get(run)
    if folded is None:
        if len(_FOLDED) > 200_000:
            _FOLDED.clear()
        apart = unicodedata.normalize("NFKD", skeleton(run)).lower()
        folded = "".join(c if c.isalnum() else " " for c in apart if not unicodedata.combining(c))
        # letters of other scripts stay words of their own, as hexadecimal, so that all of a text is plain bytes
        folded = folded if folded.isascii() else "".join(c if c.isascii() else f"u{ord(c):x}" for c in folded)
        if len(run) < 40:
            _FOLDED[run] = folded
    return folded


def words_of(text: str) -> list[str]:
    """The words of a text without case, accents, look-alikes, punctuation, markup and line ends."""
    if "<" in text or "&" in text or "-\n" in text or "\xad" in text or "‐" in text or "-\r\n" in text:
        text = _MARKUP.sub(lambda m: "" if m.group()[-1] == "\n" else " ", text)
    if not text.isascii():
        text = _OTHER.sub(_fold, text)
    return text.lower().encode("ascii", "ignore").translate(_TABLE).decode("ascii").split()


def sentences_of(text: str) -> list[str]:
    """The words of each sentence of a text."""
    return [s for s in (" ".join(words_of(part)) for part in re.split(r"(?<=[.?!:])\s+|\n+", text)) if s]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every item each beginning and each end, what stands next to it, and how many words are left without it."""
    from xxhash import xxh64_intdigest

    key = lambda parts: xxh64_intdigest("\n".join(parts).encode("utf-8", "replace")) >> 1
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = sentences_of(text or "")
            sizes = [s.count(" ") + 1 for s in own]
            for k in range(1, len(own)):
                rows.append((i, True, k, key(own[:k]), key(own[k : k + 1]), sum(sizes[k:])))
                rows.append((i, False, k, key(own[k:]), key(own[k - 1 : k]), sum(sizes[:k])))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (batch.schema.field(0).type, pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["row", "begins", "k", "part", "beside", "left"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("t", "lo", "hi"))):
            own = sentences_of(text or "")
            lo, hi = lo or 0, len(own) if hi is None else hi
            texts.append(" ".join(own[lo:hi] if lo < hi else own))
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(texts, pa.string())], names=["i", "passage"])


def passages(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(i, passage): the words of each item without the instructions and questions that items share."""
    tests = items.select(F.col(f"`{item}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    tests = checkpoint(tests.withColumn("row", F.xxhash64("t")))  # an item delivered again is the same text
    beside = tests.select("row", "t").dropDuplicates(["row"]).mapInArrow(_contexts, "row bigint, begins boolean, k int, part bigint, beside bigint, left int")
    kept = F.avg((F.col("left") >= RUNNING).cast("int"))
    framing = beside.groupBy("begins", "part").agg(F.countDistinct("beside").alias("n"), kept.alias("kept")).where((F.col("n") >= SHARED) & (F.col("kept") > 0.5)).select("begins", "part")
    framed = beside.join(framing, ["begins", "part"]).groupBy("row").agg(F.max(F.when(F.col("begins"), F.col("k"))).alias("lo"), F.min(F.when(~F.col("begins"), F.col("k"))).alias("hi"))
    return tests.join(framed, "row", "left").select("i", "t", "lo", "hi").mapInArrow(_cut, "i long, passage string")


class Items:
    """Passages as word ids, with the three words that begin each of their suffixes."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in rows]
        self.words = [t.split() for _, t in rows]
        self.longest = max(map(len, self.words), default=0)
        self.vocab: dict[str, int] = {}
        for own in self.words:
            for w in own:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.base = len(self.vocab) + 1
        # one row of ids for all passages, zeros between them, so that a match cannot run over an end
        self.row = np.array([x for own in self.words for x in [*(self.vocab[w] for w in own), 0]] + [0] * 3, dtype=np.int64)
        starts = np.cumsum([0] + [len(own) + 1 for own in self.words])
        self.item_at = np.repeat(np.arange(len(self.words)), np.diff(starts)) if self.words else np.zeros(0, np.int64)
        self.start = starts[:-1]
        keys = self.key(self.row, np.arange(len(self.item_at)))
        real = np.flatnonzero(keys >= 0)
        order = np.argsort(keys[real], kind="stable")
        self.suffix, self.suffix_key = real[order], keys[real][order]

    def key(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next three words of each position as one number, -1 where one of them is no word of a passage."""
        a, b, c = row[at], row[at + 1], row[at + 2]
        return np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, -1)


#: Different words that still give three-word keys of 63 bits.
WIDEST = 2**21 - 2


def blocks_of(rows: list[tuple[int, str]]) -> list[Items]:
    """The passages in as many parts as their different words need."""
    one = Items(rows)
    if one.base <= WIDEST:
        return [one]
    if len(rows) == 1:
        raise ValueError(f"a passage of more than {WIDEST} different words")
    return blocks_of(rows[: len(rows) // 2]) + blocks_of(rows[len(rows) // 2 :])


def _longest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from a[i] and b[j] on are the same (zeros never are)."""
    n = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    step = 0
    while len(live):
        x, y = a[np.minimum(i[live] + step, len(a) - 1)], b[np.minimum(j[live] + step, len(b) - 1)]
        live = live[(x == y) & (x > 0)]
        step += 1
        n[live] = step
    return n


def suffix_array(items: Items, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions in the order of the words that follow, as far as the longest passage goes.

    Three words are compared at once; positions that are still equal are parted by their next three, until none is
    left that could go on.
    """
    key = items.key(row, at)
    order = np.argsort(key, kind="stable")
    sa, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(sa) else np.zeros(0, np.int64)
    goes_on, step = np.ones(len(sa), bool), 3
    while step < items.longest:
        size = np.bincount(group)[group] if len(group) else group
        live = np.flatnonzero((size > 1) & goes_on)
        if not len(live):
            break
        p = np.minimum(sa[live] + step, len(row) - 3)
        a = row[p]
        b = np.where(a > 0, row[p + 1], 0)
        c = np.where(b > 0, row[p + 2], 0)
        after = (a * items.base + b) * items.base + c
        order = np.lexsort((after, group[live]))
        sa[live], after = sa[live][order], after[order]
        goes_on[live] = c[order] > 0
        parted = np.zeros(len(sa), bool)
        parted[live[1:]] = (after[1:] != after[:-1]) & (group[live][1:] == group[live][:-1])
        # groups stand side by side, so a cut inside one only moves the numbers of all that follow
        group = group + np.cumsum(parted)
        step += 3
    return sa


def bisect(items: Items, row: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every suffix of the passages its longest verbatim match in a shard, and where that is."""
    n = len(items.suffix)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            break
        mid = (lo[live] + hi[live]) // 2
        i, j = items.suffix[live], sa[mid]
        same = _longest(items.row, row, i, j)
        after = items.row[i + same] > row[np.minimum(j + same, len(row) - 1)]
        lo[live] = np.where(after, mid + 1, lo[live])
        hi[live] = np.where(after, hi[live], mid)
    best, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for at in (lo - 1, lo):  # the neighbours of its place share the most words with a suffix
        ok = (at >= 0) & (at < len(sa))
        if ok.any():
            size = np.zeros(n, np.int64)
            size[ok] = _longest(items.row, row, items.suffix[ok], sa[at[ok]])
            better = size > best
            best[better], where[better] = size[better], sa[at[better]]
    return best, where


@lru_cache(200_000)
def _alike(a: str, b: str) -> bool:
    """The same word with a few letters changed; numbers are particulars and must be equal."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit() or min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2:
        return False
    return sorted(a) == sorted(b) if max(len(a), len(b)) < 4 else SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75


class Shard:
    """Documents as one row of word ids, words of no passage numbered after those of the passages."""

    def __init__(self, items: Items, docs: list[list[str]]) -> None:
        ids = dict(items.vocab)
        for w in {w for own in docs for w in own}.difference(ids):
            ids[w] = len(ids) + 1
        self.row, self.begin, self.length = as_row(ids, docs, 2 * NEAR + 2)
        self.row = self.row.astype(np.int32)
        self.words = ["", *ids]
        self.size = np.array(list(map(len, self.words)), np.int32)
        self.letters = np.array(list(map(_letters, self.words)), np.uint64)


def as_row(ids: dict[str, int], docs: list[list[str]], gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents in one row of word ids (zero for other words, and ``gap`` of them before each document), where each begins, and its words."""
    length = np.array([len(own) for own in docs], np.int64)
    begin = np.cumsum(length + gap) - length
    row = np.zeros(int((length + gap).sum()) + gap + 3, np.int64)
    for at, own in zip(begin.tolist(), docs):
        row[at : at + len(own)] = np.fromiter(map(ids.get, own, repeat(0)), np.int64, len(own))
    return row, begin, length


@lru_cache(500_000)
def _letters(word: str) -> int:
    """The letters and digits of a word as bits; none for a number, which must be equal."""
    mask = 0
    for c in set(word):
        mask |= 1 << (ord(c) - 97 if c > "9" else 26 + ord(c) - 48)
    return 0 if word.isdigit() else mask


def _may_be_alike(shard: Shard, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Never false for words that _alike takes for one: letters that only one of them has cannot match."""
    x, y, n, m = shard.letters[a], shard.letters[b], shard.size[a], shard.size[b]
    least = np.minimum(n - np.bitwise_count(x & ~y), m - np.bitwise_count(y & ~x))
    return (x > 0) & (y > 0) & (np.minimum(n, m) >= 3) & (np.abs(n - m) <= 2) & (8 * least >= 3 * (n + m))


def align(items: Items, shard: Shard, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, first, last) of the heaviest stretch of each passage along document place = passage place + diagonal.

    A word is kept if it stands within three places of its own, or a word like it within one.
    """
    n = np.array([len(w) for w in items.words], np.int64)[item]
    case = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    word = items.row[items.start[item][case] + k]
    word32 = word.astype(np.int32)
    # a place far outside its document is read between documents, where no word is within reach
    at = np.clip((shard.begin[doc] + diagonal)[case] + k, (shard.begin[doc] - NEAR - 1)[case], (shard.begin[doc] + shard.length[doc] + NEAR)[case])
    kept, ask = np.zeros(len(k), bool), []
    for shift in sorted(range(-NEAR, NEAR + 1), key=abs):
        other = shard.row[at + shift]
        kept |= other == word32
        if abs(shift) <= 1:
            ask.append(other)
    for other in ask:
        open_ = np.flatnonzero(~kept & (other > 0))
        open_ = open_[_may_be_alike(shard, word[open_], other[open_])]
        pairs, of = np.unique(word[open_] * len(shard.words) + other[open_], return_inverse=True)
        yes = np.array([_alike(shard.words[q // len(shard.words)], shard.words[q % len(shard.words)]) for q in pairs.tolist()], bool)
        kept[open_[yes[of]]] = True
    weight, first = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    best, lo, hi = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    start = np.cumsum(n) - n
    for step in range(int(n.max()) if len(n) else 0):
        live = np.flatnonzero(n > step)
        weight[live] += np.where(kept[start[live] + step], 1, LOST)
        gone = live[weight[live] <= 0]
        weight[gone], first[gone] = 0, step + 1
        more = live[weight[live] > best[live]]
        best[more], lo[more], hi[more] = weight[more], first[more], step
    return best, lo, hi


def _matches(items: Items, row: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, passage, place in it, place in the document, words) of all verbatim matches of three words and more."""
    at = np.flatnonzero((row[:-2] > 0) & (row[1:-1] > 0) & (row[2:] > 0))
    at = at[np.isin(items.key(row, at), items.suffix_key, assume_unique=False)]
    sa = suffix_array(items, row, at)
    longest, _ = bisect(items, row, sa)
    found = np.flatnonzero(longest >= 3)
    key, asked = items.key(row, sa), items.suffix_key[found]
    lo, hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
    n = hi - lo
    ends = np.cumsum(n)
    for first in range(0, int(ends[-1]) if len(ends) else 0, MATCHES):
        nth = np.arange(first, min(first + MATCHES, int(ends[-1])))
        k = np.searchsorted(ends, nth, "right")
        i, j = items.suffix[found[k]], sa[lo[k] + nth - (ends[k] - n[k])]
        # of matches that are one match, the leftmost
        left = ~((i > 0) & (j > 0) & (items.row[i - 1] == row[j - 1]) & (row[j - 1] > 0))
        i, j = i[left], j[left]
        doc, item = np.searchsorted(begin, j, "right") - 1, items.item_at[i]
        yield doc, item, i - items.start[item], j - begin[doc], _longest(items.row, row, i, j)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str]]]:
    """Documents in lots of so many characters that a shard fits a worker however long they are."""
    for batch in batches:
        lot, size = [], 0
        for d, t in zip(batch.column(0), batch.column(1)):
            text = t.as_py()
            if text:
                lot.append((d.as_py(), text))
                size += len(text)
            if size >= SLICE:
                yield lot
                lot, size = [], 0
        yield lot


def _search(items: Items):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _slices(batches):
            words = [words_of(t) for _, t in texts]
            row, begin, _ = as_row(items.vocab, words)
            hits = [np.concatenate(c) for c in zip(*_matches(items, row, begin))]
            doc_id, item_id = np.array([d for d, _ in texts], object), np.array(items.ids, object)
            cols = _leaking(items, words, *hits) if hits else [[]] * 8
            cols = [doc_id[cols[0]], item_id[cols[1]], *cols[2:]] if hits else cols
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "weight", "item_from", "item_to", "doc_from", "longest", "longest_at"])

    return search


def _leaking(items: Items, docs: list[list[str]], doc: np.ndarray, item: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The documents and passages whose chained matches stand an exact look."""
    pair, diagonal = doc * len(items.ids) + item, y - x
    span = 2 * NEAR + 2 + int(diagonal.max() - diagonal.min())
    code = pair * span + (diagonal - diagonal.min() + NEAR)  # pairs stand too far apart to be neighbours
    codes, of = np.unique(code, return_inverse=True)
    sums = np.concatenate([[0], np.cumsum(np.bincount(of, size))])
    near = sums[np.searchsorted(codes, codes + NEAR, "right")] - sums[np.searchsorted(codes, codes - NEAR, "left")]
    chosen = codes[near >= CHAIN]
    pairs, along = chosen // span, chosen % span - NEAR + diagonal.min()
    d, t = pairs // len(items.ids), pairs % len(items.ids)
    found = [np.zeros(len(chosen), np.int64) for _ in range(3)]
    looked, own_doc = np.unique(d, return_inverse=True)
    shard = Shard(items, [docs[k] for k in looked.tolist()])
    words = np.cumsum(np.array([len(w) for w in items.words], np.int64)[t])
    for part in np.split(np.arange(len(chosen)), np.searchsorted(words, np.arange(MATCHES, int(words[-1]) if len(words) else 0, MATCHES))):
        for whole, own in zip(found, align(items, shard, own_doc[part], t[part], along[part])):
            whole[part] = own
    weight, lo, hi = found
    leaking = np.flatnonzero((weight >= LEAST) & (hi - lo + 1 >= RUNNING))
    # of several diagonals of a document and a passage the heaviest, then the first
    order = leaking[np.lexsort((along[leaking], -weight[leaking], pairs[leaking]))]
    order = order[np.concatenate([[True], pairs[order][1:] != pairs[order][:-1]])] if len(order) else order
    by_size = np.lexsort((y, -size, pair))
    top = by_size[np.searchsorted(pair[by_size], pairs[order], "left")]
    return [d[order], t[order], weight[order], lo[order], hi[order], np.maximum(0, lo[order] + along[order]), size[top], y[top]]


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, weight, item_from, item_to, doc_from (words), longest verbatim match and its place."""
    corpus = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    carried = checkpoint(passages(items, item, text).select("i", F.xxhash64("passage").alias("p"), "passage"))
    own = checkpoint(carried.groupBy("p").agg(F.min("passage").alias("passage")).where(F.size(F.split("passage", " ")) >= RUNNING))
    size = own.agg(F.sum(F.length("passage"))).first()[0] or 0
    schema = "doc_id long, p long, weight long, item_from long, item_to long, doc_from long, longest long, longest_at long"
    parts = max(1, -(-size // block))
    found = None
    for n in range(parts):  # each block is proven small before it goes to the workers
        rows = sorted((r["p"], r["passage"]) for r in own.where(F.pmod(F.col("p"), F.lit(parts)) == n).toLocalIterator())
        for part in blocks_of(rows):
            one = corpus.mapInArrow(_search(part), schema)
            found = one if found is None else found.unionByName(one)
    return found.join(carried.select("p", F.col("i").alias("item_id")).distinct(), "p").select("doc_id", "item_id", *[c.split()[0] for c in schema.split(", ")[2:]])


def clean(docs: DataFrame, items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The documents without those that leak an item."""
    dirty = leaks(docs, items, doc).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(dirty, doc, "left_anti")
