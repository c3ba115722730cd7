"""Free-entered values mapped to the entry of a reference list that is meant, or reported as unmatched.

The reference forms (labels and aliases) stand in BK-trees under the Levenshtein distance, a true metric, so the
triangle inequality prunes every branch that cannot hold a form within twice the threshold; the few that are left are
measured by the Damerau-Levenshtein distance, which is at most that, and no entry within it is missed.  What people write around a value (levels, years, firms, contract kinds) is taken
off step by step; a place is read in parts, and its country or region must agree with the city.

Scale: the tree goes to the workers only behind a check of its size; a larger list is cut into shards of that
size, every distinct value is looked up in each, and a shard returns all entries of its nearest distance, so that ties
are decided when the shards merge, by the same rule as in one tree.  The names of countries and regions, which tell
places apart, go to every shard (``HINTS`` bounds them).  Lookups are narrow: a Python worker remembers what it has
seen, so repeated values cost a dictionary access and no shuffle, however frequent.

Defined results: blank values are not asked; stand-ins and everything too far from all entries give 0; a value
equally near to several entries gives 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import strip
from recordloom.runtime import checkpoint

#: Reference entries that may go to each worker at once.
SHARD = 50_000
#: Different names of countries and regions that may go to each worker.
HINTS = 200_000
#: Ways to write a country besides its name: code and native or short forms.
COUNTRIES = {
    "Argentina": "ar arg", "Australia": "au", "Austria": "at österreich oesterreich", "Belgium": "be belgique belgië belgie belgien", "Brazil": "br brasil bra", "Canada": "ca can",
    "Chile": "cl", "China": "cn", "Colombia": "co col", "Czechia": "cz česko cesko czech_republic", "Denmark": "dk danmark", "Finland": "fi suomi", "France": "fr frankreich francia", "Germany": "de deutschland alemania ger allemagne",
    "Ghana": "gh", "Hungary": "hu magyarország", "India": "in bharat ind", "Ireland": "ie éire eire irl republic_of_ireland", "Italy": "it italia ita", "Japan": "jp", "Kenya": "ke", "Mexico": "mx méxico mex",
    "Netherlands": "nl nederland the_netherlands holland", "Norway": "no norge", "Poland": "pl polska", "Portugal": "pt prt", "Russia": "ru", "South Africa": "za", "Spain": "es españa espana esp spanien", "Sweden": "se sverige", "Switzerland": "ch schweiz suisse svizzera",
    "Turkey": "tr", "Ukraine": "ua", "United Kingdom": "gb uk u.k. great_britain britain gbr", "United States": "us usa u.s.a. u.s. united_states_of_america america the_united_states", "Uruguay": "uy", "Venezuela": "ve",
}
_BEFORE = re.compile(r"^(?:role|title|position|tools|skills?|core skills?|key skills?|tech|stack|languages?)\s*:\s*|^(?:(?:good|basic|advanced|solid|strong|some|working|deep|excellent|expert|intermediate|extensive|proven|practical)\s+)?(?:experience|knowledge|proficien\w+|expertise|skilled|familiar\w*|background|command)\s+(?:with|in|of)\s+|^(?:good|basic|advanced|solid|strong|some|excellent|expert(?: in)?|intermediate|proficient in)\s+")
_AFTER = [
    re.compile(p)
    for p in (
        r"\s*\([^()]*\)?\s*$", r"\s+[-–—/|]\s+[^-–—/|]*$", r"\s*@\s*[^@]*$", r",\s*[^,]*$", r"\s+(?:i{1,3}|iv|v|1|2|3)$", r"\s*[.*;:!]+$",
        r"\s+(?:knowledge|skills?|experience|expert|basics|certified|\d+\+?\s*(?:yrs?|years?))$",
    )
]
_AROUND = re.compile(r"\s+(?:area|city cent(?:re|er)|metro(?:politan)?(?: area)?|region|city|downtown|suburbs)$|^(?:greater|city of|near|downtown)\s+")


def key_of(text: str, bare: bool = False) -> str:
    """A value without case, odd spaces and kinds of separators; ``bare`` also without accents."""
    text = unicodedata.normalize("NFKC", text).lower().replace("’", "'")
    if bare:
        text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae")) if not unicodedata.combining(c))
    return re.sub(r"[\s_\-‐-―]+", " ", text).strip(" ,;:*")


def distance(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance (a metric), or ``most + 1`` where lengths alone exceed ``most``."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return max(abs(la - lb), most + 1)
    far = la + lb
    last: dict[str, int] = {}
    d = [[far] * (lb + 2) for _ in range(la + 2)]
    for i in range(la + 1):
        d[i + 1][1] = i
    for j in range(lb + 1):
        d[1][j + 1] = j
    for i in range(1, la + 1):
        seen = 0
        for j in range(1, lb + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[la + 1][lb + 1]


def _masks(form: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(form):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def _levenshtein(masks: dict[str, int], m: int, other: str) -> int:
    """Levenshtein distance (a metric) to a form of ``m`` letters given as bit masks, a column of the table at a time."""
    if not m:
        return len(other)
    full = (1 << m) - 1
    high, plus, minus, score = 1 << (m - 1), full, 0, m
    get = masks.get
    for c in other:
        eq = get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(x | up)), up & x
    return score


class BKTree:
    """Forms by their Levenshtein distance to a parent form; ``near`` returns every form no further than ``most``."""

    def __init__(self, forms: list[str]) -> None:
        self.root: str | None = None
        self.children: dict[str, dict[int, str]] = {}
        for form in forms:
            self.add(form)

    def add(self, form: str) -> None:
        if self.root is None:
            self.root = form
            self.children[form] = {}
            return
        node, masks = self.root, _masks(form)
        while True:
            d = _levenshtein(masks, len(form), node)
            if d == 0:
                return
            if d not in self.children[node]:
                self.children[node][d] = form
                self.children[form] = {}
                return
            node = self.children[node][d]

    def near(self, form: str, most: int) -> list[str]:
        found, todo, masks, m = [], [self.root] if self.root is not None else [], _masks(form), len(form)
        while todo:
            node = todo.pop()
            d = _levenshtein(masks, m, node)
            if d <= most:
                found.append(node)
            for edge, child in self.children[node].items():
                if d - most <= edge <= d + most:
                    todo.append(child)
        return found


class BKForest:
    """A BK-tree for each length of form: lengths that differ by more than ``most`` are never looked at.

    A swap of neighbours is one typing error but two Levenshtein steps, so the trees are asked for twice the
    distance and the few forms they return are measured exactly.
    """

    def __init__(self, forms: list[str]) -> None:
        self.trees: dict[int, BKTree] = {}
        self.known: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for form in forms:
            self.trees.setdefault(len(form), BKTree([])).add(form)

    def within(self, form: str, most: int) -> list[tuple[int, str]]:
        hit = self.known.get((form, most))
        if hit is None:
            trees = (self.trees.get(n) for n in range(len(form) - most, len(form) + most + 1))
            close = [other for tree in trees if tree for other in tree.near(form, 2 * most)]
            hit = sorted((d, other) for other in close if (d := distance(form, other, most)) <= most)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[form, most] = hit
        return hit


def reach(form: str) -> int:
    """How far a form of this length may be from what it means."""
    return 0 if len(form) < 5 else 1 if len(form) < 12 else 2


class Canon:
    """The entries of one kind (a plain list of names) with their forms."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]) -> None:
        self.ids: dict[str, set[int]] = {}
        for cid, label, aliases in entries:
            for form in [label, *aliases]:
                self.ids.setdefault(key_of(form), set()).add(cid)
        self.tree = BKForest(list(self.ids))

    @staticmethod
    def forms(value: str) -> list[str]:
        """The value, then what is left as wrapping after wrapping is taken off."""
        text = re.sub(r"[\s_]+", " ", unicodedata.normalize("NFKC", value)).strip().lower()
        todo, seen = [text], []
        while todo:
            t = todo.pop(0)
            if not t or t in seen:
                continue
            seen.append(t)
            todo += [_BEFORE.sub("", t, count=1), *(after.sub("", t, count=1) for after in _AFTER)]
        return seen

    def look(self, value: str) -> tuple[int, int, set[int]]:
        """(distance, which form it was found under, entries): the best that this tree holds; of several trees the least wins."""
        forms = list(dict.fromkeys(key_of(f) for f in self.forms(value)))
        for k, form in enumerate(forms):
            if ids := self.ids.get(form):
                return 0, k, ids
        best: tuple[int, int, set[int]] = (99, 0, set())
        for r, form in enumerate(reversed(forms)):  # what is left without wrapping first
            for d, near in self.tree.within(form, reach(form)):
                rank = (d, r if d == 1 else 0)
                if rank < best[:2]:
                    best = (*rank, set(self.ids[near]))
                elif rank == best[:2]:
                    best[2].update(self.ids[near])
            if best[0] == 1:
                break  # nothing can be nearer: no form is the same
        return best

    def find(self, value: str) -> tuple[int, int]:
        """(distance, entry id), entry 0 where none or several equally near ones fit."""
        far, _, ids = self.look(value)
        return far, only(ids)


def only(ids: set[int]) -> int:
    return next(iter(ids)) if len(ids) == 1 else 0


class Hints:
    """The names of all countries and regions, which tell places apart and are no cities."""

    def __init__(self, regions: list[str], countries: list[str]) -> None:
        self.regions = {key_of(r, True) for r in regions} - {""}
        self.countries = {key_of(c, True): key_of(c, True) for c in countries if c}
        for name, others in COUNTRIES.items():
            for other in [name, *others.split()]:
                self.countries[key_of(other.replace("_", " "), True)] = key_of(name, True)
        self.tree = BKForest([h for h in [*self.regions, *self.countries] if len(h) > 4])
        self.of = lru_cache(500_000)(self._of)

    def _of(self, part: str) -> tuple[str | None, str | None]:
        """(country, region) a part names; both for a name that is both."""
        part = part.strip(". ") if part.strip(". ") in self.countries else part
        country, region = self.countries.get(part), part if part in self.regions else None
        if country is None and region is None and len(part) > 4:
            for _, near in self.tree.within(part, 1):
                return self.countries.get(near), near if near in self.regions else None
        return country, region


class Places:
    """Cities with the country and region that must agree."""

    def __init__(self, entries: list[tuple[int, str, list[str], str | None, str | None]], hints: Hints | None = None) -> None:
        self.hints = hints or Hints([e[3] or "" for e in entries], [e[4] or "" for e in entries])
        self.cities: dict[str, set[int]] = {}
        self.at: dict[int, tuple[str, str]] = {}
        for cid, label, aliases, region, country in entries:
            for form in [label, *aliases]:
                city = form.rsplit(",", 1)[0] if country and form.lower().endswith(country.lower()) else form
                self.cities.setdefault(key_of(city, True), set()).add(cid)
            self.at[cid] = (key_of(country or "", True), key_of(region or "", True))
        self.tree = BKForest(list(self.cities))
        self.city = lru_cache(500_000)(self._city)

    def _city(self, part: str) -> tuple[int, int, int, set[int]]:
        """(exact or near, which form, distance, entries): the cities a part may mean; of several trees the least wins."""
        if part.startswith("="):  # this very name
            return (0, 0, 0, self.cities[part[1:]]) if part[1:] in self.cities else (9, 0, 99, set())
        tries = [part]
        while (less := _AROUND.sub("", tries[-1], count=1)) != tries[-1]:
            tries.append(less)
        for k, t in enumerate(tries):
            if t in self.cities:
                return 0, k, 0, self.cities[t]
        if part in self.hints.countries or part in self.hints.regions:
            return 9, 0, 99, set()
        for r, t in enumerate(reversed(tries)):
            near = self.tree.within(t, reach(t) if len(t) != 4 else 1)
            if near:
                first = near[0][0]
                return 1, r, first, set().union(*(self.cities[f] for d, f in near if d == first))
        return 9, 0, 99, set()

    @staticmethod
    def parts(value: str) -> list[str]:
        return [p for p in (key_of(x, True).strip(" .") if not re.fullmatch(r"\s*\w+\.(?:\w+\.)*\s*", x) else key_of(x, True) for x in re.split(r"[,/()|;\n]|\s[-–—]\s", value)) if p]

    def find(self, value: str) -> tuple[int, int]:
        return place_of(value, lambda part: self.city(part)[2:], self.at, self.hints)


def place_of(value: str, city, at: dict[int, tuple[str, str]], hints: Hints) -> tuple[int, int]:
    """(distance, entry id) of a place from what its parts may mean; ``city``: part -> (distance, entries), ``at``: country and region."""
    parts = Places.parts(value)
    best: tuple[int, set[int]] = (99, set())
    for k, part in enumerate(parts):
        d, found = city(part)
        ids = set(found)
        for other in parts[:k] + parts[k + 1 :]:
            country, region = hints.of(other)
            if country is None and region is None:
                ids &= city(other)[1]  # a part that says nothing known speaks against the city
            else:
                ids = {i for i in ids if (country and at[i][0] == country) or (region and at[i][1] == region)}
        if ids and d < best[0]:
            best = (d, ids)
    if not best[1]:
        whole = city("=" + key_of(value, True))[1]
        best = (0, set(whole)) if whole else best
    return best[0], only(best[1])


#: What a worker has built and seen, by the entries it was given: later tasks of the same worker use it again.
_WORKER: dict[int, tuple[dict, dict]] = {}


def _lookup(entries: list[tuple]):
    mark = hash(repr(entries))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recordloom.llm import canon as own_module

        if mark not in own_module._WORKER:
            finders: dict[str, Canon | Places] = {}
            for kind in {e[1] for e in entries}:
                own = [e for e in entries if e[1] == kind]
                placed = any(e[5] for e in own)
                finders[kind] = Places([(e[0], e[2], e[3], e[4], e[5]) for e in own]) if placed else Canon([(e[0], e[2], e[3]) for e in own])
            own_module._WORKER.clear()
            own_module._WORKER[mark] = finders, {}
        finders, known = own_module._WORKER[mark]
        for batch in batches:
            far, ids = [], []
            for kind, val in zip(batch.column("kind").to_pylist(), batch.column("val").to_pylist()):
                hit = known.get((kind, val))
                if hit is None:
                    hit = finders[kind].find(val) if kind in finders else (99, 0)
                    if len(known) > 500_000:
                        known.clear()
                    if len(val) < 200:
                        known[kind, val] = hit
                far.append(hit[0])
                ids.append(hit[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.int32()), pa.array(ids, pa.int32())], names=[*batch.schema.names, "far", "canon_id"])

    return look


def match(values: DataFrame, canon: DataFrame, shard: int = SHARD) -> DataFrame:
    """``values`` (with kind and val) plus far and canon_id; ``canon``: canon_id, kind, label, aliases, region_name, country."""
    cols = [F.col(c) for c in ("canon_id", "kind", "label")] + [F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("aliases"), F.col("region_name"), F.col("country")]
    entries = canon.select(*cols).where("label is not null and canon_id is not null")
    n = entries.count()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields) + ", far int, canon_id int"
    rows = lambda df: sorted((tuple(r) for r in df.toLocalIterator()), key=repr)
    if n <= shard:  # proven small: to every worker
        return values.mapInArrow(_lookup(rows(entries)), schema)
    hinted = {c: [r[0] for r in entries.select(c).distinct().where(f"{c} is not null").take(HINTS + 1)] for c in ("region_name", "country")}
    if max(map(len, hinted.values())) > HINTS:
        raise ValueError(f"more than {HINTS} names of regions or countries")
    placed = [r["kind"] for r in entries.where("country is not null and country <> ''").select("kind").distinct().collect()]  # the kinds that are places
    names = (hinted["region_name"], hinted["country"])
    asked = checkpoint(values.select("kind", "val").distinct().mapInArrow(_questions(placed), "kind string, val string, part string"))
    parts = asked.select("kind", "part").distinct()
    said, shards = None, -(-n // shard)
    for p in range(shards):
        own = rows(entries.where(F.pmod(F.xxhash64("canon_id"), F.lit(shards)) == p))
        one = parts.mapInArrow(_look_up(own, placed, names), "kind string, part string, a int, b int, far int, ids array<struct<id:int,country:string,region:string>>")
        said = one if said is None else said.unionByName(one)
    each = said.groupBy("kind", "part").agg(F.array_sort(F.collect_list(F.struct("a", "b", "far", "ids"))).alias("x"))  # one entry a shard
    best = F.get("x", F.lit(0))
    same = F.flatten(F.transform(F.filter("x", lambda y: (y["a"] == best["a"]) & (y["b"] == best["b"]) & (y["far"] == best["far"])), lambda y: y["ids"]))
    won = each.select("kind", "part", best["far"].alias("far"), same.alias("ids"))
    told = asked.join(won, ["kind", "part"]).groupBy("kind", "val").agg(F.collect_list(F.struct("part", "far", "ids")).alias("told"))  # the parts of one value
    done = told.mapInArrow(_decide(placed, names), "kind string, val string, far int, canon_id int")
    return values.join(done, ["kind", "val"], "left").select(*values.columns, F.coalesce("far", F.lit(99)).alias("far"), F.coalesce("canon_id", F.lit(0)).alias("canon_id"))


def _questions(placed: list[str]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, val in zip(batch.column("kind").to_pylist(), batch.column("val").to_pylist()):
                parts = dict.fromkeys([*Places.parts(val), "=" + key_of(val, True)]) if kind in placed else [val]
                rows += [(kind, val, p) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), (), ()))], names=["kind", "val", "part"])

    return ask


def _look_up(entries: list[tuple], placed: list[str], names: tuple[list[str], list[str]]):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hints = Hints(*names)
        finders: dict[str, Canon | Places] = {}
        for kind in {e[1] for e in entries}:
            own = [e for e in entries if e[1] == kind]
            finders[kind] = Places([(e[0], e[2], e[3], e[4], e[5]) for e in own], hints) if kind in placed else Canon([(e[0], e[2], e[3]) for e in own])
        for batch in batches:
            rows = []
            for kind, part in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist()):
                finder = finders.get(kind)
                if isinstance(finder, Places):
                    a, b, far, ids = finder.city(part)
                    rows.append((kind, part, a, b, far, [{"id": i, "country": finder.at[i][0], "region": finder.at[i][1]} for i in sorted(ids)]))
                elif finder is not None:
                    far, b, ids = finder.look(part)
                    rows.append((kind, part, far, b, far, [{"id": i, "country": "", "region": ""} for i in sorted(ids)]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("id", pa.int32()), ("country", pa.string()), ("region", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["kind", "part", "a", "b", "far", "ids"])

    return look


def _decide(placed: list[str], names: tuple[list[str], list[str]]):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hints = Hints(*names)
        for batch in batches:
            far, ids = [], []
            for kind, val, told in zip(*(batch.column(c).to_pylist() for c in ("kind", "val", "told"))):
                own = {t["part"]: (t["far"], {i["id"] for i in t["ids"]}) for t in told}
                at = {i["id"]: (i["country"], i["region"]) for t in told for i in t["ids"]}
                d, one = place_of(val, lambda part: own.get(part, (99, set())), at, hints) if kind in placed else (own[val][0], only(own[val][1]))  # noqa: B023
                far.append(d)
                ids.append(one)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("val"), pa.array(far, pa.int32()), pa.array(ids, pa.int32())], names=["kind", "val", "far", "canon_id"])

    return decide


def typed_values(df: DataFrame, src_table: str, row: str, field: str, kind: str, parts: Column) -> DataFrame:
    """src_table, row_id, field_name, kind, pos, val: the non-blank values of an array of them, trimmed."""
    rows = df.select(F.col(f"`{row}`").alias("row_id"), F.posexplode(parts).alias("p", "v"))
    rows = rows.select(F.lit(src_table).alias("src_table"), "row_id", F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), (F.col("p") + 1).alias("pos"), strip(F.col("v")).alias("val"))
    return rows.where("val is not null and val <> ''")


def unlabelled(values: DataFrame, canon: DataFrame) -> DataFrame:
    """Without the values that are letter by letter a label of their kind."""
    return values.join(canon.select("kind", F.col("label").alias("val")).distinct(), ["kind", "val"], "left_anti")
