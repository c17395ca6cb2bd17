"""Problem 4: typed names linked to the entries of a roster.

1. Every part of a typed name (the whole, and each of several joined names) and every usual form of every entry (reordered, with initials, with
   nicknames, without legal form, ...) is a unit vector of character n-grams, weighted by how rare an n-gram is among all names.
2. A distributed sparse cosine join on n-grams finds all pairs of at least MIN_COSINE. Names are posted under the n-grams of a prefix only: in
   the order of falling weight, those up to where the rest is shorter than MIN_COSINE / 4. An entry is posted once for each n-gram, with the
   largest weight it has in any form. The sum of products plus the length of the rest is no less than the cosine with any form, so no pair is lost.
3. Each pair above the threshold is checked word by word (given name, initials, surname, legal form), as different people share surnames. The
   entries with the fewest edits stay.
4. Average linkage: each entry starts a cluster of its own forms (two entries never merge, as they are different). In rounds, names with one entry left join its
   cluster; a name that several entries claim alike joins the cluster to whose members its mean similarity is highest, if by MARGIN, and belongs to
   none otherwise; a name whose mean similarity to its cluster is under MIN_LINKAGE leaves it. The mean over members is the
   product with their mean vector, so no cluster is ever collected in one place.

Names are all kept: each distinct spelling is looked up once, rows are joined back. Roster and nickname tables are joined; they are broadcast behind a check of their size.

Defined results: null lists and null, blank or placeholder elements name nobody; positions count from 0; an element that is exactly a
full_name is no variant; one naming two entries gives two rows; repeated rows give the same result once; empty tables give an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SMALL = 200_000  # rows up to which a table is broadcast
MIN_COSINE = 0.32
STOP_SHARE = 0.05  # n-grams that are surely (by three standard errors) in a larger share of the names have no weight
MIN_LINKAGE = 0.03
MARGIN = 1.15  # by how much the nearest of several clusters must be nearer than the next
ROUNDS = 3

#: Short forms in general use, beside the nickname table.
COMMON_NICKNAMES = {
    "katherine": "kitty kathy katie kat kay", "victoria": "tori vic", "robert": "bobby rob robbie bert", "elizabeth": "lizzie eliza betsy libby bess", "margaret": "madge daisy greta",
    "william": "liam", "richard": "dickie", "henrietta": "etta harriet", "christopher": "kris", "aleksandra": "sasha", "johannes": "jan", "giuseppe": "peppe", "francisco": "curro kiko",
    "penelope": "pen", "theodore": "ted", "anthony": "ant", "gabriel": "gab", "patricia": "tricia", "wilhelmina": "billie minnie", "jennifer": "jenna", "susan": "suzie", "alexander": "al lex",
}
TITLES = set("mr mrs ms miss dr prof professor sir dame lady lord rev herr frau madame monsieur mme mlle senor senora sr jr ii iii hon judge capt captain sgt cfo ceo coo cto md phd esq witness".split())
LEGAL = {
    "incorporated": "inc", "inc": "inc", "limited": "ltd", "ltd": "ltd", "llc": "llc", "gmbh": "gmbh", "plc": "plc", "group": "group", "grp": "group", "partners": "partners",
    "sa": "sa", "ag": "ag", "corp": "corp", "corporation": "corp", "co": "co", "bv": "bv", "nv": "nv", "srl": "srl", "spa": "spa", "kg": "kg", "lp": "lp", "llp": "llp",
}
FOLD = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
WORD = re.compile(r"[^\W_]+")
DOTTED = re.compile(r"\b(?:\w{1,2}\.\s?){1,}\w{1,2}\.?(?=[\s,]|$)")
JOINT = re.compile(r"\s+(?:&|and|und|et|y|e|i)\s+|\s*[;/|+]\s*", re.I)


@lru_cache(maxsize=200_000)
def canonical(word: str) -> str:
    """A word apart from case, accents and look-alike digits."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower().translate(FOLD)) if not unicodedata.combining(c))
    if any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
        w = w.replace("0", "o").replace("1", "l").replace("5", "s")
    return w


@lru_cache(maxsize=200_000)
def sounded(word: str) -> str:
    """A canonical word apart from transliteration and letters that sound alike."""
    w = word.replace("ue", "u").replace("oe", "o").replace("ae", "a")
    return w[:1] + w[1:].replace("kw", "qu").replace("ph", "f")


def words(name: str) -> list[str]:
    """The canonical words of a name; single letters with dots (S.A.) become one word where they form a legal form."""
    name = DOTTED.sub(lambda m: w if (w := m[0].replace(".", "").replace(" ", "")).lower() in LEGAL else m[0], name)
    return [canonical(w) for w in WORD.findall(name)]


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) between a and b, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before2, before = before, now
    return before[-1] if before[-1] <= most else most + 1


class Known(NamedTuple):
    """Given names and surnames of the roster: one of them isn't a misspelling of another."""

    given: frozenset[str]
    last: frozenset[str]


NONE = Known(frozenset(), frozenset())


class Entry(NamedTuple):
    ref_id: int
    person: bool
    full_name: str
    given: str
    middle: str
    last: str
    nick: frozenset[str]
    parts: tuple[str, ...]
    legal: str


def entry(ref_id: int, kind: str, full_name: str, nicknames: dict[str, set[str]]) -> Entry:
    w = words(full_name)
    if kind == "person":
        given, last = (w[0] if w else ""), (w[-1] if w else "")
        return Entry(ref_id, True, full_name, given, "".join(w[1:-1])[:1], last, frozenset(nicknames.get(given, ())), (), "")
    legal = LEGAL.get(w[-1], "") if w else ""
    return Entry(ref_id, False, full_name, "", "", "", frozenset(), tuple(w[:-1] if legal else w), legal)


def forms(e: Entry) -> set[str]:
    """The usual ways to write an entry, in canonical words."""
    if e.person:
        given = {e.given, *e.nick}
        out = {f"{g} {e.last}" for g in given} | {f"{e.given[:1]} {e.last}"}
        return out | ({f"{e.given} {e.middle} {e.last}", f"{e.given[:1]} {e.middle} {e.last}", f"{e.given[:1]}{e.middle} {e.last}"} if e.middle else set())
    p = " ".join(e.parts)
    return {f"{p} {e.legal}".strip(), p, " ".join(e.parts[:2]), "".join(x[:1] for x in e.parts) + " " + e.legal}


def _close(typed: str, meant: str, known: frozenset[str] = frozenset()) -> int:
    """Edits between a typed word and the one meant, 9 if too many for its length or if the typed one is another known word."""
    if typed == meant or sounded(typed) == sounded(meant):
        return 0
    if typed in known:
        return 9
    n = min(len(typed), len(meant))
    most = 0 if n < 4 else 1 if n < 8 else 2
    d = min(distance(typed, meant, most), distance(sounded(typed), sounded(meant), most))
    return d if d <= most else 9


def short_form(typed: str, given: str, nick: frozenset[str]) -> bool:
    """Is typed a usual kind of short form of a given name: its beginning or its end, perhaps with a pet ending?"""
    stems = {typed}
    for end in ("ie", "y", "i", "ey"):
        if typed.endswith(end) and len(typed) - len(end) >= 3:
            stem = typed[: -len(end)]
            stems |= {stem, stem[:-1]} if stem[-1:] == stem[-2:-1] else {stem}
    return any(len(s) >= 3 and s != given and (s in nick or given.startswith(s) or (len(s) >= 4 and given.endswith(s))) for s in stems)


def person_cost(typed: tuple[str, ...], comma: int, e: Entry, known: Known = NONE) -> int:
    """Edits by which typed words mean the person, 9 if they don't. comma: how many words stand before a comma, or 0."""
    best = 9
    orders = [typed[comma:] + typed[:comma]] if comma else [typed, typed[1:] + typed[:1]]
    for k, w in enumerate(orders):
        if len(w) < 2:
            continue
        given, middle, last = w[0], w[1:-1], w[-1]
        if k == 1 and len(w) > 2:
            given, middle = w[0], w[1:-1]
        if len(middle) > 1 or (middle and e.middle and middle[0][:1] != e.middle) or len(last) < 3:
            continue
        if len(given) == 1:
            g = 0 if given == e.given[:1] else 9
        elif len(given) == 2 and given[0] == e.given[:1] and given[1] == e.middle and not middle:
            g = 0
        else:
            g = min([_close(given, e.given, known.given), *(_close(given, n, known.given) for n in e.nick)])
            if g == 9 and given not in known.given and short_form(given, e.given, e.nick):
                g = 1
        if g < 9 and g + (s := _close(last, e.last, known.last)) < best:
            # an edit of the surname next to a mere initial, or many edits, mean somebody else
            if g + s <= (1 if len(given) == 1 else 2):
                best = g + s
    return best


def firm_cost(typed: tuple[str, ...], e: Entry, known: Known = NONE) -> int:
    """Edits by which typed words mean the firm, 9 if they don't."""
    w = [x for x in typed if x not in ("the", "and", "company", "firm")]
    said = "company" in typed or "firm" in typed
    legal = LEGAL.get(w[-1], "") if w else ""
    body = w[:-1] if legal and len(w) > 1 else w
    if legal and e.legal and legal != e.legal and len(w) > 1:
        return 9
    if len(body) == 1 and legal and len(body[0]) == len(e.parts) and body[0] == "".join(p[:1] for p in e.parts):
        return 0
    if len(body) == len(e.parts):
        orders = [e.parts, (e.parts[0], *e.parts[:0:-1])]  # the trades are also written the other way round
        costs = []
        for parts in orders:
            each = [0 if k and 3 <= len(x) < len(y) and y.startswith(x) else _close(x, y, known.last if not k else frozenset()) for k, (x, y) in enumerate(zip(body, parts))]
            costs.append(sum(each))
        return min(costs) if min(costs) <= 2 else 9
    if len(body) == len(e.parts) - 1 and len(body) >= 2 and (said or not legal):
        total = sum(_close(x, y, known.last if not k else frozenset()) for k, (x, y) in enumerate(zip(body, e.parts)))
        return total if total <= 1 else 9
    return 9


def grams(form: str) -> list[str]:
    """Character n-grams of words, with their edges; whole words of one or two letters."""
    out = []
    for w in form.split():
        p = f"_{sounded(w)}_"
        out += [p[i : i + 3] for i in range(len(p) - 2)]
        out += [p[i : i + 2] for i in range(0, len(p) - 1, 2)]
    return out


def weigh(gram: str, weights: dict[str, float]) -> float:
    return weights.get(gram, weights.get("", 1.0))


def vector(form: str, weights: dict[str, float]) -> list[tuple[str, float]]:
    """The unit vector of a form, heaviest n-grams first."""
    c = Counter(grams(form))
    x = sorted(((weigh(g, weights), g, n) for g, n in c.items()), reverse=True)
    length = sqrt(sum(((1 + log(n)) * w) ** 2 for w, _, n in x)) or 1.0
    return [(g, (1 + log(n)) * w / length) for w, g, n in x if w > 0]


def prefix(v: list[tuple[str, float]], least: float = MIN_COSINE / 4) -> tuple[list[tuple[str, float]], float]:
    """The n-grams up to where the rest is shorter than least, and the length of the rest."""
    rest = sum(x * x for _, x in v)
    for k, (_, x) in enumerate(v):
        if rest < least * least:
            return v[:k], sqrt(max(0.0, rest))
        rest -= x * x
    return v, 0.0


@lru_cache(maxsize=50_000)
def typed_words(text: str) -> tuple[tuple[str, ...], int]:
    """The words of a typed name without titles, and how many of them stand before a comma (0 if that says nothing)."""
    text = re.sub(r"\([^)]*\)", " ", unicodedata.normalize("NFC", text).strip())
    head, _, tail = text.partition(",")
    typed = [w for w in words(text) if w not in TITLES]
    before = [w for w in words(head) if w not in TITLES]
    return tuple(typed), len(before) if tail and len(before) == 1 and len(typed) <= 3 else 0


def parts_of(name: str) -> list[tuple[int, str]]:
    """The whole name as part 0, and each of several joined names."""
    parts = [p for p in JOINT.split(name) if p and p.strip()]
    return [(0, name), *(enumerate(parts, 1) if len(parts) > 1 else [])]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    cols = [x.split(" ", 1) for x in schema.split(", ")]
    values = list(zip(*rows)) or [[]] * len(cols)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, cols)], names=[n for n, _ in cols])


def _columns(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(n).to_pylist() for n in names))


def mentions(df: DataFrame, tab: str, id_col: str, people: str = "people") -> DataFrame:
    """(tab, rec_id, person_pos, name) of each element that isn't null or blank."""
    return (
        df.select(F.lit(tab).alias("tab"), F.col(id_col).cast("long").alias("rec_id"), F.posexplode(people).alias("person_pos", "name"))
        .filter(F.col("name").isNotNull() & (F.trim("name") != ""))
        .withColumn("person_pos", F.col("person_pos").cast("long"))
    )


def gram_weights(names: DataFrame) -> dict[str, float]:
    """Inverse document frequencies of n-grams over all distinct names; the driver gets the common ones (each in over 1/20,000 of the names: at most 20,000 times the n-grams of a name)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        n = 0
        for b in batches:
            for name in b.column("name").to_pylist():
                n += 1
                count.update(set(grams(" ".join(words(name)))))
        count[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["gram", "n"])

    table = names.mapInArrow(scan, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    total = (table.filter("gram = ''").select(F.sum("n")).first()[0] or 0) + 1
    rows = table.filter((F.col("gram") != "") & (F.col("n") > total / 20_000)).collect()
    return {r["gram"]: log(1 + total / r["n"]) if r["n"] - 3 * sqrt(r["n"]) <= STOP_SHARE * total else 0.0 for r in rows} | {"": log(1 + 20_000)}


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def entries_of(roster: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(ref_id, kind, full_name, nick) of each entry, with the short forms of its given name."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(canonical(f), canonical(s)) for f, s in _columns(b, "formal", "short")], "given string, nick string")

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(i, k, n, (words(n) or [""])[0] if k == "person" else "") for i, k, n in _columns(b, "ref_id", "kind", "full_name")], "ref_id bigint, kind string, full_name string, given string")

    known = nicknames.select("formal", "short").filter("formal is not null and short is not null").mapInArrow(short, "given string, nick string")
    common = roster.sparkSession.createDataFrame([(g, n) for g, ns in COMMON_NICKNAMES.items() for n in ns.split()], "given string, nick string")
    # short forms of one given name: as many as a language has
    nick = known.union(common).groupBy("given").agg(F.array_sort(F.collect_set("nick")).alias("nick"))
    rows = roster.filter("ref_id is not null and full_name is not null").select(F.col("ref_id").cast("long").alias("ref_id"), F.col("kind"), F.col("full_name")).distinct()
    return rows.mapInArrow(given, "ref_id bigint, kind string, full_name string, given string").join(nick, "given", "left").select("ref_id", "kind", "full_name", F.coalesce("nick", F.array().cast("array<string>")).alias("nick"))


def entry_of(ref_id: int, kind: str, full_name: str, nick: list[str]) -> Entry:
    w = words(full_name)
    return entry(ref_id, kind, full_name, {w[0]: set(nick)} if w else {})


PART = "name string, part int, text string, form string"
POSTING = "form_no bigint, gram string, x double"


def parts_table(names: DataFrame) -> DataFrame:
    """(name, part, text, form) of the parts of each name that have two words or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column("name").to_pylist():
                for k, text in parts_of(name):
                    typed, comma = typed_words(text)
                    if len(typed) > 1:
                        rows.append((name, k, text, " ".join(typed[comma:] + typed[:comma])))
            yield _batch(rows, PART)

    return names.mapInArrow(scan, PART)


def candidates(parts: DataFrame, entries: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Different (form, ref_id) whose cosine may be MIN_COSINE: all that are that near, and few others."""
    shared = parts.sparkSession.sparkContext.broadcast(weights)

    def of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, no in _columns(b, "form", "form_no"):
                rows += [(no, g, x) for g, x in prefix(vector(f, shared.value))[0]]
            yield _batch(rows, POSTING)

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(f, no, prefix(vector(f, shared.value))[1]) for f, no in _columns(b, "form", "form_no")], "form string, form_no bigint, rest double")

    def of_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, k, n, nick in _columns(b, "ref_id", "kind", "full_name", "nick"):
                most: dict[str, float] = {}
                for f in forms(entry_of(i, k, n, nick)):
                    for g, x in vector(f, shared.value):
                        most[g] = max(x, most.get(g, 0.0))
                rows += [(i, g, x) for g, x in most.items()]
            yield _batch(rows, "ref_id bigint, gram string, y double")

    cores = parts.sparkSession.sparkContext.defaultParallelism
    numbered = cut(parts.select("form").distinct().repartition(max(cores, parts.rdd.getNumPartitions())).withColumn("form_no", F.monotonically_increasing_id()), "names-forms")
    typed = numbered.mapInArrow(of_names, POSTING)
    posted = entries.mapInArrow(of_entries, "ref_id bigint, gram string, y double")
    met = typed.join(small(posted, 5 * SMALL), "gram").groupBy("form_no", "ref_id").agg(F.sum(F.col("x") * F.col("y")).alias("s")).filter(F.col("s") >= 0.75 * MIN_COSINE)
    return met.join(numbered.mapInArrow(rests, "form string, form_no bigint, rest double"), "form_no").filter(F.col("s") + F.col("rest") >= MIN_COSINE).select("form", "ref_id")


def known_words(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """(form, given, last) of each form: those of its words that are a given name or a surname on the roster, so no misspelling of another."""

    def of_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for e in (entry_of(*x) for x in _columns(b, "ref_id", "kind", "full_name", "nick")):
                rows += [(w, "given") for w in ((e.given, *e.nick) if e.person else ())] + [(w, "last") for w in ((e.last,) if e.person else e.parts[:1])]
            yield _batch(rows, "word string, sort string")

    known = entries.mapInArrow(of_entries, "word string, sort string").filter("word <> ''").distinct()
    spelt = parts.select("form").distinct().select("form", F.explode(F.array_distinct(F.split("form", " "))).alias("word"))
    # the words of one form
    return spelt.join(small(known), "word").groupBy("form").agg(F.collect_set(F.when(F.col("sort") == "given", F.col("word"))).alias("given"), F.collect_set(F.when(F.col("sort") == "last", F.col("word"))).alias("last"))


FOUND = "name string, part int, form string, ref_id bigint, edits int, same boolean"


def checked(parts: DataFrame, pairs: DataFrame, entries: DataFrame, known: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(name, part, form, ref_id, edits, same) of the pairs that are as near as MIN_COSINE and agree word by word."""
    shared = parts.sparkSession.sparkContext.broadcast(weights)
    empty = F.array().cast("array<string>")
    rows = pairs.join(small(entries), "ref_id").join(known, "form", "left").select("form", "ref_id", "kind", "full_name", "nick", F.coalesce("given", empty).alias("given"), F.coalesce("last", empty).alias("last"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[Entry, list[dict[str, float]]]] = {}
        for b in batches:
            out = []
            if len(met) > 50_000:
                met.clear()
            for name, part, text, form, ref, kind, full, nick, given, last in _columns(b, "name", "part", "text", "form", "ref_id", "kind", "full_name", "nick", "given", "last"):
                if ref not in met:
                    e = entry_of(ref, kind, full, nick)
                    met[ref] = e, [dict(vector(f, shared.value)) for f in sorted(forms(e))]
                e, vectors = met[ref]
                typed, comma = typed_words(text)
                k = Known(frozenset(given), frozenset(last))
                edits = person_cost(typed, comma, e, k) if e.person else firm_cost(typed, e, k)
                if edits < 9:
                    v = vector(form, shared.value)
                    if max((sum(x * u.get(g, 0.0) for g, x in v) for u in vectors), default=0.0) >= MIN_COSINE:
                        out.append((name, part, form, ref, edits, full[:1] in unicodedata.normalize("NFC", text)))
            yield _batch(out, FOUND)

    return parts.join(rows, "form").select("name", "part", "text", "form", "ref_id", "kind", "full_name", "nick", "given", "last").mapInArrow(scan, FOUND)


def fewest(found: DataFrame) -> DataFrame:
    """Of each part the entries with the fewest edits; of entries that differ by an accent only (É. and E.), the one written so. claims: how many are left."""
    at = ["name", "part"]
    best = found.join(found.groupBy(*at).agg(F.min("edits").alias("least")), at).filter("edits = least")
    counted = best.join(best.groupBy(*at).agg(F.count_if("same").alias("alike"), F.count(F.lit(1)).alias("n")), at)
    left = counted.filter("n = 1 or alike <> 1 or same")
    return left.select(*at, "form", "ref_id", F.when(F.col("alike") == 1, 1).otherwise(F.col("n")).alias("claims"))


def average_linkage(claimed: DataFrame, entries: DataFrame, weights: dict[str, float], rounds: int = ROUNDS, least: float = MIN_LINKAGE, margin: float = MARGIN) -> DataFrame:
    """(name, part, ref_id) of the names in the cluster of each entry. claimed: (name, part, form, ref_id, claims)."""
    shared = claimed.sparkSession.sparkContext.broadcast(weights)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(f, g, x) for f in b.column("form").to_pylist() for g, x in vector(f, shared.value)], "form string, gram string, x double")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(i, f) for i, k, n, nick in _columns(b, "ref_id", "kind", "full_name", "nick") for f in sorted(forms(entry_of(i, k, n, nick)))], "ref_id bigint, form string")

    seeds = entries.mapInArrow(own, "ref_id bigint, form string").join(claimed.select("ref_id").distinct(), "ref_id", "left_semi")
    every = cut(claimed.select("form").union(seeds.select("form")).distinct().mapInArrow(vectors, "form string, gram string, x double"), "names-vectors")
    seeds = cut(seeds, "names-seeds")
    members = claimed.filter("claims = 1").select("form", "ref_id").distinct()
    joined = None
    for _ in range(rounds):
        inside = seeds.select("form", "ref_id").union(members).distinct()
        size = inside.groupBy("ref_id").agg(F.count(F.lit(1)).alias("size"))
        centre = inside.join(every, "form").groupBy("ref_id", "gram").agg(F.sum("x").alias("s"))
        pairs = claimed.select("form", "ref_id").distinct()
        mean = pairs.join(every, "form").join(centre, ["ref_id", "gram"]).groupBy("form", "ref_id").agg(F.sum(F.col("x") * F.col("s")).alias("s")).join(size, "ref_id").select("form", "ref_id", (F.col("s") / F.col("size")).alias("linkage"))
        scored = claimed.join(mean, ["form", "ref_id"])
        at = ["name", "part"]
        top = scored.groupBy(*at).agg(F.max(F.struct("linkage", "ref_id")).alias("top"), F.max("claims").alias("c"))
        other = scored.join(top, at).groupBy(*at).agg(F.max(F.when(F.col("ref_id") != F.col("top.ref_id"), F.col("linkage"))).alias("second"))
        best = scored.join(top, at).filter((F.col("ref_id") == F.col("top.ref_id")) & (F.col("linkage") >= least)).join(other, at)
        clear = best.filter((F.col("c") == 1) | F.col("second").isNull() | (F.col("linkage") >= margin * F.col("second")))
        now = cut(clear.select(*at, "form", "ref_id").distinct(), "names-clusters")
        grown = now.select("form", "ref_id").distinct()
        settled = joined is not None and joined.count() == now.count() and grown.exceptAll(joined.select("form", "ref_id").distinct()).isEmpty()
        joined, members = now, grown
        if settled or claimed.filter("claims > 1").isEmpty():
            break
    assert joined is not None
    return joined.select("name", "part", "ref_id")


def links(mentioned: DataFrame, roster: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(tab, rec_id, person_pos, ref_id) of each element that names an entry otherwise than by its full_name."""
    exact = small(roster.select(F.col("full_name").alias("name")).distinct())
    variants = mentioned.join(exact, "name", "left_anti")
    names = cut(variants.select("name").distinct().repartition(variants.sparkSession.sparkContext.defaultParallelism), "names-distinct")
    weights = gram_weights(names)
    entries = cut(entries_of(roster, nicknames), "names-entries")
    parts = cut(parts_table(names), "names-parts")
    pairs = cut(candidates(parts, entries, weights), "names-candidates")
    found = cut(checked(parts, pairs, entries, known_words(parts, entries), weights), "names-found")
    claimed = cut(fewest(found), "names-claimed")
    linked = average_linkage(claimed, entries, weights)
    # joined names are looked at one by one only where the whole names nobody
    whole = linked.filter("part = 0").select("name").distinct()
    kept = linked.filter("part = 0").select("name", "ref_id").union(linked.filter("part > 0").join(whole, "name", "left_anti").select("name", "ref_id"))
    return variants.join(kept.distinct(), "name").select("tab", "rec_id", "person_pos", "ref_id").distinct()


def found(facts: DataFrame, llm_facts: DataFrame, roster: DataFrame, nicknames: DataFrame) -> DataFrame:
    """p4_found."""
    return links(mentions(facts, "facts", "id").unionByName(mentions(llm_facts, "llm_facts", "raw_id")), roster, nicknames)
