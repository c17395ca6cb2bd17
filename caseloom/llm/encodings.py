"""Problem 3: text decoded with the wrong character encoding, found and restored.

A wrong code page is a substitution cipher: every sign beyond ASCII stands for another letter, or two or three signs for one where UTF-8 was
read byte by byte. Which cipher a passage went through is hidden, and so is what its signs mean; both are found by expectation-maximisation
against letter bigrams of the corpus.

1. One pass counts the bigrams of all texts (most are sound) by source, the beginning of the file name.
2. Rounds of EM: every passage gets a probability for each hypothesis (sound, or one of the starting ciphers, which are swaps of known code
   pages), given how often its source shows that cipher. Expected counts of ciphers by source and of the bigrams of the restored letters make
   the next round's model, until the shares settle. Rounds after the first only read passages that any hypothesis but "sound" can explain.
3. Each source's mapping from sign to letter is then learned by a soft EM over the source's sign bigrams: P(letter | sign) is re-estimated
   from the expected letter pairs of every pair of signs. A starting cipher is its start where one explains the passages (data that
   contradict it move a sign to another letter); passages that no start explains, and whose sign pairs no other source has, are learned from nothing (from
   contexts, then from frequencies per script, with restarts). A mapping learned from nothing is kept only if it pays for itself: its gain must be more than the
   cost of stating it, and the restored pairs must be pairs that other sources have. Else the passages stay as they are and aren't listed.
4. The mappings are applied with translate(); a passage changes if it becomes likelier by GAIN.

What reaches the driver: bigrams that make up PAIR_SHARE of all or more (at most 1 / PAIR_SHARE), cipher shares and mappings of sources that
hold SOURCE_SHARE of the texts or more (at most 1 / SOURCE_SHARE); smaller sources use the overall shares.

Defined results: null, empty and pure ASCII texts without substitute signs are sound and not listed; a text with a substitute sign (U+FFFD, or a question
mark inside or before a word) is lost, whatever else can be restored; others that change are restorable; repeated ids count once (lost wins); texts
may have any length; other columns are ignored; an empty table gives an empty table. The reported encoding isn't used.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

MAX_ROUNDS = 4
SETTLED = 0.02  # change of the cipher shares, in sum, at which the rounds end
PAIR_SHARE = 1e-6
SOURCE_SHARE = 1e-4
STRANGE_SHARE = 2e-5  # letters with a smaller share of all letters beyond ASCII are strange
READ = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "mac_roman", "cp850", "cp437", "koi8-r", "cp866")
WRITTEN = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "mac_cyrillic", "cp850", "cp437", "cp852", "mac_latin2")
WIDE = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
SUBSTITUTE = re.compile(r"�|\x1a|[^\W\d_]\?[^\W\d_]|(?<=\s)\?(?=[^\W\d_])|\?\?\w|\w\?\?|\?{3}")
UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
SENTENCE = re.compile(r"(?<=[.!?;。])\s+|\n+")
BEYOND = re.compile(r"[^\x00-\x7f]")
LETTERS = re.compile("[A-Za-z\x80-\U0010ffff]+")
RUN = re.compile(r"[^\x00-\x7f]{2,}")
CONTROL = re.compile(r"[\x00-\x06\x0e-\x19]")
SPACED = re.compile(r"(?:[^\x00]\x00){3,}")
GAIN = 4.0  # nats by which a restored passage must be likelier
PASSAGE = 1.0  # and a sentence of it
IDEOGRAPHS = 0x2E80  # signs from here on are in no single-byte page


@lru_cache(maxsize=None)
def byte_of(page: str) -> dict[str, int]:
    """The upper bytes of a code page by their signs; bytes without one are their control signs."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(maxsize=None)
def as_bytes(page: str) -> dict[int, str]:
    """A translate table from the signs of a page to their bytes; other signs beyond ASCII become signs that are no bytes."""
    return {ord(c): chr(b) for c, b in byte_of(page).items()} | {b: chr(0xE000 + b) for b in range(128, 256) if chr(b) not in byte_of(page)}


@lru_cache(maxsize=None)
def ciphers() -> list[tuple[str, dict[int, str]]]:
    """(name, mapping) of every swap of single-byte pages, as a translate table; equal mappings once."""
    seen, out = set(), []
    for r in READ:
        for w in WRITTEN:
            table: dict[int, str] = {}
            for c, b in byte_of(r).items():
                try:
                    to = bytes([b]).decode(w)
                except UnicodeDecodeError:
                    continue
                table[ord(c)] = to
            key = tuple(sorted(table.items()))
            if any(chr(k) != v for k, v in table.items()) and key not in seen:
                seen.add(key)
                out.append((f"{w}>{r}", table))
    return out


def pieces(text: str) -> list[str]:
    """The runs of letters and signs beyond ASCII that hold such a sign."""
    return [w for w in LETTERS.findall(text) if not w.isascii()]


def pairs_of(text: str, count: dict[str, float], weight: float = 1.0) -> None:
    for w in pieces(text):
        p = f" {w.lower()} "
        for a, b in zip(p, p[1:]):
            if a > "\x7f" or b > "\x7f":
                count[a + b] += weight


class Model:
    """Log-probabilities of letter bigrams of which at least one is beyond ASCII, cipher shares, and the mappings of sources."""

    def __init__(self, pairs: dict[str, float], shares: dict[tuple[str, str], float] | None = None, elsewhere: dict[str, float] | None = None) -> None:
        self.pairs, self.shares, self.elsewhere = pairs, shares or {}, elsewhere or {}
        self.total = sum(pairs.values()) + 1.0
        self.single: Counter[str] = Counter()
        for p, n in pairs.items():
            self.single[p[0]] += n
            self.single[p[1]] += n
        self.tables: dict[str, list[tuple[str, dict[int, str]]]] = {}
        self.tops: dict[str, float] = {}
        self._ready = False

    def prepare(self) -> None:
        """Arrays for scoring many pieces under all ciphers at once."""
        if self._ready:
            return
        self._ready = True
        pages = {c for r in READ for c in byte_of(r)} | {c for _, t in ciphers() for c in t.values() if len(c) == 1}
        letters = {x.lower()[0] for x in pages} | {c for c in self.single if ord(c) < IDEOGRAPHS} | set("abcdefghijklmnopqrstuvwxyz ")
        self.index = {c: k + 1 for k, c in enumerate(sorted(letters))}  # 0: any other sign
        n = len(self.index) + 1
        one = np.zeros(n)
        for c, k in self.index.items():
            one[k] = self.single[c]
        one[0] = sum(v for c, v in self.single.items() if c not in self.index)
        count = np.zeros((n, n), np.float64)
        for p, v in self.pairs.items():
            count[self.index.get(p[0], 0), self.index.get(p[1], 0)] += v
        lp = np.log((count + 0.05 * (one[:, None] + 1) * (one[None, :] + 1) / (2 * self.total)) / self.total)
        ascii_ = np.zeros(n, bool)
        for c, k in self.index.items():
            ascii_[k] = c < "\x80"
        lp[np.ix_(ascii_, ascii_)] = 0
        self.lp = lp.astype(np.float32)
        every = sorted(pages | letters | {c.upper() for c in letters if len(c.upper()) == 1})
        self.sid = np.zeros(0x110000, np.int16)
        for k, c in enumerate(every):
            self.sid[ord(c)] = k + 1
        self.every = every
        low = lambda c: self.index.get(c.lower()[:1], 0)
        self.own = np.array([0, *(low(c) for c in every)], np.int16)
        self.swapped = np.array([[0, *(low(t.get(ord(c), c)) for c in every)] for _, t in ciphers()], np.int16)
        self.numbers: dict[str, int] = {}
        self.gains = np.zeros((1024, len(ciphers())), np.float32)
        self.best = np.zeros(1024, np.float32)
        self.log_known: dict[str, float] = {}
        self.news: dict[str, tuple[int, int]] = {}
        self.special: dict[str, tuple[np.ndarray, dict[str, np.ndarray]]] = {}
        self.known_readings: dict[str, list[tuple[int, float, int, int]]] = {}

    def _scored(self, words: list[str], swapped: np.ndarray) -> np.ndarray:
        """By how much each mapping makes each piece likelier: pieces by mappings."""
        out = np.empty((len(words), len(swapped)), np.float32)
        done = 0
        while done < len(words):
            stop, size = done, 0
            while stop < len(words) and (stop == done or size < 20_000):
                size += len(words[stop]) + 1
                stop += 1
            s = self.sid[np.frombuffer((" " + " ".join(words[done:stop]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
            starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words[done:stop]])[:-1]))
            own = self.own[s]
            base = self.lp[own[:-1], own[1:]]
            to = swapped[:, s]
            out[done:stop] = np.add.reduceat(self.lp[to[:, :-1], to[:, 1:]] - base, starts, axis=1).T
            done = stop
        return out

    def numbered(self, words: list[str]) -> np.ndarray:
        """The rows of gains of pieces, new ones being scored first."""
        if len(self.numbers) > 100_000:
            self.numbers.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.numbers]:
            first = len(self.numbers)
            while first + len(new) > len(self.best):
                self.gains, self.best = np.concatenate([self.gains, np.zeros_like(self.gains)]), np.concatenate([self.best, np.zeros_like(self.best)])
            g = self._scored(new, self.swapped)
            self.gains[first : first + len(new)], self.best[first : first + len(new)] = g, g.max(1)
            self.numbers.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def of_source(self, words: list[str], source: str) -> np.ndarray:
        """The gains of pieces under the source's own mappings."""
        if source not in self.special:
            low = lambda c: self.index.get(c.lower()[:1], 0)
            self.special[source] = (np.array([[0, *(low(t.get(ord(c), c)) for c in self.every)] for _, t in self.tables[source]], np.int16), {})
        swapped, known = self.special[source]
        if len(known) > 50_000:
            known.clear()
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            known.update(zip(new, self._scored(new, swapped)))
        return np.array([known[w] for w in words])

    def piece(self, w: str) -> float:
        """Log-probability of a piece."""
        if (s := self.log_known.get(w)) is not None:
            return s
        if len(self.log_known) > 300_000:
            self.log_known.clear()
        score = 0.0
        p = f" {w.lower()} "
        for a, b in zip(p, p[1:]):
            if a > "\x7f" or b > "\x7f":
                back = 0.05 * (self.single[a] + 1) * (self.single[b] + 1) / (2 * self.total)
                score += log((self.pairs.get(a + b, 0) + back) / self.total)
        self.log_known[w] = score
        return score

    def readings(self, w: str) -> list[tuple[int, float, int, int]]:
        """Of a piece, for each page under which it holds sequences of UTF-8: the page, the gain of putting them right, how many there are, and how many become strange signs.

        Sequences are signs beyond ASCII before and after, so none reaches beyond its piece and the gain of a text is the sum of its pieces.
        """
        if (r := self.known_readings.get(w)) is not None:
            return r
        if len(self.known_readings) > 100_000:
            self.known_readings.clear()
        r = self.known_readings[w] = []
        for k in sorted({k for run in RUN.findall(w) for k in utf8_pages(run)}):
            t, new = from_utf8(w, READ[k])
            if new:
                strange = sum(map(self.strange, new))
                unknown = sum(c not in page_signs() and self.strange(c) for c in new)
                # signs that no sound text has are no letters of this cipher
                r.append((k, self.piece(t) - self.piece(w) - 14 * strange, len(new), unknown))
        return r

    def novel(self, w: str) -> tuple[int, int]:
        """How many pairs of a piece no other source has, and how many it has."""
        if (r := self.news.get(w)) is not None:
            return r
        if len(self.news) > 300_000:
            self.news.clear()
        p = f" {w.lower()} "
        own = [a + b for a, b in zip(p, p[1:]) if (a > "\x7f" or b > "\x7f") and max(a, b) < chr(IDEOGRAPHS)]
        r = self.news[w] = (sum(self.elsewhere.get(x, 0.0) < 2 * PAIR_SHARE * self.total for x in own), len(own))
        return r

    def text(self, t: str) -> float:
        return sum(map(self.piece, pieces(t)))

    def strange(self, c: str) -> bool:
        return c > "\x7f" and self.single[c.lower()[:1]] < max(0.5, STRANGE_SHARE * self.total)

    def top_prior(self, source: str) -> float:
        """The largest prior of a cipher that isn't a reading of UTF-8."""
        if source not in self.tops:
            if len(self.tops) > 100_000:
                self.tops.clear()
            self.tops[source] = max(self.prior(source, n) for n, _ in ciphers())
        return self.tops[source]

    def prior(self, source: str, cipher: str) -> float:
        overall = self.shares.get(("", cipher), 0.0)
        return log(self.shares.get((source, cipher), overall) + 0.002)


@lru_cache(maxsize=None)
def utf8_form(page: str) -> re.Pattern[str]:
    """Sequences of UTF-8 as a page reads them."""
    signs = byte_of(page)
    own = {b: {chr(b)} for b in range(128, 256)}
    for c, b in signs.items():
        own[b].add(c)

    def of(low: int, high: int) -> str:
        return "[" + re.escape("".join(sorted({c for b in range(low, high + 1) for c in own[b]}))) + "]"

    further = of(0x80, 0xBF)
    return re.compile(f"{of(0xC2, 0xDF)}{further}|{of(0xE0, 0xEF)}{further}{{2}}|{of(0xF0, 0xF4)}{further}{{3}}")


class _Sequences(dict):
    """What a sequence of signs is as UTF-8; itself if it isn't valid."""

    def __init__(self, page: str) -> None:
        self.table = as_bytes(page)

    def __missing__(self, signs: str) -> str:
        if len(self) > 100_000:
            self.clear()
        try:
            c = signs.translate(self.table).encode("latin-1").decode("utf-8")
        except UnicodeError:
            c = signs
        self[signs] = c
        return c


@lru_cache(maxsize=None)
def sequences(page: str) -> _Sequences:
    return _Sequences(page)


def from_utf8(text: str, page: str) -> tuple[str, list[str]]:
    """text with all sequences that are UTF-8 read by a page put right, and what they became."""
    known, new = sequences(page), []

    def put(m: re.Match[str]) -> str:
        c = known[m[0]]
        if len(c) == 1:
            new.append(c)
        return c

    return (utf8_form(page).sub(put, text) if utf8_form(page).search(text) else text), new


@lru_cache(maxsize=1)
def stretch() -> re.Pattern[str]:
    """Signs of cp1252 and latin-1, at most one ASCII sign between two: what multi-byte pages look like there."""
    upper = re.escape("".join(sorted({*byte_of("cp1252"), *map(chr, range(128, 256))})))
    return re.compile(f"(?:[{upper}][\\x21-\\x7e]?){{3,}}")


def from_wide(text: str, page: str, wide: str) -> str | None:
    """text as a multi-byte page that was read by a single-byte one, or None."""
    raw = text.translate(as_bytes(page))
    try:
        return raw.encode("latin-1").decode(wide)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def from_utf16(text: str) -> str | None:
    raw = text.translate(as_bytes("cp1252"))
    try:
        b = raw.encode("latin-1")
    except UnicodeEncodeError:
        return None
    for kind in ("utf-16-le", "utf-16-be"):
        for cut in (b, b[1:]):
            t = cut[: len(cut) // 2 * 2].decode(kind, "replace")
            if t and sum(c.isprintable() or c.isspace() for c in t) > 0.97 * len(t) and t.count("\x00") == 0 and sum(c.isascii() or "぀" <= c <= "鿿" or "　" <= c <= "〿" or "Ѐ" <= c <= "ӿ" or "＀" <= c <= "￯" or c < "ſ" for c in t) > 0.95 * len(t):
                return t
    return None



Hypothesis = tuple[float, str, str]  # gain with prior, cipher, restored text


@lru_cache(maxsize=1)
def page_signs() -> frozenset[str]:
    return frozenset(c for page in READ for c in byte_of(page))


@lru_cache(maxsize=300_000)
def utf8_pages(run: str) -> tuple[int, ...]:
    """The pages under which a run of signs beyond ASCII holds a sequence of UTF-8."""
    return tuple(k for k, page in enumerate(READ) if utf8_form(page).search(run))


def _by_utf8(text: str, model: Model, source: str) -> list[Hypothesis]:
    found: dict[int, list[float]] = {}  # by page: gain, sequences, those that become signs of no text and no page
    for w in pieces(text):
        for k, *r in model.readings(w):
            found[k] = [x + y for x, y in zip(found[k], r)] if k in found else r
    out: list[Hypothesis] = []
    for k, (gain, new, unknown) in sorted(found.items()):
        # not a page under which most sequences of the whole text become signs that no text and no page has: an unseen language would gain by that too
        if 2 * unknown <= new:
            out.append((gain + model.prior(source, f"utf-8>{READ[k]}"), f"utf-8>{READ[k]}", from_utf8(text, READ[k])[0]))
    return out


def _by_page(text: str, model: Model, source: str) -> list[Hypothesis]:
    # only pieces of some letters tell: a lone sign may be anything
    words = [w for w in LETTERS.findall(text) if not w.isascii() and len(w) > 1]
    own = model.tables.get(source, [])
    numbers = model.numbered(words)
    # no cipher can gain more than the pieces at their best
    if not words or (not own and np.maximum(model.best[numbers], 0).sum() + model.top_prior(source) <= 0):
        return []
    sentences = SENTENCE.split(text)
    found = [[w for w in pieces(s) if len(w) > 1] for s in sentences]
    words = [w for p in found for w in p]
    numbers = model.numbered(words)
    gains = model.gains[numbers]
    named = ciphers()
    if own:
        gains = np.concatenate([gains, model.of_source(words, source)], axis=1)
        named = [*named, *own]
    sizes = np.array([len(p) for p in found])
    at = np.flatnonzero(sizes)
    sums = np.add.reduceat(gains, np.cumsum(sizes)[at] - sizes[at], axis=0)  # sentences by ciphers
    total = np.where(sums > PASSAGE, sums, 0).sum(0)
    out = []
    gaps = SENTENCE.findall(text)
    best = total.max()
    for k in np.flatnonzero((total > 0) & (total > best - 6)).tolist():
        name, table = named[k]
        score = float(total[k]) + model.prior(source, name)
        if score > 0:
            changed = {int(at[i]) for i in np.flatnonzero(sums[:, k] > PASSAGE)}
            out.append((score, name, (changed, table, sentences, gaps)))
    out.sort(key=lambda x: -x[0])
    # of mappings that agree on these signs, the first
    made: dict[str, Hypothesis] = {}
    for score, name, (changed, table, parts, gaps_) in out[:8]:
        t = "".join(x + g for x, g in zip([s.translate(table) if i in changed else s for i, s in enumerate(parts)], [*gaps_, ""]))
        if t != text and t not in made:
            made[t] = (score, name, t)
    return list(made.values())


def _by_wide(text: str, model: Model, source: str) -> list[Hypothesis]:
    # in a wide page about half of the bytes are beyond ASCII
    parts = [x for m in stretch().finditer(text) if len(x := m.group()) > 5] if stretch().search(text) else []
    if not parts:
        return []
    out = []
    for page in ("cp1252", "latin-1"):
        for wide in WIDE:
            gain, fixed = model.prior(source, f"{wide}>{page}"), {}
            for x in parts:
                if (t := from_wide(x, page, wide)) is not None and t != x:
                    strange = sum(map(model.strange, t))
                    g = model.text(t) - model.text(x) - 6 * strange
                    if g > PASSAGE:
                        gain += g
                        fixed[x] = t
            if fixed:
                out.append((gain, f"{wide}>{page}", stretch().sub(lambda m, f=fixed: f.get(m.group(), m.group()), text)))
    return out


def _by_utf8_again(text: str, model: Model, source: str, depth: int = 3) -> list[Hypothesis]:
    """Readings of UTF-8 by a page, up to three in turn; of each text the two best are followed."""
    out = sorted(_by_utf8(text, model, source), key=lambda x: -x[0])
    for k, (g, n, t) in enumerate(out[:2]):
        if depth > 1 and g > GAIN and not t.isascii() and (deeper := _by_utf8_again(t, model, source, depth - 1)) and deeper[0][0] > GAIN:
            out[k] = (g + deeper[0][0], f"{n}+{deeper[0][1]}", deeper[0][2])
    return sorted(out, key=lambda x: -x[0])


def hypotheses(text: str, model: Model, source: str) -> list[Hypothesis]:
    """Ways in which the text can have been made by one cipher, or by several misreadings of UTF-8 in turn, the best first."""
    utf8 = _by_utf8_again(text, model, source)
    # under any other cipher it is by chance (one in about eight for a pair of signs) that sequences are valid UTF-8
    chance = 2.0 * (len(text) - len(utf8[0][2])) if utf8 and utf8[0][0] > GAIN else 0.0
    other = [(g - chance, n, t) for f in (_by_page, _by_wide) for g, n, t in f(text, model, source)]
    return sorted([*utf8, *(h for h in other if h[0] > 0)], key=lambda x: -x[0])


def restore(text: str, model: Model, source: str = "") -> tuple[str, str]:
    """The restored text and the name of its cipher ("" for a sound text)."""
    names: list[str] = []
    if CONTROL.search(text):
        fixed = from_utf16(text)
        return (SPACED.sub(lambda m: m.group().replace("\x00", ""), text) if fixed is None else fixed), "utf-16>cp1252"
    for _ in range(4):
        if text.isascii():
            break
        found = hypotheses(text, model, source)
        if not found or found[0][0] <= GAIN:
            break
        _, name, text = found[0]
        names.append(name)
        if not name.startswith("utf-8"):
            break  # only UTF-8 is misread several times over
    return text, "+".join(names)


def source_of(file_name: str | None) -> str:
    """A file's source: the beginning of its name, if that is set off; "" is unknown."""
    head, mark, _ = (file_name or "").partition("_")
    return head if mark else ""


def _strings(keys: list[tuple[str, str]], values: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(values, pa.float64())], names=["source", "key", "n"])


def _raw_model(texts: DataFrame) -> Model:
    """Bigrams of the texts as they are. elsewhere: how often a pair occurs outside the source that has it most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter[str]] = defaultdict(Counter)
        for b in batches:
            for t, f in zip(b.column("text").to_pylist(), b.column("file_name").to_pylist()):
                by[source_of(f)].update(pieces(t))
            if sum(map(len, by.values())) > 200_000:
                yield from rows(by)
                by.clear()
        yield from rows(by)

    def rows(by: dict[str, Counter[str]]) -> Iterator[pa.RecordBatch]:
        count: Counter[tuple[str, str]] = Counter()
        for s, words in by.items():
            for w, n in words.items():
                p = f" {w.lower()} "
                for x, y in zip(p, p[1:]):
                    if x > "\x7f" or y > "\x7f":
                        count[s, x + y] += n
        yield _strings(list(count), [float(v) for v in count.values()])

    by_source = texts.mapInArrow(scan, "source string, key string, n double").groupBy("source", "key").agg(F.sum("n").alias("n"))
    table = cut(by_source.groupBy("key").agg(F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("elsewhere")), "encoding-pairs")
    total = table.agg(F.sum("n")).first()[0] or 0.0
    rows_ = table.filter(F.col("n") >= PAIR_SHARE * total).collect()
    return Model({r["key"]: r["n"] for r in rows_}, None, {r["key"]: r["elsewhere"] for r in rows_ if r["elsewhere"] > 0})


def share(df: DataFrame, model: Model | None) -> Broadcast:
    if model is not None:
        model.prepare()
    return df.sparkSession.sparkContext.broadcast(model)


def _suspects(texts: DataFrame, model: Model) -> tuple[DataFrame, dict[str, float]]:
    """The texts that something but "sound" can explain, or whose pairs other sources don't have; the pairs of all others."""
    shared = share(texts, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = []
            for t, f in zip(b.column("text").to_pylist(), b.column("file_name").to_pylist()):
                keep.append(bool(CONTROL.search(t) or hypotheses(t, m, source_of(f)) or residual(t, m)))
            yield b.filter(pa.array(keep, pa.bool_()))

    suspects = cut(texts.mapInArrow(scan, texts.schema), "encoding-suspects")
    pairs: dict[str, float] = defaultdict(float, model.pairs)
    for k, n in _expected(suspects, None)[0].items():
        pairs[k] -= n
    return suspects, {k: n for k, n in pairs.items() if n > 0.5}


def _expected(texts: DataFrame, model: Model | None) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Expected counts of bigrams, and of ciphers by source, given the model; with None, of the texts as they are."""
    shared = share(texts, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pairs: dict[str, float] = defaultdict(float)
        found: dict[tuple[str, str], float] = defaultdict(float)
        for b in batches:
            for t, f in zip(b.column("text").to_pylist(), b.column("file_name").to_pylist()):
                s = source_of(f)
                if m is None:
                    pairs_of(t, pairs)
                    continue
                ways = expected(t, m, s)
                for weight, name, x in ways:
                    pairs_of(x, pairs, weight)
                    for n in name.split("+"):
                        found[s, n] += weight
        keys = [("", k) for k in pairs] + [(s, "\t" + n) for s, n in found]
        yield _strings(keys, [*pairs.values(), *found.values()])

    table = cut(texts.mapInArrow(scan, "source string, key string, n double").groupBy("source", "key").agg(F.sum("n").alias("n")), "encoding-expected")
    is_pair = ~F.col("key").startswith("\t")
    total = table.filter(is_pair).agg(F.sum("n")).first()[0] or 0.0
    pairs = {r["key"]: r["n"] for r in table.filter(is_pair & (F.col("n") >= PAIR_SHARE * total)).collect()}
    ciphers_ = table.filter(~is_pair).withColumn("key", F.substring("key", 2, 100))
    sizes = ciphers_.groupBy("source").agg(F.sum("n").alias("size"))
    least = SOURCE_SHARE * (sizes.agg(F.sum("size")).first()[0] or 0.0)
    by_source = ciphers_.join(sizes.filter(F.col("size") >= least), "source").collect()
    overall = ciphers_.groupBy("key").agg(F.sum("n").alias("n")).collect()
    every = sum(r["n"] for r in overall) or 1.0
    shares = {("", r["key"]): r["n"] / every for r in overall}
    # a source's share leans on the overall one as if that were seen in ten of its texts
    return pairs, shares | {(r["source"], r["key"]): (r["n"] + 10 * shares["", r["key"]]) / (r["size"] + 10) for r in by_source if r["source"]}


def expected(text: str, model: Model, source: str) -> list[tuple[float, str, str]]:
    """(probability, cipher, restored text) of the ways in which a text may have come about."""
    if CONTROL.search(text):
        t, name = restore(text, model, source)
        return [(1.0, name, t)]
    ways = hypotheses(text, model, source)[:5]
    top = max([0.0, *(g for g, _, _ in ways)])
    raw = [(exp(-top), "", text), *((exp(g - top), n, t) for g, n, t in ways)]
    total = sum(w for w, _, _ in raw)
    return [(w / total, n, t) for w, n, t in raw if w > 0.01 * total]


def residual(text: str, model: Model) -> list[str]:
    """The sentences most of whose sign pairs no other source has."""
    if not model.elsewhere:
        return []
    out = []
    for s in SENTENCE.split(text):
        if s.isascii():
            continue
        new = every = 0
        for w in pieces(s):
            n, m = model.novel(w)
            new += n
            every += m
        if every and 3 * new > every:
            out.append(s)
    return out


def fitted(pairs: dict[str, float], start: np.ndarray, signs: list[str], letters: list[str], joint: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Soft EM for P(letter | sign) over counted pairs of signs: the mapping and its log-likelihood. joint: P(letter, letter) of the language.

    Of a pair of signs (s, t) the letters (a, b) have probability proportional to joint[a, b] q[a, s] q[b, t]; expected counts give the next q.
    """
    at = {c: k for k, c in enumerate(signs)}
    count = np.zeros((len(signs), len(signs)))
    for p, n in pairs.items():
        count[at[p[0]], at[p[1]]] += n
    scaled = joint * (count.sum() / joint.sum())
    q = start
    fixed = np.array([c < "\x80" for c in signs])
    like = -np.inf
    share = q
    for _ in range(rounds):
        seen = np.maximum(q.T @ scaled @ q, 1e-300)
        now = float((count * np.log(seen)).sum() - seen.sum())
        ratio = count / seen
        expected_ = q * (scaled @ q @ ratio.T + scaled.T @ q @ ratio)  # counts of (letter, sign)
        share = expected_ / np.maximum(expected_.sum(0, keepdims=True), 1e-300)
        # a letter's use may differ from the corpus: q is P(sign | letter) times that use, so it divides by what the model expects of the letter
        mass = scaled @ q.sum(1) + scaled.T @ q.sum(1)
        new = np.sqrt(q * expected_ / np.maximum(mass, 1e-300)[:, None]) + 1e-12
        new[:, fixed] = start[:, fixed]
        q = new
        if abs(now - like) < 1e-5 * abs(now):
            like = now
            break
        like = now
    return share, like


def learned(pairs: dict[str, float], elsewhere: dict[str, float], starts: dict[str, dict[str, str]], seed: int = 7) -> dict[int, str] | None:
    """A source's mapping from counted pairs of signs, or None if none pays for itself. starts: mappings to start from, by name."""
    signs = sorted({c for p in pairs for c in p})
    beyond = [c for c in signs if c > "\x7f"]
    total = sum(elsewhere.values())
    single: Counter[str] = Counter()
    for p, n in elsewhere.items():
        single[p[0]] += n
        single[p[1]] += n
    # signs that are no letters (dashes, quotes) keep their meaning
    letters = [c for c in single if c > "\x7f" and c.isalpha() and ord(c) < IDEOGRAPHS and single[c] >= STRANGE_SHARE * total]
    free = [c for c in beyond if single[c.lower()] < STRANGE_SHARE * total or not c.isalpha() or sum(elsewhere.get(p.lower(), 0) < 2 * PAIR_SHARE * total for p in pairs if c in p) * 2 > sum(c in p for p in pairs)]
    if starts:  # only signs whose starting letters give pairs that others don't have can move
        begin = str.maketrans(next(iter(starts.values())))
        free = [c for c in free if 2 * sum(n * (elsewhere.get(p.translate(begin).lower(), 0) >= 2 * PAIR_SHARE * total) for p, n in pairs.items() if c in p) < sum(n for p, n in pairs.items() if c in p)]
    if not letters or not free or total <= 0:
        return None
    # no mapping can gain more than making every pair the likeliest there is
    most = log(max(elsewhere.values()) / total)
    lacking = sum(n * (most - log((elsewhere.get(p.lower(), 0.0) + 0.05 * (single[p.lower()[0]] + 1) * (single[p.lower()[-1]] + 1) / (2 * total)) / total)) for p, n in pairs.items())
    if lacking < (2 * len(free) * log(len(letters)) if not starts else 2 * log(len(letters)) + GAIN):
        return None
    kept = sorted({c.lower() for c in signs if c not in free})
    rows = sorted(set(letters) | set(kept))
    index = {c: k for k, c in enumerate(rows)}
    joint = np.full((len(rows), len(rows)), 1e-9)
    for p, n in elsewhere.items():
        if p[0] in index and p[1] in index:
            joint[index[p[0]], index[p[1]]] += n / total
    frequency = np.array([single[c] / total for c in rows])
    is_letter = np.array([c > "\x7f" and c.isalpha() for c in rows])
    heads = {c: sum(n for p, n in pairs.items() if p[1] == c and p[0] == " ") / max(1e-9, sum(n for p, n in pairs.items() if p[1] == c)) for c in beyond}

    def blank() -> np.ndarray:
        q = np.zeros((len(rows), len(signs)))
        for k, c in enumerate(signs):
            if c not in free:
                q[index[c.lower()], k] = 1.0
        return q

    own = {c: sum(n for p, n in pairs.items() if c in p) for c in free}
    tried: list[np.ndarray] = []
    for table in starts.values():
        q = blank()
        for k, c in enumerate(signs):
            if c in free:
                q[:, k] = 0.02 * (frequency * is_letter) / (frequency * is_letter).sum()
                to = table.get(c, c).lower()[:1]
                if to in index:
                    q[index[to], k] += 1.0
        tried.append(q)
    # by contexts that are known: the letters before and after
    q = blank()
    for k, c in enumerate(signs):
        if c in free:
            score = np.log(frequency + 1e-9) * 0.0
            for p, n in pairs.items():
                if p[0] == c and p[1] not in free:
                    score = score + n * np.log((joint[:, index[p[1].lower()]] + 1e-8) / (frequency + 1e-6))
                elif p[1] == c and p[0] not in free:
                    score = score + n * np.log((joint[index[p[0].lower()], :] + 1e-8) / (frequency + 1e-6))
            score = np.where(is_letter, score / max(own[c], 1) * min(own[c], 30), -1e9)
            q[:, k] = np.exp(score - score.max())
    if not starts:
        tried.append(q)
    # by frequency ranks within a script, with restarts
    rng = np.random.default_rng(seed)
    scripts: dict[int, list[int]] = defaultdict(list)
    for k, c in enumerate(rows):
        if is_letter[k]:
            scripts[0 if ord(c) < 0x250 else ord(c) >> 8].append(k)
    for members in [] if starts else scripts.values():
        ranked = sorted(members, key=lambda k: -frequency[k])
        order = sorted(free, key=lambda c: -own[c])
        for turn in range(12):
            q = blank()
            noise = rng.random((len(rows), len(signs)))
            for r, c in enumerate(order):
                k = signs.index(c)
                w = np.zeros(len(rows))
                place = np.arange(len(ranked))
                w[ranked] = np.exp(-(((place - r * len(ranked) / max(1, len(order))) / (3 + turn)) ** 2)) + 0.02
                q[:, k] = w * (0.5 + noise[:, k])
                q[:, k] /= q[:, k].sum()
            tried.append(q)
    best = None
    for q0 in tried:
        q, like = fitted(pairs, q0 / np.maximum(q0.sum(0, keepdims=True), 1e-12), signs, rows, joint)
        if best is None or like > best[1]:
            best = (q, like)
    q, _ = best
    table: dict[int, str] = {}
    for k, c in enumerate(signs):
        if c in free:
            to = rows[int(q[:, k].argmax())]
            table[ord(c)] = to
    # of two signs for one letter, the one that begins words is the capital
    by: dict[str, list[str]] = defaultdict(list)
    for c in free:
        by[table[ord(c)]].append(c)
    for to, cs in by.items():
        cs.sort(key=lambda c: -heads[c])
        if len(cs) > 1 and heads[cs[0]] > 0.5 and len(to.upper()) == 1:
            table[ord(cs[0])] = to.upper()
    if starts:
        return moved(table, next(iter(starts.values())), pairs, elsewhere, single, len(rows))
    table = {k: v for k, v in table.items() if chr(k) != v}
    if not table:
        return None
    floor = PAIR_SHARE * total

    def known(change: bool) -> tuple[float, float]:
        score = good = 0.0
        for p, n in pairs.items():
            x = (p.translate(table) if change else p).lower()
            v = elsewhere.get(x, 0.0)
            score += n * log((v + 0.05 * (single[x[0]] + 1) * (single[x[-1]] + 1) / (2 * total)) / total)
            good += n * (v >= 2 * floor)
        return score, good / max(1e-9, sum(pairs.values()))

    before, _ = known(False)
    after, good = known(True)
    # it pays for itself: the gain is more than stating the mapping costs, and what comes out are pairs that others have
    cost = len(table) * log(len(rows)) + 0.5 * len(table) * log(1 + sum(pairs.values()))
    if after - before < 2 * cost or good < 0.85:
        return None
    return table


def moved(table: dict[int, str], start: dict[str, str], pairs: dict[str, float], elsewhere: dict[str, float], single: dict[str, float], n_letters: int) -> dict[int, str] | None:
    """Of the signs whose learnt letter isn't the starting one, those where the gain pays for stating it."""
    total = sum(elsewhere.values())

    def score(p: str) -> float:
        x = p.lower()
        return log((elsewhere.get(x, 0.0) + 0.05 * (single[x[0]] + 1) * (single[x[-1]] + 1) / (2 * total)) / total)

    begin = str.maketrans(start)
    out = {}
    for k, to in table.items():
        was = start.get(chr(k), chr(k))
        if was.lower() == to.lower():
            continue
        mine = [(p, n) for p, n in pairs.items() if chr(k) in p]
        now = begin | {k: to}
        if sum(n * (score(p.translate(now)) - score(p.translate(begin))) for p, n in mine) > 2 * log(n_letters) + GAIN and 2 * sum(n * (elsewhere.get(p.translate(begin).lower(), 0) >= 2 * PAIR_SHARE * total) for p, n in mine) < sum(n for _, n in mine):
            out[k] = to
    return out or None


def learn_mappings(suspects: DataFrame, model: Model) -> dict[str, list[tuple[str, dict[int, str]]]]:
    """The mappings of sources: learned from nothing where no starting cipher explains its passages; starting ones moved where the data contradict them."""
    shared = share(suspects, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        count: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t, f in zip(b.column("text").to_pylist(), b.column("file_name").to_pylist()):
                s = source_of(f)
                if CONTROL.search(t) or SUBSTITUTE.search(t):
                    continue
                way = max(expected(t, m, s), key=lambda x: x[0])
                if way[1] and "+" not in way[1] and not way[1].startswith("utf-8") and way[1].rpartition(">")[0] not in WIDE:
                    marked, parts = way[1], [x for x, y in zip(SENTENCE.split(t), SENTENCE.split(way[2])) if x != y]
                elif not way[1]:
                    marked, parts = "", residual(t, m)
                else:
                    continue
                for x in parts:
                    for w in pieces(x):
                        p = f" {w} "
                        for a, c in zip(p, p[1:]):
                            if (a > "\x7f" or c > "\x7f") and max(a, c) < chr(IDEOGRAPHS):
                                count[f"{s}\t{marked}", a + c] += 1
        yield _strings(list(count), [float(v) for v in count.values()])

    def learn(df: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        source, _, start = df["source"].iloc[0].partition("\t")
        starts = {n: {chr(k): v for k, v in t.items()} for n, t in ciphers() if n == start}
        pairs = dict(zip(df["key"], df["n"]))
        got = learned(pairs, m.elsewhere, starts)
        if got is None:
            return pd.DataFrame({"source": [], "cipher": [], "sign": [], "letter": []}, dtype=object)
        table = {ord(c): t for c, t in starts[start].items()} | got if start else got
        name = start or "learned"
        return pd.DataFrame({"source": source, "cipher": name, "sign": [chr(k) for k in table], "letter": list(table.values())})

    counted = suspects.mapInArrow(scan, "source string, key string, n double").groupBy("source", "key").agg(F.sum("n").alias("n"))
    # a group is a source's table of sign pairs: bounded by the signs of single-byte pages squared, not by its texts
    rows = counted.groupBy("source").applyInPandas(learn, "source string, cipher string, sign string, letter string").collect()
    out: dict[str, dict[str, dict[int, str]]] = defaultdict(lambda: defaultdict(dict))
    for r in rows:
        out[r["source"]][r["cipher"]][ord(r["sign"])] = r["letter"]
    return {s: [(n, t) for n, t in tables.items()] for s, tables in out.items()}


def learn(texts: DataFrame, rounds: int = MAX_ROUNDS) -> Model:
    raw = _raw_model(texts)
    suspects, base = _suspects(texts, raw)
    model, before = raw, {}
    for _ in range(rounds):
        pairs, shares = _expected(suspects, model)
        every: dict[str, float] = defaultdict(float, base)
        for k, n in pairs.items():
            every[k] += n
        model = Model(dict(every), shares, raw.elsewhere)
        overall = {k[1]: v for k, v in shares.items() if not k[0]}
        if sum(abs(overall.get(k, 0) - before.get(k, 0)) for k in {*overall, *before}) < SETTLED:
            break
        before = overall
    model.tables = learn_mappings(suspects, model)
    return model


def restored(df: DataFrame, id_col: str = "extraction_id", text_col: str = "text", file_col: str = "file_name") -> DataFrame:
    """(extraction_id, state, cipher, text) of each garbled record, with the text as far as it can be restored."""
    texts = df.select(F.col(id_col).cast("long").alias("extraction_id"), F.col(file_col).alias("file_name"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    beyond = spread(texts.filter(F.col("text").rlike(r"[^\x00-\x7f]|[\x00\x1a]|\?")))
    shared = share(df, learn(beyond))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for i, t, f in zip(b.column("extraction_id").to_pylist(), b.column("text").to_pylist(), b.column("file_name").to_pylist()):
                fixed, cipher = restore(t, model, source_of(f))
                lost = SUBSTITUTE.search(fixed) is not None or SUBSTITUTE.search(t) is not None
                if lost or cipher:
                    out.append((i, "lost" if lost else "restorable", cipher, fixed))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["extraction_id", "state", "cipher", "text"])

    return beyond.mapInArrow(scan, "extraction_id bigint, state string, cipher string, text string")


def found(df: DataFrame) -> DataFrame:
    """p3_found."""
    return restored(df).groupBy("extraction_id").agg(F.min("state").alias("state"))
