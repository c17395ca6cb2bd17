"""Problem 1: noise of scanned pages found line by line, and their texts repaired into continuous paragraphs.

One pass over all texts counts words, compounds written with a hyphen, and how lines begin and end at page edges and elsewhere. From that
come a vocabulary (words that aren't rare spellings of far more frequent ones), a trie of it, and the forms of running headers and
footers. A second pass repairs: page furniture is recognised at page edges; a word broken at a line end is rejoined unless it is
written with a hyphen anyway; a word outside the vocabulary is looked up by intersecting its Levenshtein automaton (one edit, two for long words, with the
usual confusions of scanners such as rn/m as single edits) with the trie, which finds every candidate; candidates are ranked by the edit, by whether the text around
uses them, and by frequency. Then furniture is removed and lines are reflowed into paragraphs.

The driver gets words and line forms that make up at least MIN_SHARE of all, so their number is at most 1 / MIN_SHARE. Rarer words and compounds stay in a table, whatever the input's size: a token that looks misread but occurs there oftener
than a misreading of the word it was taken for would is a word after all, and a record with a broken word that such a word or compound may decide is judged with those it holds.

Defined results: null and empty texts have no lines with noise and stay as they are; texts of which more than a tenth of the lines are wider than a page are taken as not scanned;
form feeds belong to their line; repeated ids count once; texts may have any length; other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

MIN_SHARE = 2e-6
MIN_COUNT = 3
FORM_SHARE = 0.004  # a form of furniture is at the edge of at least this share of scanned texts
BREAK = "-¬‐­‑"
TOKEN = re.compile(r"[^\W_]+(?:[|+!$€][^\W_]+)*")
BREAK_OR_BLANK = BREAK + " \t"
WORD = re.compile(r"[^\W_]+")
DIGIT_RUN = re.compile(r"\d+")
COMPOUND = re.compile(r"[^\W\d_]{2,}-[^\W\d_]{2,}")
LINE_BREAK = re.compile(rf"([^\W\d_]+)[{BREAK}]\s*\Z")
CODE = re.compile(r"[A-Z]{1,3}-?\d[\d/-]*")
NUMBER = r"(?:[\dlIO|]{1,4}|[ivxlcIVXLC]{1,7})"
PAGE_NUMBER = re.compile(rf"(?:[~-] ?{NUMBER} ?[~-]|[\[(]{NUMBER}[\])]|(?:Seite|Page|page|Pág\.?|Str\.?|p\.|S\.|Blatt|Folio) ?{NUMBER}(?: ?(?:/|of|de|von|sur|\|) ?{NUMBER})?|{NUMBER} ?[|/] ?{NUMBER})\Z")
BARE_NUMBER = re.compile(r"(?:\d{1,4}|[ivxlc]{1,7})\Z")
ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|h|er|re|e|ère|ème|[a-zA-Z])\Z")
CODED = re.compile(r"[A-Za-z]{1,3}\d+[A-Za-z]?\Z")
DIGITLIKE = re.compile(r"(?=.*\d)[\dOolIS|B]+\Z")
RARER = (0, 500, 400, 200, 40, 8)  # how many times rarer, by length, a spelling is than the word it was misread from
EDGE = 4  # lines of a page's edge
WIDE_LINE = 160
NO_RARE: dict[str, float] = {}

#: What scanners confuse: read sign(s) to meant sign(s).
CONFUSED = {
    "rn": "m", "m": "rn", "cl": "d", "d": "cl", "vv": "w", "w": "vv", "ii": "u", "u": "ii", "li": "h", "h": "li", "ri": "n", "n": "ri", "nn": "m", "lc": "k", "tl": "d", "fi": "h", "iii": "m", "in": "m",
}
SIGNS = {"0": "o", "1": "li", "5": "s", "6": "b", "8": "b", "9": "g", "|": "li", "+": "t", "!": "il", "$": "s", "€": "e", "3": "e", "4": "a", "7": "t", "2": "z"}


def is_scanned(text: str) -> bool:
    """Lines of a page's width: hardly any line is longer than a page is wide."""
    lines = [len(x) for x in text.split("\n") if x]
    wide = sum(n > WIDE_LINE for n in lines)
    return bool(lines) and 10 * wide <= len(lines) and (len(lines) > 1 or lines[0] < 110)


def width(lines: list[str]) -> int:
    """The width of a page, by its lines: nine of ten aren't wider; a line of furniture is no wider."""
    n = sorted(len(x) for x in lines if x.strip())
    return max(80, n[(9 * len(n)) // 10] if n else 0)


@lru_cache(maxsize=500_000)
def form(token: str) -> str:
    """A word apart from codes and numbers."""
    return "ID" if CODE.fullmatch(token) else DIGIT_RUN.sub("9", token)


def line_forms(line: str) -> tuple[str, str] | None:
    """How a line begins and how it ends: two words each."""
    first, last = line.split(None, 2)[:2], line.rsplit(None, 2)[-2:]
    if len(first) < 2:
        return None
    return f"S {form(first[0])} {form(first[1])}", f"E {form(last[0])} {form(last[1])}"


def edges(lines: list[str]) -> set[int]:
    """The lines that may be at a page's edge: the first and last few that aren't blank, also about form feeds."""
    pages: list[list[int]] = [[]]
    for i, x in enumerate(lines):
        if "\f" in x:
            pages.append([])
        if x.strip():
            pages[-1].append(i)
    return {i for p in pages for i in (*p[:EDGE], *p[-EDGE:])}


def unbroken(text: str) -> str:
    """text with words broken at line ends rejoined; a last half without its rest is left out."""
    out = []
    for x in text.split("\n"):
        if x[-1:] in BREAK_OR_BLANK and (y := x.rstrip())[-1:] in BREAK and y[-2:-1].isalpha():
            out.append(y[:-1])
            out.append("")
        elif x and not x.isspace():
            out += [x, "\n"]
    if out and not out[-1]:
        out[-2] = out[-2].rpartition(" ")[0]
    return "".join(x.lstrip() if k and not out[k - 1] else x for k, x in enumerate(out))


class Counts:
    """What one pass counts, by keys: w word, h compound, a form anywhere, e form at an edge."""

    def __init__(self) -> None:
        self.words: Counter[str] = Counter()
        self.forms: Counter[str] = Counter()
        self.tokens = self.scanned = 0

    def add(self, text: str) -> None:
        words = WORD.findall(unbroken(text).lower())
        self.words.update(words)
        self.tokens += len(words)
        if "-" in text:
            self.words.update("h" + c.lower() for w in text.split() if "-" in w for c in COMPOUND.findall(w))
        if not is_scanned(text):
            return
        self.scanned += 1
        lines = text.split("\n")
        edge = edges(lines)
        widest = width(lines)
        for i, x in enumerate(lines):
            if (f := line_forms(x.partition("    ")[0])) is not None:
                where = "e" if i in edge and len(x) <= widest else "a"
                self.forms[where + f[0]] += 1
                self.forms[where + f[1]] += 1

    def rows(self) -> tuple[list[str], list[int]]:
        keys = [k if "-" in k else "w" + k for k in self.words] + [f"f{k}" for k in self.forms] + ["n", "p"]
        return keys, [*self.words.values(), *self.forms.values(), self.tokens, self.scanned]


class _Wrong(dict):
    """Does a run of signs between blanks hold a misread word? Remembered."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex

    def __missing__(self, token: str) -> bool:
        if len(self) > 300_000:
            self.clear()
            self.lex.fine.clear()
        w = self[token] = any(self.lex.meant(t) is not None for t in TOKEN.findall(token))
        if not w:
            self.lex.fine.add(token)
        return w


class _RightForms(dict):
    """The form of a run of signs between blanks, misread words put right. Remembered."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        f = self[token] = form(token if CODE.fullmatch(token) else TOKEN.sub(lambda m: (w.capitalize() if m[0][0].isupper() else w) if (w := self.lex.meant(m[0])) else m[0], token))
        return f


class Lexicon:
    """Vocabulary, its trie, compounds, and forms of furniture."""

    def __init__(self, counts: dict[str, int]) -> None:
        words = {k[1:]: n for k, n in counts.items() if k[0] == "w"}
        self.compounds = {k[1:] for k in counts if k[0] == "h"}
        self.parts = {c.split("-")[0] for c in self.compounds}
        least = max(4, FORM_SHARE * counts.get("p", 0))

        def at_edges(n: int, elsewhere: int) -> bool:
            return n >= 0.6 * (n + elsewhere) + (n + elsewhere) ** 0.5  # surely more than by chance

        self.furniture = {
            k[2:] for k, n in counts.items() if k.startswith("fe") and n >= least and at_edges(n, counts.get("fa" + k[2:], 0)) and any(c.isalpha() for c in k[4:]) and k[4:] != "ID"
        }
        self.raw = words
        plain = {w for w in words if w.isalpha()}
        # a spelling that a scanner's confusion turns into one far more frequent is no word
        frequent = {w: words[w] for w in plain}
        self.vocabulary = {w: n for w, n in frequent.items() if not any(frequent.get(c, 0) >= RARER[min(len(w), 5)] * n for c in confusions(w))}
        self.trie: dict = {}
        for w, n in self.vocabulary.items():
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = n
        self.known: dict[str, str | None] = {}
        self.known_outdone: dict[str, float] = {}
        self.wrong = _Wrong(self)
        self.right_forms = _RightForms(self)
        self.fine: set[str] = set()  # of the runs of signs in wrong, those without a misread word

    def candidates(self, word: str, edits: int) -> dict[str, int]:
        """All vocabulary words within so many edits: the automaton of word run along the trie. Values are the edits used."""
        n = len(word)
        found: dict[str, int] = {}
        stack = [(self.trie, 0, edits, "")]
        seen = set()
        while stack:
            node, i, left, path = stack.pop()
            if (id(node), i, left) in seen:
                continue
            seen.add((id(node), i, left))
            if i == n and "" in node:
                used = edits - left
                if used < found.get(path, 99):
                    found[path] = used
            if i < n and (nxt := node.get(word[i])) is not None:
                stack.append((nxt, i + 1, left, path + word[i]))
            if not left:
                continue
            if i < n:
                stack.append((node, i + 1, left - 1, path))
                for read, meant in CONFUSED.items():
                    if word.startswith(read, i):
                        x = node
                        for c in meant:
                            x = x.get(c) if x is not None else None
                        if x is not None:
                            stack.append((x, i + len(read), left - 1, path + meant))
            for c, nxt in node.items():
                if c:
                    stack.append((nxt, i, left - 1, path + c))
                    if i < n and c != word[i]:
                        stack.append((nxt, i + 1, left - 1, path + c))
        return found

    def meant(self, token: str) -> str | None:
        """The word a token was misread from, or None if nothing is wrong with it."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 300_000:
            self.known.clear()
        r = self.known[token] = self._meant(token)
        return r

    def _meant(self, token: str) -> str | None:
        low = token.lower()
        if low in self.vocabulary or token.isdigit():
            return None
        letters = sum(c.isalpha() for c in low)
        if letters < 4 and token.isupper():
            return None  # codes and abbreviations
        if letters < len(low):
            if ORDINAL.fullmatch(token) or CODED.fullmatch(token) or not letters:
                return None
            if DIGITLIKE.fullmatch(token):
                return token.translate(str.maketrans("OolIS|B", "0011518")) if letters * 2 <= len(token) else None
            if (c := self.from_signs(low)) is not None:
                return c
            if letters < 3:
                return None
        elif letters < 3:
            return self.confused(low, 100)
        if letters == len(low) and letters < 5:
            return self.confused(low, 20)
        own = self.vocabulary.get(low, 0)
        for edits in (1, 2) if letters > 5 else (1,):
            c = {w: u for w, u in self.candidates(low, edits).items() if self.vocabulary[w] >= 10 * (own + 1)}
            if c:
                return max(c, key=lambda w: (-c[w], abs(len(w) - len(low)) < 1, self.vocabulary[w]))
        return low if letters < len(low) else None

    def confused(self, low: str, times: int) -> str | None:
        """The word a short token was misread from: of the automaton's candidates those that differ by what scanners confuse, if so many times as frequent as the token."""
        likely = {c: k for k, c in enumerate(confusions(low))}
        near = [c for c in self.candidates(low, 1) if c in likely and self.vocabulary[c] >= times * (self.raw.get(low, 0) + 1)]
        return min(near, key=likely.__getitem__, default=None)

    def from_signs(self, low: str) -> str | None:
        """The word meant where digits or signs stand for letters: the automaton whose steps are the letters a sign may stand for, run along the trie."""
        states = [(self.trie, "")]
        for c in low:
            states = [(nxt, w + m) for node, w in states for m in (c if c.isalpha() else SIGNS.get(c, c)) if (nxt := node.get(m)) is not None]
        return next((w for node, w in states if "" in node), None)

    def outdone(self, low: str) -> float:
        """How often a spelling may occur and still be a misreading: the rule by which the vocabulary is cleaned, for spellings too rare to be in it."""
        if low not in self.known_outdone:
            if len(self.known_outdone) > 300_000:
                self.known_outdone.clear()
            self.known_outdone[low] = max((self.raw.get(c, 0) / RARER[min(len(low), 5)] for c in confusions(low) if c.isalpha()), default=0.0)
        return self.known_outdone[low]

    def is_word(self, low: str, rare: dict[str, float]) -> bool:
        """Is it in the vocabulary, or one of the rare words that aren't outdone?"""
        return low in self.vocabulary or ((n := rare.get("w" + low)) is not None and n > self.outdone(low))

    def odd_at(self, token: str) -> int:
        """Where a misread token first differs from the word meant."""
        w, low, same = self.meant(token) or "", token.lower(), 0
        while same < min(len(w), len(low)) and w[same] == low[same]:
            same += 1
        return same

    def in_context(self, token: str, around: set[str]) -> str | None:
        """meant(), preferring a candidate that the text around uses."""
        first = self.meant(token)
        if first is None or first in around:
            return first
        low = token.lower()
        near = [w for w in self.candidates(low, 1) if w in around and self.vocabulary[w] >= 10]
        return max(near, key=lambda w: self.vocabulary[w]) if near else first

    def is_furniture(self, line: str, hard: bool) -> bool:
        """Does a line begin or end like running headers or footers do?"""
        some = False
        for part in re.split(r"\s{3,}", line) if "   " in line else (line,):
            if len(part) < 24 and PAGE_NUMBER.fullmatch(part):
                some = True
                continue
            if BARE_NUMBER.fullmatch(part):
                continue
            f = line_forms(part)
            if f is None:
                return False
            if f[0] in self.furniture or f[1] in self.furniture:
                some = True
                continue
            if not hard:
                return False
            if f[0] not in self.furniture and f[1] not in self.furniture:
                # perhaps misread
                t, put_right = part.split(), self.right_forms
                if f"S {put_right[t[0]]} {put_right[t[1]]}" not in self.furniture and f"E {put_right[t[-2]]} {put_right[t[-1]]}" not in self.furniture:
                    return False
            some = True
        return some


def confusions(word: str) -> Iterator[str]:
    """Words that a scanner may have turned into word."""
    for i, c in enumerate(word):
        for m in LOOKALIKE.get(c, ""):
            yield word[:i] + m + word[i + 1 :]
    for read, meant in CONFUSED.items():
        at = word.find(read)
        while at >= 0:
            yield word[:at] + meant + word[at + len(read) :]
            at = word.find(read, at + 1)


LOOKALIKE = {
    "c": "eo", "e": "co", "o": "ce0", "b": "h6", "h": "b", "l": "i1t", "i": "l1j", "t": "lf", "f": "t", "n": "u", "u": "nv", "v": "uyr", "g": "q9", "q": "g", "a": "o", "r": "v", "y": "v",
    "ä": "a", "ö": "o", "ü": "u", "á": "a", "é": "e", "à": "a", "è": "e", "ó": "o", "í": "i", "ì": "i", "ï": "i", "â": "a", "ê": "e", "ô": "o", "î": "i", "ı": "i", "ñ": "n", "ç": "c", "ł": "l",
}


def analyse(text: str, lex: Lexicon, tokens_of: dict[int, list[str]] | None = None, rare: dict[str, float] = NO_RARE, asked: dict[str, bool] | None = None) -> tuple[list[str], dict[int, set[str]], set[int], set[int]]:
    """The lines, the kinds of noise by line (from 0), the lines that end inside a word, and those that end after a hyphen which is the word's own.

    tokens_of, if given, gets the misread tokens of each line. rare: words (w), compounds (h) and their first parts (p) that the lexicon is too small for; asked, if
    given, gets those that have a say about a word broken at a line end: True for those without one of which nothing changes, False for others that count then.
    """

    def has(kind: str, key: str) -> bool:
        return lex.is_word(key, rare) if kind == "w" else key in (lex.compounds if kind == "h" else lex.parts) or kind + key in rare

    def ask(deciding: list[tuple[str, bool]], further: list[tuple[str, bool]]) -> None:
        """Of keys and whether they are known, the unknown ones; a known one stays so whatever is rare."""
        if asked is not None and (d := [k for k, known in deciding if not known]):
            asked.update(dict.fromkeys(d, True))
            for k, known in further:
                if not known:
                    asked.setdefault(k, False)

    def misread(i: int, tokens: list[str]) -> None:
        kinds.setdefault(i, set()).add("misread")
        if tokens_of is not None:
            tokens_of.setdefault(i, []).extend(tokens)

    lines = text.split("\n")
    kinds: dict[int, set[str]] = {}
    if not is_scanned(text):
        return lines, kinds, set(), set()
    filled = [i for i, x in enumerate(lines) if x.strip()]
    edge = edges(lines)
    widest = width(lines)
    furniture: set[int] = set()
    bare: list[int] = []
    for i in filled:
        x = lines[i].strip("\f \t")
        if len(x) > widest or (i not in edge and len(x) > 0.9 * widest):
            continue
        if BARE_NUMBER.fullmatch(x):
            bare.append(i)
        elif (i in edge or x[:1].isupper() or not x[:1].isalpha()) and ((len(x) < 24 and PAGE_NUMBER.fullmatch(x) is not None) or lex.is_furniture(x, i in edge or not lines[i - 1].strip() or not "".join(lines[i + 1 : i + 2]).strip())):
            furniture.add(i)
    # at an edge, furniture isn't cut off from it by body lines
    place = {i: k for k, i in enumerate(filled)}
    for i in bare:
        k = place[i]
        beside = [filled[j] for j in (k - 1, k + 1) if 0 <= j < len(filled)]
        if i in edge and (k == 0 or k == len(filled) - 1 or any(j in furniture for j in beside) or "\f" in "".join(lines[beside[0] : i + 1]) or (k + 1 < len(filled) and any("\f" in y for y in lines[i + 1 : filled[k + 1] + 1]))):
            furniture.add(i)
        elif any(j in furniture for j in beside):
            furniture.add(i)
    for i in furniture:
        kinds[i] = {"furniture"}
    body = [i for i in filled if i not in furniture]
    goes_on: set[int] = set()
    own_hyphen: set[int] = set()
    wrong, fine = lex.wrong, lex.fine
    skip_first = False
    for k, i in enumerate(body):
        line = lines[i]
        tokens = line.split()
        start = 1 if skip_first else 0
        skip_first = False
        stop = len(tokens)
        if line.rstrip()[-1:] in BREAK and (m := LINE_BREAK.search(line)):
            head = m.group(1)
            nxt = body[k + 1] if k + 1 < len(body) else None
            tail_m = re.match(r"\W*([^\W_]+(?:[|+!$€][^\W_]+)*)", lines[nxt]) if nxt is not None else None
            tail = tail_m.group(1) if tail_m else ""
            stop -= 1
            if nxt is None or not tail:
                is_part, head_is = has("p", head.lower()), has("w", head.lower())
                if not (is_part and head_is):
                    first, second = ("p" + head.lower(), is_part), ("w" + head.lower(), head_is)
                    ask(*([first], [second]) if not is_part else ([second], []))  # both are needed
                    kinds.setdefault(i, set()).add("hyphen")
                    goes_on.add(i)
            elif tail[0].isdigit() or (tail[0].isupper() and head[-1].islower()):
                stop += 1
                own_hyphen.add(i)
            elif line.rstrip()[-1] != "-":  # a mark that only breaks words
                kinds.setdefault(i, set()).add("hyphen")
                goes_on.add(i)
                skip_first = True
                if lex.meant(head + tail) is not None:
                    misread(i if lex.odd_at(head + tail) < len(head) else nxt, [(head + tail).lower()])
            else:
                joined, low = head + tail, (head + tail).lower()
                whole, compound = has("w", low), has("h", f"{head}-{tail}".lower())
                head_is, tail_is = has("w", head.lower()), has("w", tail.lower())
                of_whole, of_compound, halves = ("w" + low, whole), (f"h{head}-{tail}".lower(), compound), [("w" + head.lower(), head_is), ("w" + tail.lower(), tail_is)]
                half = [h for h in halves if not h[1]][:1]  # both halves must be words, so one that isn't decides
                if whole:
                    is_break = not compound or not (head_is and tail_is)
                    ask([of_compound], halves) if not compound else ask(half, halves)
                elif compound:
                    is_break = False
                    ask([of_whole], halves)
                else:
                    w = lex.meant(joined)
                    is_break = w is not None or not (head_is and tail_is)
                    ask([of_compound, *([of_whole] if w is not None or not half else half)], [of_whole, *halves])
                    if w is not None and is_break:
                        misread(i if lex.odd_at(joined) < len(head) else nxt, [low])
                if is_break:
                    kinds.setdefault(i, set()).add("hyphen")
                    goes_on.add(i)
                    skip_first = True
                else:
                    stop += 1
                    own_hyphen.add(i)
        inside = tokens[start:stop]
        if fine.issuperset(inside):
            continue
        for t in inside:
            if not wrong[t]:
                continue
            if k == 0 and t is tokens[0] and t[0].islower() and t.rstrip(".,;:").isalpha():
                continue  # the rest of a word from the page before
            misread(i, [w.lower() for w in TOKEN.findall(t) if lex.meant(w) is not None])
            if tokens_of is None:
                break
    return lines, kinds, goes_on, own_hyphen


def repair(text: str, lex: Lexicon, rare: dict[str, float] = NO_RARE) -> str:
    """text as continuous paragraphs without furniture, breaks and misread signs. rare: as in analyse()."""
    if not text or not is_scanned(text):
        return text
    lines, kinds, goes_on, own_hyphen = analyse(text, lex, rare=rare)
    around = {w for t in TOKEN.findall(text.lower()) if (w := t) in lex.vocabulary}

    def put_right(m: re.Match[str]) -> str:
        w = None if rare and lex.is_word(m[0].lower(), rare) else lex.in_context(m[0], around)
        return m[0] if w is None else w.capitalize() if m[0][:1].isupper() and not m[0].isupper() else w.upper() if m[0].isupper() and len(m[0]) > 1 else w

    paragraphs: list[str] = []
    current, joining, furniture_gap = "", False, False
    for i, x in enumerate(lines):
        if "furniture" in kinds.get(i, ()):
            furniture_gap = True
            continue
        x = x.strip("\f \t\r")
        if not x:
            # a blank line ends a paragraph, unless a page break cut it off in mid-sentence
            if current and not joining and not furniture_gap:
                if current[-1:] in ".!?:;\"”’)" or len(current) < 60:
                    paragraphs.append(current)
                    current = ""
            continue
        if furniture_gap and current and not joining and current[-1:] in ".!?:\"”" and x[:1].isupper():
            paragraphs.append(current)
            current = ""
        furniture_gap = False
        if i in goes_on:
            x = re.sub(rf"[{BREAK}]\s*\Z", "", x)
        current = current + x if joining else f"{current} {x}".strip()
        joining = i in goes_on or i in own_hyphen
    if current:
        paragraphs.append(current)
    return "\n\n".join(TOKEN.sub(put_right, p) for p in paragraphs)


def counted(texts: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon of all texts (a column text), and what is too rare for it but occurs MIN_COUNT times and more: words (key w...), compounds (h...) and their first parts (p...).

    The lexicon holds what makes up MIN_SHARE of the corpus or more. The rarer words, whose number grows with the corpus, stay in a table.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counts()
        for b in batches:
            for t in b.column("text").to_pylist():
                c.add(t)
            if len(c.words) + len(c.forms) > 1_000_000:
                yield out(c)
                c = Counts()
        yield out(c)

    def out(c: Counts) -> pa.RecordBatch:
        keys, n = c.rows()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["key", "n"])

    table = cut(texts.mapInArrow(scan, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "scans-counts")
    total = table.filter("key = 'n'").select(F.sum("n")).first()[0] or 0
    least = max(MIN_COUNT, int(total * MIN_SHARE))
    word, scanned = ~F.col("key").startswith("f") & ~F.col("key").isin("n", "p"), table.filter("key = 'p'").select(F.sum("n")).first()[0] or 0
    # forms have a floor of their own: a share of the scanned texts
    edge = table.filter(F.col("key").startswith("fe") & (F.col("n") >= max(4, FORM_SHARE * scanned)))
    elsewhere = table.join(edge.select(F.concat(F.lit("fa"), F.substring("key", 3, 1000)).alias("key")), "key", "left_semi")
    counts = {r["key"]: r["n"] for r in table.filter(word & (F.col("n") >= least)).unionByName(edge).unionByName(elsewhere).collect()} | {"p": scanned}
    rare = table.filter((F.col("n") >= MIN_COUNT) & (F.col("n") < least) & F.col("key").rlike(r"^(w\p{L}+|h.*)$")).select("key", F.col("n").cast("double").alias("n"))
    parts = rare.filter(F.col("key").startswith("h")).groupBy(F.concat(F.lit("p"), F.split_part(F.substring("key", 2, 1000), F.lit("-"), F.lit(1))).alias("key")).agg(F.max("n").alias("n"))
    return Lexicon(counts), cut(rare.unionByName(parts), "scans-rare")


def known_rare(asked: DataFrame, rare: DataFrame) -> DataFrame:
    """(tab, rec_id, rare): of the keys that each record asked for (column key), those of the table of rare ones, as a map; records without any that decides are left out."""
    hit = asked.join(rare, "key").groupBy("tab", "rec_id").agg(F.map_from_entries(F.collect_set(F.struct("key", "n"))).alias("rare"), F.max("decides").alias("decides"))
    return cut(hit.filter("decides").drop("decides"), "scans-asked")


def all_texts(ocr_results: DataFrame, text_cache: DataFrame) -> DataFrame:
    a = ocr_results.select(F.lit("ocr_results").alias("tab"), F.col("ocr_id").cast("long").alias("rec_id"), "text")
    b = text_cache.select(F.lit("text_cache").alias("tab"), F.col("id").cast("long").alias("rec_id"), F.col("extracted_text").alias("text"))
    return a.unionByName(b).filter("text is not null and text <> ''")


def found(ocr_results: DataFrame, text_cache: DataFrame) -> DataFrame:
    """(tab, rec_id, line_no, kind) of p1_found."""
    texts = all_texts(ocr_results, text_cache)
    lex_, rare = counted(texts)
    shared = texts.sparkSession.sparkContext.broadcast(lex_)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            at, no, kind, tokens = [], [], [], []
            known = b.column("rare").to_pylist() if "rare" in b.schema.names else None
            for row, t in enumerate(b.column("text").to_pylist()):
                of: dict[int, list[str]] = {}
                asked: dict[str, bool] | None = {} if known is None else None
                for i, ks in analyse(t, lex, of, dict(known[row]) if known else NO_RARE, asked)[1].items():
                    for k in ks:
                        at.append(row), no.append(i + 1), kind.append(k), tokens.append([{"key": "w" + w, "most": lex.outdone(w)} for w in of.get(i, ())] if k == "misread" else None)
                if asked:
                    at.append(row), no.append(0), kind.append("asked"), tokens.append([{"key": k, "most": float(decides)} for k, decides in asked.items()])
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("tab").take(rows), b.column("rec_id").take(rows), pa.array(no, pa.int64()), pa.array(kind, pa.string()), pa.array(tokens, pa.list_(pa.struct([("key", pa.string()), ("most", pa.float64())])))], names=["tab", "rec_id", "line_no", "kind", "tokens"])

    schema = "tab string, rec_id bigint, line_no bigint, kind string, tokens array<struct<key:string,most:double>>"
    cols = ["tab", "rec_id", "line_no", "kind"]
    first = cut(texts.mapInArrow(scan, schema), "scans-lines")
    known = known_rare(first.filter("kind = 'asked'").select("tab", "rec_id", F.explode("tokens").alias("t")).select("tab", "rec_id", "t.key", (F.col("t.most") > 0).alias("decides")), rare)
    again = cut(texts.join(known, ["tab", "rec_id"]).mapInArrow(scan, schema), "scans-lines-again")
    lines = first.filter("kind <> 'asked'").join(known.select("tab", "rec_id"), ["tab", "rec_id"], "left_anti").unionByName(again)
    seen = lines.filter("kind = 'misread'").select(*cols, F.explode("tokens").alias("t")).select(*cols, "t.key", "t.most").join(rare, "key", "left")
    wrong = seen.filter(F.col("n").isNull() | (F.col("n") <= F.col("most"))).select(*cols).distinct()
    return lines.filter("kind <> 'misread'").select(*cols).unionByName(wrong)


def repaired(ocr_results: DataFrame, text_cache: DataFrame) -> DataFrame:
    """(tab, rec_id, text) of every row, repaired; null and empty texts as they are."""
    texts = all_texts(ocr_results, text_cache)
    lex_, rare = counted(texts)
    shared = texts.sparkSession.sparkContext.broadcast(lex_)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            at, keys, decides = [], [], []
            for row, t in enumerate(b.column("text").to_pylist()):
                asked: dict[str, bool] = {}
                if is_scanned(t):
                    analyse(t, lex, asked=asked)
                    asked.update({"w" + x.lower(): True for x in set(TOKEN.findall(t)) if lex.meant(x) is not None})
                at += [row] * len(asked)
                keys += asked
                decides += asked.values()
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("tab").take(rows), b.column("rec_id").take(rows), pa.array(keys, pa.string()), pa.array(decides, pa.bool_())], names=["tab", "rec_id", "key", "decides"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            out = [repair(t, lex, dict(r) if r else NO_RARE) for t, r in zip(b.column("text").to_pylist(), b.column("rare").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("rec_id"), pa.array(out, pa.string())], names=["tab", "rec_id", "text"])

    known = known_rare(texts.mapInArrow(ask, "tab string, rec_id bigint, key string, decides boolean"), rare)
    return texts.join(known, ["tab", "rec_id"], "left").mapInArrow(scan, "tab string, rec_id bigint, text string")
