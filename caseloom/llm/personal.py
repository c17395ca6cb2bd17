"""Problem 10: personal information in free text, found and replaced by typed placeholders.

Weak supervision. Broad patterns give candidate spans, many of them false (numbers of invoices, beginnings of firms' names, any words with
capitals); one place can be a candidate of several kinds. For every candidate, labelers of three sorts (patterns, gazetteers, contexts) vote for, against, or abstain, and
often disagree. Expectation-maximisation over the counts of all vote patterns of the corpus estimates how reliable each labeler is, without
any labelled span, and gives each pattern a probability. On these soft labels a logistic classifier is trained from features of the
spans themselves (votes, shape, length, the words before and after), on a sample of SAMPLE spans of each kind; it decides on every span of the
corpus, and of overlapping spans the likeliest stays. Words that texts mostly write in lower case, counted over the
whole corpus, speak against a name.

What reaches the driver: vote patterns and their counts (at most 3^labelers per kind), the sample, words that make up WORD_SHARE of all or more,
and the gazetteer while it has at most GAZETTEER rows (ValueError beyond: give a smaller one).

Defined results: null and empty texts have no spans and stay as they are; positions count code points from 0, the end being exclusive;
spans of a row don't overlap; repeated rows are rows of their own (spans are listed once per id and place); texts may have any length; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

KINDS = ("email", "phone", "idnum", "address", "name")
SPAN = "struct<kind:string,start_pos:bigint,end_pos:bigint,votes:string,traits:array<int>>"
SCHEMA = f"doc_id bigint, spans array<{SPAN}>"
SAMPLE = 4_000  # spans of a kind that the classifier is trained on
TRAITS = 1 << 12
WORD_SHARE = 2e-6
GAZETTEER = 2_000_000
RANK = {"email": 0, "idnum": 1, "phone": 2, "address": 3, "name": 4}

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶŁĻŃŅŇŐŒŘŚŞŠŤŪŮŰŹŻŽ"
TITLES = set("mr mrs ms miss dr prof professor sir dame detective inspector sergeant officer judge captain herr frau m mme mlle monsieur madame sr sra srta señor señora don doña hr fr".split())
LEGAL = set("llc ltd gmbh plc group partners inc s.a s.a. sa ag limited incorporated corp co kg".split())
AT = re.compile(r"@|\s?[(\[]\s?at\s?[)\]]\s?| at (?=[A-Za-z0-9-]+ dot )", re.I)
SIGN = re.compile("@")
LOCAL = re.compile(r"(?:[A-Za-z0-9_%+-]+ dot )*[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]\Z", re.I)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?| dot )[A-Za-z0-9-]+)+", re.I)

MAIL_BEFORE = re.compile(r"(?:mail|contact|write|copy|cc|to|<|\(|\bat|\n)\W{0,4}\Z", re.I)
DOT = re.compile(r"\.|dot", re.I)

DIGITS = re.compile(r"(?:\+|\(\+?)?\d(?:(?:[ ./-]|\) ?| \(|-\()?\d){4,17}")
LETTERS_BEFORE = re.compile(r"\b(?!(?:ID|DNI|NIE|NIF|SSN|CPF|NIN|NINO)\b)[A-Z]{1,3} ?\Z")
LETTER_AFTER = re.compile(r" ?[A-Z](?![A-Za-z0-9])")
ID_HINTS = ("id", "ssn", "no", "n°", "º", "number", "nummer", "licen", "pass", "dni", "nie", "nif", "nr", "ausweis", "pesel", "cpf", "condu", "social", "permi", "nin", "schein")
EXTENSION = re.compile(r",?\s?(?:ext\.?|extension|x|poste|Durchwahl|Nst\.|int\.)\s?\d{1,5}\b", re.I)
PHONE_SHAPES = [
    re.compile(p + r"\Z")
    for p in (
        r"\+\d{10,13}", r"\+\d{2} \d(?: \d{2}){4}", r"\+\d{2} \(0\)\d{4} \d{6}", r"\+\d{2} \(0\)\d{2,3} \d{4} \d{4}", r"\+\d{2} \d{2,4} \d{3,5} \d{3,5}", r"\+\d{2} \d{2,4} \d{6,8}", r"\+1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}",
        r"\(\d{3}\) ?\d{3}-\d{4}", r"\d{3}([ .-])\d{3}\1\d{4}", r"0\d{1,2}(?:([ .])\d{2})(?:\1\d{2}){3}", r"0\d{2} \d{4} \d{4}", r"0\d{3} \d{3} \d{4}", r"0\d{4} \d{6}", r"0\d{2,4}/\d{6,8}", r"\(0\d{2,4}\) \d{3,4} \d{4}", r"0\d{2,4}-\d{6,8}",
        r"\+\d{2}-\d{2,4}-\d{3,4}-\d{4}", r"0\d-\d{4}-\d{4}", r"\+\d{2}(?: \d{2,3}){3,5}",
    )
]
PHONE_BEFORE = re.compile(r"(?:number|tel\.?:?|phone:?|rang|call(?:ed)?|mobile:?|fax:?|téléphone|teléfono|tel[eé]f\.?|telefon|unter|gave|\bau|\ben el|\bon|\bor|[/\n,])\s*\Z", re.I)
NOT_PERSONAL = re.compile(r"(?:invoice|batch|container|version|paragraph|serial|order|exhibit|machine|part|model|failed at|lot|rechnung|facture|factura|no\. of)\s*(?:no\.?|number|nr\.?|n°|#|:)?\s*\Z", re.I)
ID_BEFORE = re.compile(
    r"(?:\bID(?: card| no\.?| number)?|identity card|identity number|identification number|\bSSN|social security(?: number| no\.?)?|national insurance(?: number| no\.?)?|passport(?: number| no\.?)?|driving licen[cs]e|driver'?s licen[cs]e|tax (?:number|id)"
    r"|carte d[’']identité|passeport|sécurité sociale|permis de conduire|\bDNI|\bNIE|\bNIF|pasaporte|carn[eé] de conducir|permiso de conducir|seguridad social|cédula|ausweis(?:nummer)?|personalausweis(?:nummer)?|reisepass(?:nummer)?|führerschein(?:nummer)?|steuer-?id|sozialversicherungsnummer|\bPESEL|dowod\w*|\bCPF|\bNINO?)"
    r"\s*(?:no\.?|number|numéro|número|nummer|nr\.?|n°|n\.º|nº|#)?\s*[:=]?\s*\Z",
    re.I,
)
ID_SHAPE = re.compile(r"\d{3}-\d{2}-\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{11}|\d{8}|\d{6}-\d{4}|\d{7,8}[A-Z]|[A-Z]{1,3} ?\d{6,9} ?[A-Z]?|[A-Z]{2}(?: \d{2}){3} [A-Z]|\d{9,10}|\d{3} \d{3} \d{3}\Z")

_W = rf"[{UP}][\w’'-]*"
_TYPE = r"(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Cl|Terrace|Ter|Court|Ct|Place|Pl|Square|Sq|Way|Crescent|Gardens|Boulevard|Blvd|Hill|Row|Mews|ROAD|RD|STREET|ST|AVENUE|LANE|DRIVE|CLOSE|TERRACE)\b\.?"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|\d{5}(?:-\d{4})?)"
_SEP = r"(?:,\s?|\s?\n|\s)"
STREET_EN = re.compile(rf"(?:(?:Flat|Apt|Apartment|Unit|FLAT)\.? \d{{1,4}}[A-Z]?,?\s)?\d{{1,4}}[A-Za-z]? (?:{_W} ){{1,3}}?{_TYPE}(?:,? (?:Apt|Flat|Unit|Suite|APT)\.? \d{{1,4}}[A-Z]?)?(?P<rest>,?\s{_W}(?:{_SEP}{_POST})?)?")
NUMBERED = re.compile(rf"(?<![\w.,/$€-])\d{{1,4}}[A-Za-z]? (?=[{UP}])")
FLAT = re.compile(r"(?:Flat|Apt|Apartment|Unit|FLAT)\.? \d{1,4}[A-Z]?,?\s\Z")
STREET_FR = re.compile(rf"\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route)(?: (?:du|de la|de l['’]|des|de))? ?(?:{_W} ?){{1,3}}(?P<rest>,\s(?:\d{{5}} )?{_W})?", re.U)
STREET_ES = re.compile(rf"(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino)(?: (?:de la|de los|del|de))? (?:{_W} ?){{1,3}},? \d{{1,4}}(?:, \d{{1,2}}\.?º ?[A-Z]?)?(?P<rest>,\s(?:\d{{5}} )?{_W})?")
STREET_DE = re.compile(rf"(?:(?:Am|An der|Im|In der|Zum|Zur|Auf der) {_W}(?: {_W})?|{_W}(?:[ -]{_W}){{0,2}}?(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm)|{_W}(?: {_W})? (?:Straße|Str\.|Weg|Gasse|Platz|Allee)) \d{{1,4}} ?[a-z]?\b(?P<rest>,\s(?:\d{{5}} )?{_W})?")
STARTS = [
    (re.compile(r"\b\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route)\b"), STREET_FR, 0, ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "cours", "route")),
    (re.compile(r"\b(?:Calle|C/|Avda|Avenida|Plaza|Paseo|Camino)\b"), STREET_ES, 0, ("Calle", "C/", "Avda", "Avenida", "Plaza", "Paseo", "Camino")),
    (re.compile(rf"(?:\b(?:Am|Im|Zum|Zur|An der|In der|Auf der) {_W}(?: {_W})? \d|(?:straße|strasse|str\.|weg|gasse|platz|allee|Straße|Str\.|Weg|Gasse|Platz|Allee) \d)"), STREET_DE, 60, ("Am ", "Im ", "Zum ", "Zur ", "An der ", "In der ", "Auf der ", "straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "Straße ", "Str. ", "Weg ", "Gasse ", "Platz ", "Allee ")),
]
ADDRESS_BEFORE = re.compile(r"(?:lives at|residing at|resident at|living at|\bto|address:?|wohnhaft(?: in)?|demeure au|demeurant au|habite au|vive en|domiciliad[oa] en|\n|sent .{0,25} to)\s*\Z", re.I)

CAPS = re.compile(rf"(?<![\w])[{UP}](?:[\w’'-]*\w)?\.?(?:,?[ \n][{UP}](?:[\w’'-]*\w)?\.?)+")
TOKEN = re.compile(rf"[{UP}](?:[\w’'-]*\w)?\.?")
SPEAKER = re.compile(r"^\[[\d: ]+\] ([^\W\d_][^:\n\[\]]{2,50}?):", re.M)
NAME_BEFORE = re.compile(
    r"(?:contact|asked for|holder is|signature of|signed(?: by)?:?|signé :?|gezeichnet:?|firmado:?|témoin|testigo|contacto con|sich an|\bI,|regards,|faithfully,?|sincerely,?|grüßen,?|cordialement,|atentamente,|\n-- |dear|both|and|spoke to|called|attn:?|veuillez contacter|"
    r"\b(?:mr|mrs|ms|miss|dr|prof|detective|herr|frau|mme|m|sr|sra)\.?)\s*\Z",
    re.I,
)
NAME_AFTER = re.compile(r"\s*(?:, who lives|, residing|, wohnhaft|, born|,? (?:and|et|y|und) [" + UP + r"]|demeure|vive en|both\b|at \S+@|\bà l['’]adresse|\ben \S+[@\[(]|\(\S+|declare|:|\n|\.|\Z| said)", re.I)
SENTENCE_START = re.compile(r"(?:^|[.!?:]\s+|\n\s*)\Z")
FIRM_AFTER = re.compile(rf"(?:[ \n]{_W}){{0,3}}?[ \n](?:plc|LLC|Ltd|GmbH|Group|Partners|Inc|PLC|LTD|GMBH|GROUP|PARTNERS|INC|S\.A\.)(?!\w)")


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def emails(t: str) -> Iterator[tuple[int, int, str]]:
    spelt = any(x in t for x in ("(at", "[at", "(AT", "[AT", "( at", "[ at", " dot ", " DOT "))
    for m in (AT if spelt else SIGN).finditer(t):
        low = max(0, m.start() - 120)
        local = LOCAL.search(t[low : m.start()])
        if not local:
            continue
        domain = DOMAIN.match(t, m.end())
        if not domain:
            continue
        words = m.group().strip().lower() == "at"
        if words and AT.match(t, domain.end()):
            continue  # the word before an address that is spelt out
        start, end = low + local.start(), domain.end()
        tld = re.split(r"[\W_]+|dot ", domain.group())[-1]
        before = t[max(0, start - 24) : start]
        yield start, end, _vote(m.group() == "@") + _vote(tld.isalpha() and 2 <= len(tld) <= 6, True) + _vote(any(c.isalpha() for c in local.group()), True) + _vote(MAIL_BEFORE.search(before) is not None) + _vote(False, words and not DOT.search(domain.group()))


def numbers(t: str) -> Iterator[tuple[str, int, int, str]]:
    """Every longer number, as an identity number where a word of such kind is near, and as a phone number."""
    for m in DIGITS.finditer(t):
        s, e = m.span()
        value = m.group()
        near = t[max(0, s - 28) : s].lower()
        before = t[max(0, s - 48) : s]
        if any(h in near for h in ID_HINTS):
            a = s
            if t[s - 1 : s].isupper() or t[s - 2 : s - 1].isupper():
                x = LETTERS_BEFORE.search(t, max(0, s - 4), s)
                a = x.start() if x else s
            x = LETTER_AFTER.match(t, e)
            b = x.end() if x else e
            v = t[a:b]
            named, form, whole = ID_BEFORE.search(t[max(0, a - 48) : a]) is not None, ID_SHAPE.fullmatch(v) is not None, b == len(t) or not t[b].isalnum()
            if (named or form) and whole:
                yield "idnum", a, b, _vote(named, True) + _vote(form) + _vote(not v.startswith(("+", "(")), True) + _vote(False, NOT_PERSONAL.search(t[max(0, a - 32) : a]) is not None) + _vote(False, PHONE_BEFORE.search(before) is not None and not named)
        if len(value) < 8:
            continue
        if s and (t[s - 1].isalnum() or t[s - 1] in "$€£_@#"):
            continue
        joined = (s > 0 and t[s - 1] in ".,/-+" and not (t[s - 1] in ".,/" and t[s - 2 : s - 1].isspace())) or (e < len(t) and (t[e].isalnum() or (t[e] in "-_/" and t[e + 1 : e + 2].isalnum())))
        shape = any(p.match(value) for p in PHONE_SHAPES)
        if value.isdigit() and not shape:
            continue
        bad = NOT_PERSONAL.search(before[-32:]) is not None
        x = EXTENSION.match(t, e)
        yield "phone", s, x.end() if x else e, _vote(shape, True) + _vote(PHONE_BEFORE.search(before[-32:]) is not None) + _vote(x is not None or value[0] in "+(" or "/" in value) + _vote(False, bad) + _vote(False, joined) + _vote(False, ID_BEFORE.search(before) is not None)


def addresses(t: str) -> Iterator[tuple[int, int, str]]:
    def one(m: re.Match[str]) -> tuple[int, int, str]:
        before = t[max(0, m.start() - 40) : m.start()]
        return m.start(), m.end(), _vote(ADDRESS_BEFORE.search(before) is not None) + _vote(m["rest"] is not None, True) + _vote(re.search(r"\d{5}|\d[A-Z]{2}\Z", m["rest"] or "") is not None) + _vote(False, NOT_PERSONAL.search(before) is not None) + _vote(m.end() - m.start() > 14, m.end() - m.start() < 10)

    done = -1
    for m in NUMBERED.finditer(t):
        if m.start() < done:
            continue
        if full := STREET_EN.match(t, m.start()):
            if flat := FLAT.search(t, max(0, m.start() - 20), m.start()):
                full = STREET_EN.match(t, flat.start()) or full
            done = full.end()
            yield one(full)
    for anchor, pattern, back, gates in STARTS:
        if not any(g in t for g in gates):
            continue
        for m in anchor.finditer(t):
            if back:
                best = None
                for x in pattern.finditer(t, max(0, m.start() - back), min(len(t), m.end() + 60)):
                    if x.start() <= m.end() <= x.end() + 1 or x.start() <= m.start() < x.end():
                        best = x
                        break
                if best and best.start() >= done:
                    done = best.end()
                    yield one(best)
            elif x := pattern.match(t, m.start()):
                yield one(x)


class Names:
    """Names by a gazetteer of given names and surnames, forms, titles and contexts."""

    def __init__(self, given: set[str], last: set[str], common: set[str]) -> None:
        self.given, self.last, self.common = given, last, common - given - last

    def known_last(self, w: str) -> bool:
        return any(x in self.last for x in w.lower().split("-"))

    def spans(self, t: str) -> Iterator[tuple[int, int, str]]:
        given, last = self.given, self.last
        for m in SPEAKER.finditer(t):
            w = m.group(1).split()
            low = [x.strip(".,").lower() for x in w]
            if 2 <= len(w) <= 4 and (any(x in given for x in low) or (any(self.known_last(x) for x in low) and not low[0].isdigit())):
                skip = len(w[0]) + 1 if low[0] in TITLES else 0
                yield m.start(1) + skip, m.end(1), _vote(any(x in given for x in low), True) + _vote(any(self.known_last(x) for x in low), True) + "++" + _vote(True) + _vote(False, any(x in self.common for x in low)) + "0"
        for m in CAPS.finditer(t):
            text = m.group()
            base = m.start()
            parts = [(x.start() + base, x.end() + base, x.group()) for x in TOKEN.finditer(text)]
            n = len(parts)
            low = [p[2].rstrip(".").lower() for p in parts]
            initial = [len(p[2]) == 2 and p[2][1] == "." for p in parts]
            if not any(x in given or x in TITLES or k for x, k in zip(low, initial)):
                if n < 2 or t[parts[0][1] : parts[1][0]] not in (" ", "\n") or min(len(low[0]), len(low[1])) < 3 or (low[0] in self.common and low[1] in self.common) or not (self.known_last(low[1]) or NAME_BEFORE.search(t, max(0, base - 30), base)):
                    continue
                # no given name known, but a context or a surname speaks for it; others are for the words' use in the corpus to tell
                a, b = parts[0][0], parts[1][1] - parts[1][2].endswith(".")
                yield a, b, "-" + _vote(self.known_last(low[1]), True) + self.around(t, a, b, False, low[:2])
                continue
            i = 0
            while i < n:
                s, e, w = parts[i]

                def sep(k: int) -> str:
                    return t[parts[k][1] : parts[k + 1][0]] if k + 1 < n else ""

                def surname(k: int) -> bool:
                    return k < n and len(low[k]) > 2 and not initial[k] and low[k] not in LEGAL and low[k] not in TITLES

                end_i = -1
                start_i = i
                if low[i] in TITLES and not (len(low[i]) == 1 and t[max(0, s - 2) : s - 1].isdigit()) and i + 1 < n and sep(i) in (" ", "\n") :
                    # a title isn't part of the name
                    if surname(i + 1) and low[i + 1] not in given and not (i + 2 < n and sep(i + 1).startswith(",") and low[i + 2] in given):
                        start_i, end_i = i + 1, i + 1
                    elif len(low[i]) > 1:
                        i += 1
                        continue
                if end_i < 0 and surname(i) and low[i] not in given and i + 1 < n and (sep(i) == ", " or (sep(i) == ",\n" and self.known_last(low[i]))) and (low[i + 1] in given or (initial[i + 1] and low[i] in last)) and not (surname(i + 2) and sep(i + 1) in (" ", "\n") and low[i + 2] in last and (initial[i + 1] or not parts[i + 1][2].endswith("."))):
                    end_i = i + 1
                    if i + 2 < n and initial[i + 2] and sep(i + 1) == " ":
                        end_i = i + 2
                if end_i < 0 and (initial[i] or (low[i] in given and not w.endswith("."))):
                    k = i + 1
                    while k < n and initial[k] and sep(k - 1) in (" ", "\n") and k - i < 3:
                        k += 1
                    if surname(k) and sep(k - 1) in (" ", "\n"):
                        if low[k] not in given or low[k] in last:
                            end_i = k
                if end_i < 0 and i == 0 and n >= 2 and surname(0) and surname(1) and sep(0) in (" ", "\n") and NAME_BEFORE.search(t[max(0, base - 30) : base]) and low[0] not in last:
                    end_i = 1
                if end_i < 0:
                    i += 1
                    continue
                a, b = parts[start_i][0], parts[end_i][1]
                if t[b - 1 : b] == "." and not initial[end_i]:
                    b -= 1
                names = [low[j] for j in range(start_i, end_i + 1)]
                votes = _vote(any(x in given for x in names), not any(initial[start_i : end_i + 1]) and start_i == i) + _vote(any(self.known_last(x) for x in names), True)
                yield a, b, votes + self.around(t, a, b, start_i > i, names)
                i = end_i + 1

    def around(self, t: str, a: int, b: int, titled: bool, names: list[str]) -> str:
        """Votes of contexts, of the number of words, of how the corpus uses the words, and of the words after."""
        firm = t[b : b + 1] in (" ", "\n") and FIRM_AFTER.match(t, b) is not None
        return (
            _vote(titled or NAME_BEFORE.search(t[max(0, a - 30) : a]) is not None)
            + _vote(NAME_AFTER.match(t[b : b + 30]) is not None)
            + _vote(len(names) > 1)
            + _vote(False, any(x in self.common for x in names))
            + _vote(False, firm)
        )


def traits(t: str, kind: str, s: int, e: int, votes: str) -> list[int]:
    """Features of a span, hashed: its votes one by one and in pairs of labelers, shape, length, number of words, the words beside it."""
    before, after = BEFORE.search(t, max(0, s - 24), s), AFTER.match(t, e, e + 24)
    return [*of_votes(kind, votes), *of_form(kind, t[s:e] if kind != "name" else str(t.count(" ", s, e)) + t[e - 1 : e]), trait(kind, "b", before[1] if before else ""), trait(kind, "a", after[1] if after else "")]


@lru_cache(maxsize=100_000)
def trait(kind: str, sort: str, value: str) -> int:
    return crc32(f"{kind}{sort}{value.lower()}".encode()) % TRAITS


@lru_cache(maxsize=10_000)
def of_votes(kind: str, votes: str) -> list[int]:
    return [*(trait(kind, f"v{k}", c) for k, c in enumerate(votes)), trait(kind, "p", votes)]


@lru_cache(maxsize=100_000)
def of_form(kind: str, v: str) -> list[int]:
    shape = SAME.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in v[:24]))
    return [trait(kind, "s", shape), trait(kind, "l", str(min(len(v) // 4, 12))), trait(kind, "w", str(min(v.count(" "), 6)))]


BEFORE = re.compile(r"(\w+|[^\w\s])\s*\Z")
AFTER = re.compile(r"\s*(\w+|[^\w\s])")
SAME = re.compile(r"(.)\1+")


def spans_of(t: str, names: Names) -> list[tuple[str, int, int, str, list[int]]]:
    """All candidate spans of a text with their votes and traits."""
    out: list[tuple[str, int, int, str]] = []
    if "@" in t or "at" in t or "AT" in t:
        out += [("email", *x) for x in emails(t)]
    out += [("address", *x) for x in addresses(t)]
    out += list(numbers(t))
    out += [("name", *x) for x in names.spans(t)]
    return [(*x, traits(t, *x)) for x in dict.fromkeys(out)]


def apart(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of spans that overlap, one: the surer one, the longer one among equals."""
    kept: list[tuple[str, int, int, float]] = []
    for x in sorted(spans, key=lambda x: (x[1], RANK[x[0]])):
        if kept and x[1] < kept[-1][2]:
            y = kept[-1]
            better = RANK[x[0]] < RANK[y[0]] if (x[3] > 0.9) == (y[3] > 0.9) and x[0] != y[0] else x[3] > y[3] + 0.05 or (x[3] > y[3] - 0.05 and x[2] - x[1] > y[2] - y[1])
            if better:
                kept[-1] = x
            continue
        kept.append(x)
    return kept


def source_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null and text <> ''"))


def common_words(texts: DataFrame) -> set[str]:
    """The words that the corpus writes in lower case three times as often as with a capital inside a sentence."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                count.update(USED.findall(t))
            if len(count) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
                count.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    table = cut(texts.select("text").mapInArrow(scan, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "personal-words")
    lower = F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0)
    both = table.groupBy(F.lower("word").alias("word")).agg(F.sum(lower).alias("low"), F.sum(F.col("n") - lower).alias("up"))
    least = WORD_SHARE * (table.agg(F.sum("n")).first()[0] or 0)
    return {r["word"] for r in both.filter((F.col("low") > least) & (F.col("low") >= 3 * F.col("up"))).select("word").collect()}


USED = re.compile(r"(?<=[^\W\d_] )[^\W\d_]{3,}")  # words inside a sentence


def candidates(df: DataFrame, gazetteer_: tuple[set[str], set[str], set[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every text that has a candidate span."""
    shared = df.sparkSession.sparkContext.broadcast(gazetteer_)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(*shared.value)
        for b in batches:
            ids, rows = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if found_ := spans_of(t, names):
                    ids.append(d)
                    rows.append(found_)
            flat = [x for r in rows for x in r]
            k, s, e, v, f = zip(*flat) if flat else ([],) * 5
            struct = pa.StructArray.from_arrays([pa.array(k, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(v, pa.string()), pa.array(f, pa.list_(pa.int32()))], names=["kind", "start_pos", "end_pos", "votes", "traits"])
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, struct)], names=["doc_id", "spans"])

    return source_of(df, id_col, text_col).mapInArrow(scan, SCHEMA)


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: the posterior of each, and each labeler's share of right votes."""
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p, _ in patterns])
    count = np.array([n for _, n in patterns], float)
    plus, minus = votes == 1, votes == -1
    # a labeler that only ever speaks against is made for exceptions, so its votes weigh more at the start; EM then finds what each is worth
    against = np.where(plus.any(0), 1.5, 4.0)
    post = 1 / (1 + np.exp(-np.clip(plus.sum(1) - minus @ against - 0.5, -30, 30)))
    # rates of +, - and abstaining in true and false spans; priors keep labelers better than chance
    for _ in range(rounds):
        w1, w0 = count * post, count * (1 - post)
        prior = (w1.sum() + 5) / (count.sum() + 6)

        def rates(w: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p, m, z = (w[:, None] * plus).sum(0) + a, (w[:, None] * minus).sum(0) + b, (w[:, None] * ~(plus | minus)).sum(0) + 2
            total = p + m + z
            return p / total, m / total, z / total

        scale = 0.02 * count.sum() + 5
        t1, t0 = rates(w1, scale, 0.5), rates(w0, 0.5, scale)
        lr = np.log(prior / (1 - prior)) + (plus * np.log(t1[0] / t0[0])).sum(1) + (minus * np.log(t1[1] / t0[1])).sum(1) + (~(plus | minus) * np.log(t1[2] / t0[2])).sum(1)
        post = 1 / (1 + np.exp(-np.clip(lr, -30, 30)))
    right = ((count * post)[:, None] * plus + (count * (1 - post))[:, None] * minus).sum(0) / np.maximum((count[:, None] * (plus | minus)).sum(0), 1e-9)
    return post, right


def labels(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Probability of each vote pattern by EM."""
    return dict(zip([k for k, _ in patterns], map(float, reliabilities(patterns)[0]))) if patterns else {}


def trained(ids: np.ndarray, label: np.ndarray, rounds: int = 150, shrink: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over hashed traits (rows of ids), the last weight being the constant. label: probabilities."""
    w, seen = np.zeros(TRAITS + 1), np.full(TRAITS + 1, 1e-8)
    x = np.concatenate([ids, np.full((len(ids), 1), TRAITS)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        grad = np.bincount(x.ravel(), np.repeat((p - label) / len(x), x.shape[1]), TRAITS + 1) + shrink * w
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    return w


Model = dict[str, np.ndarray]


def learn(spans: DataFrame, sample: int = SAMPLE) -> tuple[Model, dict[tuple[str, str], float]]:
    """The classifier of each kind, and the probabilities of the vote patterns that it was trained on. spans: (doc_id, spans)."""
    flat = spans.select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")
    counts = flat.groupBy("kind", "votes").count().collect()  # at most 3^7 patterns a kind
    soft = {(k, v): p for k in KINDS for v, p in labels(sorted((r["votes"], r["count"]) for r in counts if r["kind"] == k)).items()}
    model: Model = {}
    for k in KINDS:
        # a sample by hash: the same rows whatever the partitions
        rows = flat.filter(F.col("kind") == k).orderBy(F.xxhash64("doc_id", "start_pos", "end_pos"), "doc_id", "start_pos", "end_pos").limit(sample).select("votes", "traits").collect()
        if rows:
            model[k] = trained(np.array([r["traits"] for r in rows], np.int64), np.array([soft[k, r["votes"]] for r in rows]))
    return model, soft


def probabilities(model: Model, spans: list[tuple[str, int, int, str, list[int]]]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, probability) of the accepted spans of a text."""
    out = []
    for kind, s, e, _, f in spans:
        w = model[kind]
        p = 1 / (1 + np.exp(-(w[f].sum() + w[-1]))) if kind in model else 0.0
        if p >= 0.5:
            out.append((kind, s, e, float(p)))
    return apart(out)


def decided(spans: DataFrame, model: Model) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of the spans that the classifier accepts; spans of a text are decided on where they are, without a shuffle."""
    shared = spans.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lists = b.column("spans")
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            kinds = flat.field("kind").to_pylist()
            ids = flat.field("traits")
            width = ids.value_lengths().to_numpy(zero_copy_only=False)
            values = ids.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat([KINDS.index(k) for k in kinds], width) if len(kinds) else np.empty(0, int)
            table = np.stack([m.get(k, np.full(TRAITS + 1, -9.0)) for k in KINDS])
            score = np.bincount(np.repeat(np.arange(len(kinds)), width), table[owner, values], len(kinds)) + table[[KINDS.index(k) for k in kinds], TRAITS] if len(kinds) else np.empty(0)
            starts, ends = flat.field("start_pos").to_pylist(), flat.field("end_pos").to_pylist()
            p = (1 / (1 + np.exp(-np.clip(score, -30, 30)))).tolist()
            out, at = [], 0
            for d, n in zip(b.column("doc_id").to_pylist(), sizes.tolist()):
                out += [(d, k, s, e) for k, s, e, _ in apart([(kinds[i], starts[i], ends[i], p[i]) for i in range(at, at + n) if p[i] >= 0.5])]
                at += n
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "kind", "start_pos", "end_pos"])

    return spans.mapInArrow(scan, "doc_id bigint, kind string, start_pos bigint, end_pos bigint")


def gazetteer(documents: DataFrame, roster: DataFrame, nicknames: DataFrame, text_col: str = "text", most: int = GAZETTEER) -> tuple[set[str], set[str], set[str]]:
    """Given names (with short forms) and surnames of people on a roster, and the common words of the corpus. All rows count; above `most` rows it is an error."""
    if roster.limit(most + 1).count() > most or nicknames.limit(most + 1).count() > most:
        raise ValueError(f"a gazetteer of more than {most} rows")
    rows = roster.filter("kind = 'person' and full_name is not null").select("full_name").collect()
    parts = [r["full_name"].split() for r in rows]
    short = nicknames.collect()
    given = {p[0].lower() for p in parts if p} | {x.lower() for r in short for x in (r["formal"], r["short"]) if x}
    return given, {x for p in parts if len(p) > 1 for x in p[-1].lower().split("-")}, common_words(source_of(documents.withColumn("doc_id", F.lit(0)), "doc_id", text_col))


def found(documents: DataFrame, roster: DataFrame, nicknames: DataFrame) -> DataFrame:
    """p10_found."""
    spans = cut(candidates(documents, gazetteer(documents, roster, nicknames)), "personal-spans")
    return decided(spans, learn(spans)[0]).distinct()


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with [KIND] in place of each span."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, roster: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(doc_id, text) with placeholders. Texts are redacted in the scan, with the classifier at hand; nothing is shuffled."""
    words = gazetteer(documents, roster, nicknames)
    model, _ = learn(cut(candidates(documents, words), "personal-spans"))
    shared = documents.sparkSession.sparkContext.broadcast((words, model))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, m = shared.value
        names = Names(*words_)
        for b in batches:
            texts = [t if not t else redact(t, [(s, e, k) for k, s, e, _ in probabilities(m, spans_of(t, names))]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(put, "doc_id bigint, text string")
