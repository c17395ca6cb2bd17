"""Problem 7: dates and times in many notations, normalised to one unambiguous form.

An ordered cascade of anchored patterns with strict parsing. A pattern that matches decides: its fields either give a valid day or
instant, or the value has no reading. The zone of a time without one comes from a look-up of the source; local times that the clocks
skipped or showed twice have no single reading and give null (the policy is the parameter ``fold_policy``: "reject", "earlier" or
"later").

Defined results: null, empty, blank, or unparseable values give null; a value that already is in normal form gives itself; rows are
neither dropped nor added; repeated rows each get their result; the input may be empty and may have any further columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full month names and the usual short forms; the first three letters of the English ones are added below.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
MONTH_NO = {name: k + 1 for names in MONTHS.values() for k, name in enumerate(names.split())}
MONTH_NO |= {name[:3]: k + 1 for k, name in enumerate(MONTHS["en"].split())} | {"sept": 9}

NORMAL = r"^(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)$"

_MON = r"(?P<mon>[^\W\d_]+)\.?"
_DAY = r"(?P<d>\d{1,2})"
_YEAR = r"(?P<y>\d{4})"
_WEEKDAY = r"(?:[^\W\d_]+\.?,?\s+)?"
_HMS = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_AMPM = r"(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?:(?P<z>[Zz])|(?P<off>[+-]\d{2}:?\d{2})(?:\[(?P<reg>[\w/+-]+)\])?|\[(?P<reg2>[\w/+-]+)\]|\(?(?P<abbr>[A-Z]{2,5})\)?))?"
_TIME = rf"(?:(?:\s+at\s+|,?\s+){_HMS}{_AMPM}{_ZONE})?"

CASCADE: list[tuple[str, re.Pattern[str]]] = [
    (kind, re.compile(pattern + r"\Z"))
    for kind, pattern in (
        ("ymd", rf"{_YEAR}-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:T|\s+){_HMS}{_AMPM}{_ZONE})?"),
        ("ymd", rf"{_YEAR}(?P<sep>[/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TIME}"),
        ("ymd", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:T?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,](?P<f>\d{1,9}))?(?P<z>Z)?(?P<off>[+-]\d{2}:?\d{2})?)?"),
        ("unix", r"(?P<unix>\d{10}|\d{13}|\d{16})"),
        ("numeric", rf"(?P<a>\d{{1,2}})(?P<sep>[./-])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{4}}|\d{{2}}){_TIME}"),
        ("named", rf"{_WEEKDAY}{_DAY}\.?[\s-]+{_MON}[\s-]+{_YEAR}(?:,\s+(?P<H>\d{{1,2}})[.](?P<M>\d{{2}})\s?[hH])"),
        ("named", rf"{_WEEKDAY}{_DAY}\.?[\s-]+{_MON}[\s-]+{_YEAR}{_TIME}"),
        ("named", rf"{_WEEKDAY}{_MON}\s+{_DAY}(?:st|nd|rd|th)?,?\s+{_YEAR}{_TIME}"),
        ("named", rf"(?:[Tt]he\s+)?{_DAY}(?:st|nd|rd|th|er|º|ª)?\s+(?:of\s+|de\s+|d')?{_MON}\s+(?:of\s+|de\s+|del\s+)?{_YEAR}{_TIME}"),
    )
]

UTC = timezone.utc


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=4096)
def _abbreviations(zone: str, year: int) -> dict[str, timedelta]:
    """The abbreviations in use in a zone in a year, with their offsets."""
    z = _zone(zone)
    found: dict[str, timedelta] = {}
    for month in range(1, 13):
        t = datetime(year, month, 15, 12, tzinfo=z)
        found[t.tzname() or ""] = t.utcoffset() or timedelta(0)
    return found


def _format(t: datetime) -> str:
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}.{t.microsecond // 1000:03d}Z"


def _days(g: dict[str, str | None], kind: str, order: str | None) -> set[tuple[int, int, int]]:
    """The valid days the fields can mean."""
    if kind == "numeric":
        a, b, c = g["a"] or "", g["b"] or "", g["c"] or ""
        orders = [order] if order else ["DMY", "MDY", "YMD"]
        read = []
        for o in orders:
            if o == "YMD":
                if len(c) == 2 and len(a) == 2:
                    read.append((2000 + int(a), int(b), int(c)))
            else:
                y = int(c) + (2000 if len(c) == 2 else 0)
                read.append((y, int(b), int(a)) if o == "DMY" else (y, int(a), int(b)))
    elif kind == "named":
        m = MONTH_NO.get((g["mon"] or "").lower())
        read = [(int(g["y"] or 0), m, int(g["d"] or 0))] if m else []
    else:
        read = [(int(g["y"] or 0), int(g["m"] or 0), int(g["d"] or 0))]
    valid = set()
    for y, m, d in read:
        try:
            date(y, m, d)
        except ValueError:
            continue
        valid.add((y, m, d))
    return valid


def _instant(day: tuple[int, int, int], g: dict[str, str | None], zone: str | None, fold_policy: str) -> str | None:
    h, mi, s = int(g["H"] or 0), int(g["M"] or 0), int(g.get("S") or 0)
    if ap := g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if ap in "Pp" else 0)
    micro = int(((g.get("f") or "") + "000000")[:6])
    try:
        local = datetime(*day, h, mi, s, micro)
    except ValueError:
        return None
    try:
        if g.get("z"):
            return _format(local)
        if off := g.get("off"):
            delta = timedelta(hours=int(off[1:3]), minutes=int(off[-2:]))
            return _format(local - (delta if off[0] == "+" else -delta)) if int(off[1:3]) < 24 and int(off[-2:]) < 60 else None
        if abbr := g.get("abbr"):
            if abbr in ("UTC", "GMT"):
                return _format(local)
            known = _abbreviations(zone, local.year) if zone and _zone(zone) else {}
            return _format(local - known[abbr]) if abbr in known else None
        z = _zone(g.get("reg2") or zone or "") if (g.get("reg2") or zone) else None
        if z is None:
            return None
        first, second = (local.replace(tzinfo=z, fold=k).astimezone(UTC) for k in (0, 1))
        if first != second and fold_policy == "reject":
            return None  # shown twice, or skipped
        return _format(max(first, second) if fold_policy == "later" else min(first, second))
    except (OverflowError, ValueError):
        return None


def normal_form(value: str | None, zone: str | None = None, order: str | None = None, fold_policy: str = "reject") -> str | None:
    """The one reading of value in normal form, or None."""
    text = (value or "").strip()
    if not text or len(text) > 80:  # no notation is longer
        return None
    for kind, pattern in CASCADE:
        if not (m := pattern.match(text)):
            continue
        g = m.groupdict()
        if kind == "unix":
            n = g["unix"] or "0"
            micros = int(n) * 10 ** (16 - len(n))
            return _format(datetime(1970, 1, 1) + timedelta(microseconds=micros))
        days = _days(g, kind, order)
        if len(days) != 1:
            return None
        (day,) = days
        if g.get("H"):
            return _instant(day, g, zone, fold_policy)
        return f"{day[0]:04d}-{day[1]:02d}-{day[2]:02d}"
    return None


def normal_form_column(value: Column, zone: Column, order: Column, fold_policy: str = "reject") -> Column:
    """normal_form over Arrow batches. Each distinct (value, zone, order) of a batch is read once."""

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str | None, str | None, str | None], str | None] = {}
        for v, z, o in batches:
            if len(known) > 200_000:
                known.clear()
            out = []
            for key in zip(v, z, o):
                if key not in known:
                    known[key] = normal_form(*key, fold_policy=fold_policy)
                out.append(known[key])
            yield pd.Series(out, dtype=object)

    return read(value, zone, order)


def with_source(df: DataFrame, file_name: str, sources: DataFrame, zone: str = "zone_name", order: str = "date_order") -> DataFrame:
    """Adds zone and date order of the source whose code and an underscore begin the file name, or nulls.

    sources is a fixed table of sites; it is broadcast only while it has at most 10,000 rows (a join by hash otherwise).
    """
    # of several rows of one code the least, so results don't depend on the order of rows
    codes = sources.groupBy(F.col("source_code").alias("__code")).agg(F.min(F.struct("zone_name", "date_order")).alias("s")).select("__code", F.col("s.zone_name").alias(zone), F.col("s.date_order").alias(order))
    if sources.limit(10_001).count() <= 10_000:
        codes = F.broadcast(codes)
    return df.join(codes, F.substring_index(df[file_name], "_", 1) == F.col("__code"), "left").drop("__code")


def normalise(df: DataFrame, value: str, file_name: str, sources: DataFrame, out: str = "normal_form", fold_policy: str = "reject") -> DataFrame:
    """df with a column out: the normal form of the column value, or null where it has no single reading.

    Values in normal form already pass through in the JVM; only the others are sent to Python.
    """
    known = with_source(df, file_name, sources, "__zone", "__order")
    is_normal = F.coalesce(F.col(value).rlike(NORMAL), F.lit(False))
    read = normal_form_column(F.when(~is_normal, F.col(value)), F.col("__zone"), F.col("__order"), fold_policy)
    day_ok = F.expr(f"try_cast(substr(`{value}`, 1, 10) as date)").isNotNull()
    return known.withColumn(out, F.when(is_normal & day_ok, F.col(value)).when(~is_normal, read)).drop("__zone", "__order")


def readings(df: DataFrame, value: str, file_name: str, sources: DataFrame) -> DataFrame:
    """The rows whose value isn't yet in normal form and has a single reading, with it in normal_form. Others never reach Python."""
    todo = df.filter(F.col(value).isNotNull() & (F.trim(F.col(value)) != "") & ~F.col(value).rlike(NORMAL))
    known = with_source(todo, file_name, sources, "__zone", "__order")
    read = known.withColumn("normal_form", normal_form_column(F.col(value), F.col("__zone"), F.col("__order")))
    return read.filter(F.col("normal_form").isNotNull()).drop("__zone", "__order")
