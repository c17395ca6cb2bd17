"""Column helpers with the engine's null and arithmetic rules: division by zero and unreadable dates give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FROM = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőřśşšťùúûüūůűýÿźżž"
TO = "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorssstuuuuuuuyyzzz"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def alive() -> Column:
    """Rows that aren't soft-deleted."""
    return ~F.coalesce(F.col("is_deleted"), F.lit(False))


def to_day(x: str | Column) -> Column:
    """A text as a date where it begins with a real one in ISO form, else null."""
    x = c(x)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(x, 1, 10).try_cast("date"))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def weight(cap: bool = False) -> Column:
    """Evidence weight: severity over five, confidence and quality, by 0.4, 0.35 and 0.25; severity counts one at most if capped."""
    severity = F.coalesce(F.col("severity_score"), F.lit(0)).cast("double") / 5.0
    if cap:
        severity = F.least(severity, F.lit(1.0))
    return severity * 0.4 + F.coalesce("confidence", F.lit(0.5)) * 0.35 + F.coalesce("quality_score", F.lit(0.5)) * 0.25


def folded(x: str | Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c(x)), FROM, TO)


def tokens(x: str | Column) -> Column:
    """The words of a text, folded; null gives none."""
    return F.array_remove(F.split(folded(F.coalesce(c(x), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def words(x: str | Column) -> Column:
    """Blank-separated words in lower case, each once."""
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(F.coalesce(c(x), F.lit("")))), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def parsed_location(x: str | Column) -> Column:
    """struct(lat, lon) of the first two numbers of a text if they are coordinates, else null."""
    pattern = r"(-?[0-9]+\.?[0-9]*)[,\s]+(-?[0-9]+\.?[0-9]*)"
    lat, lon = (F.regexp_extract(c(x), pattern, k).try_cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def file_kind(extension: Column) -> Column:
    """The kind of a file by its extension."""
    kinds = {"pdf": ["pdf"], "image": ["jpg", "jpeg", "png", "bmp", "tiff", "tif"], "audio": ["mp3", "wav", "m4a", "ogg", "flac"], "video": ["mp4", "m4v"], "docx": ["docx", "doc"], "text": ["txt", "md", "json", "xml", "csv", "rtf"]}
    out = F.lit("unknown")
    for kind, exts in kinds.items():
        out = F.when(F.lower(extension).isin(exts), kind).otherwise(out)
    return out


def duration_seconds(size: Column, extension: Column) -> Column:
    """Estimated playing time of an audio file from its size and its format's usual bit rate."""
    ext = F.lower(extension)
    rate = F.when(ext == "wav", 1411).when(ext == "flac", 800).otherwise(128)
    return size * 8 / (rate * 1000.0)
