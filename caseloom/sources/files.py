"""Files as a source: scanning, fingerprints, change detection, and extraction with hooks for kinds no library here can read."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import file_kind

EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "bmp", "tiff", "tif", "mp3", "wav", "mp4", "m4a", "m4v", "ogg", "flac", "txt", "md", "json", "xml", "csv"]


def listing(spark: SparkSession, root: str, glob: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Files under a directory with their content, name, extension and kind; unknown kinds are kept and marked."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (r.option("pathGlobFilter", glob) if glob else r).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    df = df.withColumns({"file_name": name, "extension": ext, "kind": file_kind(ext)})
    if max_depth is not None:
        below = F.regexp_replace(F.regexp_replace("path", r"^\w+:/+", "/"), "^" + re.escape(re.sub(r"^\w+:/+", "/", root).rstrip("/")) + "/", "")
        df = df.filter(F.size(F.split(below, "/")) <= max_depth)
    return df


def fingerprint(content: Column) -> Column:
    """SHA-256 of the whole content."""
    return F.sha2(content, 256)


def edge_fingerprint(content: Column, length: Column) -> Column:
    """SHA-256 of the first 64 KiB, and of the last as well above 128 KiB."""
    head = F.substring(content, 1, 65536)
    return F.sha2(F.when(length > 131072, F.concat(head, F.substring(content, -65536, 65536))).otherwise(head), 256)


def stamped_fingerprint(df: DataFrame) -> DataFrame:
    """df with a fingerprint over length, modification time in seconds and content, and its length after a hyphen."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, n, t in zip(b.column("content").to_pylist(), b.column("length").to_pylist(), b.column("modificationTime").to_pylist()):
                out.append(f"{hashlib.sha256(struct.pack('<QQ', n, int(t.timestamp())) + data).hexdigest()}-{n}")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], names=["path", "stamped"])

    return df.select("path", "content", "length", "modificationTime").mapInArrow(scan, "path string, stamped string")


def scan(spark: SparkSession, root: str, registry: DataFrame) -> DataFrame:
    """The files under root whose content isn't registered yet, one row for each content."""
    files = listing(spark, root).select("path", "file_name", "kind", "length", "modificationTime", fingerprint(F.col("content")).alias("fingerprint"))
    first = files.groupBy("fingerprint").agg(F.min_by(F.struct("path", "file_name", "kind", "length", "modificationTime"), "path").alias("r")).select("fingerprint", "r.*")
    return first.join(registry.select("fingerprint").distinct(), "fingerprint", "left_anti")


def changes(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Each listed file with its priority: 0 new, 1 modified, 2 extracted but not processed, 3 to be run again. Files are identified by path."""
    r = registry.groupBy("path").agg(F.max("last_modified").alias("known"), F.max(F.coalesce("has_extracted_text", F.lit(False))).alias("has_text"), F.max(F.coalesce("processed", F.lit(False))).alias("done"))
    j = files.join(r, "path", "left")
    return j.select("path", F.when(F.col("done").isNull(), 0).when(F.col("modificationTime") > F.col("known"), 1).when(F.col("has_text") & ~F.col("done"), 2).otherwise(3).alias("priority"))


def decode_windows(data: bytes) -> str:
    """Bytes as Windows-1252; unused ones stay control signs."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode("cp1252"))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def read_text(data: bytes) -> tuple[str, str]:
    """The text and its encoding: by byte order mark, else UTF-8 if valid, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name.removesuffix("-sig")
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return decode_windows(data), "windows-1252"


def read_docx(data: bytes) -> str:
    """The text runs of a word processor file, joined by blanks; ValueError if there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    text = " ".join(x.text for x in root.iter() if x.tag.endswith("}t") and x.text)
    if not text.strip():
        raise ValueError("no text")
    return text


def read_rtf(data: bytes) -> str:
    """The plain text of a simple RTF file."""
    t = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), data.decode("latin-1"))
    return re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", re.sub(r"\\par[d]?\b", "\n", t)).strip()


Extractor = Callable[[bytes, str], str]
RESULT = "path string, file_name string, kind string, text string, encoding string, char_count bigint, word_count bigint, status string, error string"


def pages_until(pages: list[str], enough: int = 500) -> str:
    """Pages in order until enough bytes are read."""
    out, size = [], 0
    for p in pages:
        if size >= enough:
            break
        out.append(p)
        size += len(p.encode())
    return "\n".join(out)


def page_count(text: Column) -> Column:
    """Pages by form feeds."""
    return F.size(F.split(F.coalesce(text, F.lit("")), "\f"))


def needs_ocr(text: str | None, least_bytes: int = 100) -> bool:
    """Is a page file a scan: has its own text layer hardly any text?"""
    return len((text or "").strip().encode("utf-8", "replace")) < least_bytes


def scanned_or_text(text_layer: Extractor, page_reader: Callable[[bytes, str], Iterator[str]], enough: int = 500) -> Extractor:
    """A hook for page files: the text layer where there is one, else the pages as read one by one until enough is read. Pages that fail count as empty."""

    def read(data: bytes, name: str) -> str:
        text = text_layer(data, name)
        if not needs_ocr(text):
            return text
        pages, size, it = [], 0, iter(page_reader(data, name))
        while size < enough:
            try:
                page = next(it)
            except StopIteration:
                break
            except Exception:
                page = ""
            pages.append(page)
            size += len(page.encode("utf-8", "replace"))
            if len(pages) > 10_000:
                break
        return "\n".join(pages)

    return read


def binarised(grey: np.ndarray) -> np.ndarray:
    """A page image (rows of grey levels from 0 to 255) in black and white: stretched to full contrast, cut at the level that parts the two best (Otsu)."""
    g = grey.astype(np.float64)
    low, high = (np.percentile(g, q) for q in (1, 99)) if g.size else (0.0, 0.0)
    g = np.clip((g - low) * 255.0 / max(high - low, 1e-9), 0, 255).astype(np.uint8)
    count = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    below, mean = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (mean / below - (mean[-1] - mean) / above) ** 2
    return np.where(g > int(np.nanargmax(np.nan_to_num(apart))), 255, 0).astype(np.uint8) if g.size else g.astype(np.uint8)


def skew(page: np.ndarray, most: float = 5.0, step: float = 0.5) -> float:
    """By how many degrees a black and white page is turned: the angle at which its rows differ most in ink. Positive: lines fall to the right."""
    y, x = np.nonzero(page < 128)
    if not len(y):
        return 0.0

    def sharp(angle: float) -> float:
        rows = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        return float((np.bincount(rows - rows.min()).astype(np.float64) ** 2).sum())

    return float(max(np.arange(-most, most + step / 2, step), key=lambda a: (sharp(a), -abs(a))))


def straightened(page: np.ndarray, angle: float) -> np.ndarray:
    """The page turned back by an angle: each column is moved up or down; what leaves the page is white."""
    out = np.full_like(page, 255)
    for x in range(page.shape[1]):
        d = int(round(x * np.tan(np.radians(angle))))
        src = page[max(d, 0) : page.shape[0] + min(d, 0), x]
        out[max(-d, 0) : max(-d, 0) + len(src), x] = src
    return out


PDF_ERRORS = (("password", r"(?i)password|encrypt"), ("corrupt", r"(?i)corrupt|eof|xref|malformed|invalid|trailer"), ("too_large", r"(?i)too large|size limit"))


def error_class(error: Column) -> Column:
    """What kind of failure an extraction's message tells of: password, corrupt, too_large, or other."""
    out = F.lit("other")
    for name, pattern in reversed(PDF_ERRORS):
        out = F.when(error.rlike(pattern), name).otherwise(out)
    return F.when(error.isNotNull(), out)


def extract(files: DataFrame, hooks: dict[str, Extractor] | None = None) -> DataFrame:
    """The text of each listed file by its kind. Kinds without a reader of their own (pdf, image, audio, video) use hooks; failures become rows with a status."""
    hooks = hooks or {}

    def one(data: bytes, name: str, kind: str) -> tuple[str, str | None]:
        if kind in hooks:
            return hooks[kind](data, name), None
        if kind == "text":
            if name.lower().endswith(".rtf"):
                return read_rtf(data), "windows-1252"
            return read_text(data)
        if kind == "docx":
            return read_docx(data), None
        raise ValueError(f"no extractor for {kind}")

    def scan_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, name, kind, data in zip(*(b.column(c).to_pylist() for c in ("path", "file_name", "kind", "content"))):
                try:
                    text, encoding = one(data, name, kind)
                    text = text.strip()
                    rows.append((path, name, kind, text, encoding, len(text.encode("utf-8", "replace")), len(text.split()), "ok", None))
                except Exception as e:
                    rows.append((path, name, kind, None, None, None, None, "error", str(e)))
            types = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 2
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 9, types)], names=names)

    return files.select("path", "file_name", "kind", "content").mapInArrow(scan_, RESULT)
