"""Problem 6: items above a size limit, cut into pieces under it at natural boundaries, with a stated overlap.

Texts and files are worked on in ranges: a worker sees its range and a halo, never a whole giant item.

1. measure: each range gives its length and its unbroken runs at both edges and inside; the tables of ranges are stitched per item
   (the edge runs of neighbours add up) and the lengths are summed to prefixes, so that each range knows its offset.
2. cut: in each range after the first there is a synchronising cut, the best natural boundary within a piece's length from the range's
   start; a worker finds its own and, in the halo, the next range's. Between the two it cuts one piece after another: at the last boundary
   of the best kind (blank line, line end, sentence end, blank) in the latter half of what may still belong to the piece, else in the
   former half, else at the limit. An item of one range is cut without a synchronising cut.
3. emit: a piece runs from the cut before it, less the overlap, to its own cut. Consecutive pieces share exactly `overlap` characters. Pieces are numbered
   by counts per range and their prefix sums.

Defined results: null and empty texts give no piece; a text within the limit is one piece; a null limit means no limit (one piece);
limits count code points; an overlap of half the limit or more, or a limit of half a range or more, is an error, nothing is lowered silently; repeated ids give pieces
for each row; other columns are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

RANGE_CHARS = 1 << 18
UNBROKEN = re.compile(r"[A-Za-z0-9+/=]+")
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t\r\f]*\n+", r"\n+", r"[.!?…。！？]['\"”’)\]]*\s+|[。！？]", r"\s+")]

MEASURE = "range_no int, n_chars bigint, head bigint, tail bigint, longest bigint"


def _runs(text: str) -> tuple[int, int, int, int]:
    """Length, unbroken run at the head, at the tail, and the longest."""
    longest = head = tail = 0
    for m in UNBROKEN.finditer(text):
        n = m.end() - m.start()
        longest = max(longest, n)
        if m.start() == 0:
            head = n
        if m.end() == len(text):
            tail = n
    return len(text), head, tail, longest


def ranged(source: DataFrame, range_chars: int, before: Column | int = 0, after: Column | int = 0) -> DataFrame:
    """source (row, text, ...) with a row for each range of a text: range_no, first (the offset of the text given), own (the offset of the range), total.

    Texts of one range stay where they are; ranges of longer ones, with their halos, are spread over all tasks.
    """
    before, after = (x if isinstance(x, Column) else F.lit(x) for x in (before, after))
    sized = source.withColumn("total", F.length("text").cast("long"))
    one = sized.filter(F.col("total") <= range_chars).withColumns({"range_no": F.lit(0), "first": F.lit(0).cast("long"), "own": F.lit(0).cast("long")})
    many = sized.filter(F.col("total") > range_chars).withColumn("range_no", F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / range_chars).cast("int"))))
    own = F.col("range_no").cast("long") * range_chars
    many = many.withColumn("own", own).withColumn("first", F.greatest(own - before, F.lit(0).cast("long")))
    many = many.withColumn("text", F.substring("text", (F.col("first") + 1).cast("int"), (F.col("own") - F.col("first") + range_chars + after).cast("int")))
    cores = source.sparkSession.sparkContext.defaultParallelism
    return one.select(*many.columns).unionByName(many.repartition(4 * cores, "row", "range_no"))


def measure(texts: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), range_chars: int = RANGE_CHARS) -> DataFrame:
    """id, keep, n_chars, longest_run of each non-null text: scanned in ranges, stitched by offset."""
    source = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(k).alias(f"k_{k}") for k in keep], F.col(text_col).alias("text"))
    source = source.withColumn("row", F.monotonically_increasing_id())  # tells rows of one id apart
    kept = [f.name for f in source.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text") + ", " + MEASURE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_runs(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), b.column("range_no"), *(pa.array(c, pa.int64()) for c in cols)], names=[*kept, "range_no", "n_chars", "head", "tail", "longest"])

    source = ranged(source, range_chars).select(*kept, "range_no", "text")
    ranges = source.mapInArrow(scan, schema)
    one = F.struct("range_no", "n_chars", "head", "tail", "longest")
    # texts of one range, by far the most, need no stitching; the first range of a longer one has range_chars characters
    single = ranges.filter((F.col("range_no") == 0) & (F.col("n_chars") < range_chars)).select("id", *[c for c in kept if c.startswith("k_")], "n_chars", F.col("longest").alias("longest_run"))
    parts = ranges.filter((F.col("range_no") > 0) | (F.col("n_chars") >= range_chars)).groupBy(*kept).agg(F.array_sort(F.collect_list(one)).alias("parts"))
    stitched = parts.select(
        "id",
        *[c for c in kept if c.startswith("k_")],
        F.expr(
            "aggregate(parts, named_struct('n', 0L, 'tail', 0L, 'longest', 0L), (s, p) -> named_struct('n', s.n + p.n_chars,"
            " 'tail', if(p.tail = p.n_chars, s.tail + p.tail, p.tail), 'longest', greatest(s.longest, p.longest, s.tail + p.head)))"
        ).alias("s"),
    ).select("id", *[c for c in kept if c.startswith("k_")], F.col("s.n").alias("n_chars"), F.col("s.longest").alias("longest_run"))
    both = single.unionByName(stitched)
    return both.select(F.col("id"), *[F.col(f"k_{k}").alias(k) for k in keep], "n_chars", "longest_run")


def held_overlap(limit: int, overlap: int) -> int:
    """The overlap, which must be less than half the limit."""
    if overlap < 0 or limit <= 0 or 2 * overlap >= limit:
        raise ValueError(f"overlap {overlap} isn't from 0 to less than half the limit {limit}")
    return overlap


def _last(window: str) -> int:
    """Where to cut in a window: after the last boundary of the best kind; 0 if there is none."""
    for pattern in BOUNDARIES:
        last = 0
        for m in pattern.finditer(window):
            last = m.end()
        if last:
            return last
    return 0


def _next_cut(text: str, at: int, step: int) -> int:
    """The cut after the one at `at`: at most step further, in the latter half if it has a boundary."""
    half = at + step // 2
    if k := _last(text[half : at + step]):
        return half + k
    return at + (_last(text[at:half]) or step)


def _sync(text: str, at: int, step: int) -> int:
    """The synchronising cut of a range that begins at `at`."""
    return at + _last(text[at : at + step])


def range_cuts(text: str, first: int, own: int, total: int, range_chars: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a range, by offsets in the item. text: the item from `first` on, as far as the next range's synchronising cut may lie."""
    step = limit - overlap
    begin = 0 if own == 0 else first + _sync(text, own - first, step)
    following = own + range_chars
    end = total if following >= total else first + _sync(text, following - first, step)
    out, at = [], begin
    while True:
        # the first piece of an item has no overlap before it
        room = limit if at == 0 else step
        if end - at <= room:
            if end > at:
                out.append((at, end))
            break
        cut = first + _next_cut(text, at - first, room)
        out.append((at, cut))
        at = cut
    return [(max(0, s - overlap) if s else 0, e) for s, e in out]


def halo(limit: int, overlap: int) -> tuple[int, int]:
    """Characters before and after a range that its worker needs."""
    return overlap, limit - overlap


def pieces_of(text: str, limit: int | None, overlap: int | None, range_chars: int = RANGE_CHARS) -> list[tuple[int, int, int]]:
    """(piece_no, start, end) of a text: what the ranges give together."""
    n = len(text)
    if limit is None or n <= limit:
        return [(0, 0, n)] if n else []
    o = held_overlap(limit, overlap or 0)
    every = [x for own in range(0, n, range_chars) for x in range_cuts(text, 0, own, n, range_chars, limit, o)]
    return [(k, s, e) for k, (s, e) in enumerate(every)]


def split(texts: DataFrame, id_col: str, text_col: str, limit_col: str, overlap_col: str, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(text_id, piece_no, start_pos, end_pos, piece) of each text; pieces in order have their overlap in common. range_chars must be more than any limit's double."""
    source = texts.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"), F.col(limit_col).cast("int").alias("size_limit"), F.coalesce(F.col(overlap_col).cast("int"), F.lit(0)).alias("overlap"))
    source = source.withColumn("row", F.monotonically_increasing_id())
    id_type = source.schema["text_id"].dataType.simpleString()
    bad = F.col("size_limit").isNotNull() & ((F.col("size_limit") <= 0) | (F.col("overlap") < 0) | (2 * F.col("overlap") >= F.col("size_limit")) | (2 * F.col("size_limit") >= range_chars))
    source = source.withColumn("size_limit", F.when(bad, F.raise_error(F.concat(F.lit("overlap or limit out of range: "), F.col("overlap").cast("string"), F.lit(", "), F.col("size_limit").cast("string")))).otherwise(F.col("size_limit")))
    some = F.coalesce("size_limit", F.lit(0))
    # a text without a limit, or within it, is one piece and needs no ranges
    whole = F.col("size_limit").isNull() | (F.length("text") <= F.col("size_limit"))
    single = source.filter(whole).select("text_id", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("start_pos"), F.length("text").cast("long").alias("end_pos"), F.col("text").alias("piece"))
    ranges = ranged(source.filter(~whole), range_chars, F.col("overlap"), some)

    def cut_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, s, e, piece = [], [], [], [], []
            for i, (t, n, o, f, own, total) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "size_limit", "overlap", "first", "own", "total")))):
                for k, (x, y) in enumerate(range_cuts(t, f, own, total, range_chars, n, o)):
                    at.append(i), no.append(k), s.append(x), e.append(y), piece.append(t[x - f : y - f])
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(rows), b.column("text_id").take(rows), b.column("range_no").take(rows), b.column("own").take(rows), b.column("total").take(rows), pa.array(no, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(piece, pa.string())],
                names=["row", "text_id", "range_no", "own", "total", "k", "start_pos", "end_pos", "piece"],
            )

    cut_ = ranges.mapInArrow(cut_range, f"row bigint, text_id {id_type}, range_no int, own bigint, total bigint, k bigint, start_pos bigint, end_pos bigint, piece string")
    long = cut(cut_.filter(F.col("total") > range_chars), "split-pieces")
    # pieces before a range: prefix sums over the ranges of one text
    counts = long.groupBy("row", "range_no").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("row", "range_no", (F.sum("n").over(Window.partitionBy("row").orderBy("range_no")) - F.col("n")).alias("base"))
    numbered = long.join(base, ["row", "range_no"]).select("text_id", (F.col("base") + F.col("k")).alias("piece_no"), "start_pos", "end_pos", "piece")
    short = cut_.filter(F.col("total") <= range_chars).select("text_id", F.col("k").alias("piece_no"), "start_pos", "end_pos", "piece")
    return single.unionByName(short).unionByName(numbered)


def split_file(spark: SparkSession, path: str, limit: int, overlap: int, range_bytes: int = 1 << 24) -> DataFrame:
    """(piece_no, start_pos, end_pos, piece) of one giant UTF-8 file that all workers can open at path.

    The file is never loaded whole: pass one counts the characters of each byte range, a running sum gives each range its first
    character; pass two reads a range with a halo and cuts it; counts of pieces are summed to numbers. Ranges are of characters that begin in a byte range.
    """
    import os

    held_overlap(limit, overlap)
    if 8 * limit >= range_bytes:
        raise ValueError("a range must be longer than eight limits")
    size = os.path.getsize(path)
    starts = spark.range(0, max(1, -(-size // range_bytes)), 1, max(1, min(10_000, -(-size // range_bytes)))).select((F.col("id") * range_bytes).alias("lo"))

    def aligned(f, pos: int, stop: int) -> tuple[int, bytes]:
        """The bytes from pos to stop, both moved on to the first byte of a character."""
        f.seek(pos)
        data = f.read(stop - pos + 4)
        first = 0
        while first < len(data) and data[first] & 0xC0 == 0x80:
            first += 1
        last = min(stop - pos, len(data))
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        return pos + first, data[first:last]

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                lo = b.column("lo").to_pylist()
                n = [len(aligned(f, x, min(size, x + range_bytes))[1].decode("utf-8", "replace")) for x in lo]
                yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(n, pa.int64())], names=["lo", "n"])

    table = starts.mapInArrow(lengths, "lo bigint, n bigint").toPandas().sort_values("lo")  # a row for each range: size / range_bytes rows
    total = int(table.n.sum())
    table["base"] = table.n.cumsum() - table.n
    bases = spark.createDataFrame([(k, int(lo), int(base), int(n)) for k, (lo, base, n) in enumerate(zip(table.lo, table.base, table.n))], "range_no int, lo bigint, base bigint, n bigint").repartition(max(1, len(table)), "lo")
    before, after = (4 * x for x in halo(limit, overlap))  # bytes: at most four for a character

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                out: list[tuple[int, int, int, int, str]] = []
                for r, lo, base, n in zip(*(b.column(c).to_pylist() for c in ("range_no", "lo", "base", "n"))):
                    _, head = aligned(f, max(0, lo - before), lo) if lo else (0, b"")
                    _, own = aligned(f, lo, min(size, lo + range_bytes))
                    _, tail = aligned(f, min(size, lo + range_bytes), min(size, lo + range_bytes + after))
                    ahead = head.decode("utf-8", "replace")
                    text, first = ahead + own.decode("utf-8", "replace") + tail.decode("utf-8", "replace"), base - len(ahead)
                    if total <= limit:
                        out += [(r, 0, 0, total, text)] if base == 0 and total else []
                        continue
                    out += [(r, k, x, y, text[x - first : y - first]) for k, (x, y) in enumerate(range_cuts(text, first, base, total, n, limit, overlap))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, [pa.int32(), *[pa.int64()] * 3, pa.string()])], names=["range_no", "k", "start_pos", "end_pos", "piece"])

    pieces = cut(bases.mapInArrow(emit, "range_no int, k bigint, start_pos bigint, end_pos bigint, piece string"), "split-file")
    counts = pieces.groupBy("range_no").agg(F.count(F.lit(1)).alias("m"))
    offset = counts.select("range_no", (F.sum("m").over(Window.orderBy("range_no")) - F.col("m")).alias("before"))  # a row for each range
    return pieces.join(F.broadcast(offset), "range_no").select((F.col("before") + F.col("k")).alias("piece_no"), "start_pos", "end_pos", "piece")


def limits(registry: DataFrame, config: DataFrame) -> DataFrame:
    """fingerprint, max_chars, overlap of each registered file whose type has a limit. config is a fixed table, broadcast while it has at most 10,000 rows."""
    types = registry.filter(F.col("fingerprint").isNotNull() & F.col("file_type").isNotNull()).groupBy("fingerprint").agg(F.min("file_type").alias("file_type"))
    sizes = config.groupBy("file_type").agg(F.min("max_chars_per_chunk").alias("max_chars"), F.min_by("chunk_overlap", "max_chars_per_chunk").alias("overlap"))
    if config.limit(10_001).count() <= 10_000:
        sizes = F.broadcast(sizes)
    return types.join(sizes, "file_type").select("fingerprint", "max_chars", "overlap")


def oversized(text_cache: DataFrame, registry: DataFrame, config: DataFrame) -> DataFrame:
    """(text_id, kind) of p6_found: texts above the limit of their file's type, and those with an unbroken run above it."""
    sized = measure(text_cache, "id", "extracted_text", ("fingerprint",)).join(limits(registry, config), "fingerprint").filter(F.col("n_chars") > F.col("max_chars"))
    kinds = F.when(F.col("longest_run") > F.col("max_chars"), F.array(F.lit("oversized"), F.lit("unbreakable"))).otherwise(F.array(F.lit("oversized")))
    return sized.select(F.col("id").alias("text_id"), F.explode(kinds).alias("kind")).distinct()
