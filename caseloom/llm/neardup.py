"""Problem 2: records that share most of their words, found by covering locality-sensitive hashing.

A record is the set of its different words. Two sets A, B with Jaccard similarity of at least t differ in at most
r = (|A| + |B|)(1 - t)/(1 + t) words, a Hamming radius. A family for radius r has G = (r + 1)/2 + 1 groups of words and, in each group,
the three non-zero masks of two bits: every word has a group and a two-bit code that isn't zero, and mask v keeps the words whose code
has an odd product with it. If at most one word of a group differs, one of its masks keeps none of the differing words, and the masked
sets are equal. As r differing words spoil at most r/2 groups by two or more each, every pair within the radius collides in at least two
groups of G: not a single pair is lost, whatever the data. A record whose size allows only s < r differing words is hashed in the first s/2 + 2 groups
alone: its pairs spoil at most s/2 of those.

Large buckets (above `bucket_cap`, from masks that kept only words everybody uses) aren't compared inside, nor are masks that kept no word,
whose key says nothing: those rows are spread by record, not by key. A pair that collides only there does so in two groups, so the members are hashed again by
each two such keys of different groups, of which at most one kept no word. Records left over (in buckets that are large again, or
with two groups of which nothing was kept) are compared by shared triples (pairs, for longer sets) of their rarest words: two sets that are alike share at
least ceil(t n) of n words, so at least three of the n - ceil(t n) + 3 first ones in any common order. Inside buckets, 64-bit parity
sketches, whose distance never exceeds that of the sets, discard most pairs; the rest are verified on the words themselves.

Exact copies are one representative throughout and are only expanded in the result; hot texts cost a row each, not a pair each.

Defined results: null and empty fields count as no words; records under `min_words` different words are in no pair; repeated rows of one id
count once; an empty table gives an empty result; further columns are ignored. The threshold is a fraction and compared in integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

WORD = re.compile(r"[^\W_]+")
BUCKET_CAP = 2048
NON_REPS_BROADCAST = 500_000
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
EMPTY = 1 << 31  # info: the size from bit 32, this bit, the family's number from bit 24, the group
TRIPLES_UP_TO = 24  # words of a set up to which triples are used
COMMON_SHARE = 1e-3
SHARED_BITS = 1 << 23  # a table of bits for the words that more than one record holds; where two words meet, a key too many is made, none is lost
ID_BITS = 27  # a table of bits for ids has 2^27 of them at most: 16 MB
ODD = np.array([0, 1, 1, 0], dtype=bool)  # parity of a two-bit product


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _sets(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the different words of each text, end to end, and how many each has."""
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = set(WORD.findall(t.lower())) if t else ()
        sizes[i] = len(words)
        flat += [hashes[w] for w in words]
    return np.array(flat, np.uint64), sizes


def _reduce(op: np.ufunc, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """op over each set; none is empty."""
    return op.reduceat(values, np.concatenate(([0], np.cumsum(sizes)[:-1])))


def radius(total: int | np.ndarray, t: Fraction) -> int | np.ndarray:
    """The most words two sets of that many words together can differ in at similarity t."""
    return total * (t.denominator - t.numerator) // (t.denominator + t.numerator)


def families(n: int, largest: int, t: Fraction) -> list[int]:
    """The radii (2^k - 1) of the families in which a set of n words can have a partner."""
    low = radius(n + -(-n * t.numerator // t.denominator), t)
    high = radius(n + min(n * t.denominator // t.numerator, largest), t)
    first, last = (max(2, int(x).bit_length()) for x in (low, max(low, high)))
    return [2**k - 1 for k in range(first, last + 1)]


def groups_of(n: int, r: int, largest: int, t: Fraction) -> int:
    """In how many of the first groups of a family a set of n words is hashed: its pairs differ in so few words that two of those are left."""
    return min(r, radius(n + min(n * t.denominator // t.numerator, largest), t)) // 2 + 2


def texts_of(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.concat_ws(" ", *text_cols).alias("text"))


def fingerprints(texts: DataFrame, min_words: int) -> DataFrame:
    """(id, h1, h2, n): a 128-bit hash of each word set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            flat, sizes = _sets(b.column("text").to_pylist(), hashes)
            keep = sizes >= min_words
            flat, ids = flat[np.repeat(keep, sizes)], b.column("id").filter(pa.array(keep))
            sizes = sizes[keep]
            h1, h2 = (_reduce(np.add, x, sizes).view(np.int64) if len(sizes) else np.empty(0, np.int64) for x in (flat, (flat ^ (flat >> np.uint64(29))) * C1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1), pa.array(h2), pa.array(sizes)], names=["id", "h1", "h2", "n"])

    return texts.mapInArrow(scan, "id bigint, h1 bigint, h2 bigint, n bigint")


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is in ids (a stored table, column id), and few others: looked up in a table of bits, for which df isn't shuffled.

    The table has 16 bits or more for each id, up to 2^ID_BITS; where two ids meet, a row too many is kept, none is lost.
    """
    size = min(ID_BITS, max(16, (16 * ids.count()).bit_length()))
    at = F.shiftrightunsigned(F.xxhash64("id"), 64 - size)
    blocks = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << size - 6, np.int64)
    bits[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)
        for b in batches:
            at = b.column("at").to_numpy()
            yield b.drop_columns(["at"]).filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return df.withColumn("at", at).mapInArrow(scan, df.schema)


def keys_of(texts: DataFrame, min_words: int, largest: int, t: Fraction) -> DataFrame:
    """(key, id, sketch, info): each record under every mask of its families. info packs the set's size, whether the mask kept nothing, family and group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            flat, sizes = _sets(b.column("text").to_pylist(), hashes)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for r in sorted({r for n in set(sizes.tolist()) if n >= min_words for r in families(n, largest, t)}):
                fits = np.array([n >= min_words and r in families(n, largest, t) for n in sizes.tolist()], dtype=bool)
                words, n, own = flat[np.repeat(fits, sizes)], sizes[fits], ids[fits]
                upto = np.array([groups_of(x, r, largest, t) for x in n.tolist()])
                sketch = _reduce(np.bitwise_xor, np.uint64(1) << (words & np.uint64(63)), n).view(np.int64)
                groups = (r + 1) // 2 + 1
                group = ((words >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
                code = (1 + (words >> np.uint64(8)) % np.uint64(3)).astype(np.int64)
                for g in range(upto.max()):
                    mine = group == g
                    here = upto > g
                    for v in (1, 2, 3):
                        through = mine & ODD[code & v]
                        kept = _reduce(np.add, np.where(through, words, np.uint64(0)), n)
                        nothing = ~_reduce(np.logical_or, through, n)
                        slot = np.uint64(((r << 32) + g * 4 + v) * int(C1) & (2**64 - 1))
                        key = (kept ^ (kept >> np.uint64(31))) * C2 + slot
                        info = (n << 32) + nothing * EMPTY + (int(r).bit_length() << 24) + g
                        yield pa.RecordBatch.from_arrays([pa.array(x[here]) for x in (key.view(np.int64), own, sketch, info)], names=["key", "id", "sketch", "info"])

    return texts.mapInArrow(scan, "key bigint, id bigint, sketch bigint, info bigint")


def _pairs(key: np.ndarray, ident: np.ndarray, sketch: np.ndarray, info: np.ndarray, cap: int, t: Fraction) -> tuple[np.ndarray, ...]:
    """Of complete buckets, sorted by key: the pairs their sketches allow, and the rows of large buckets."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(first, len(key)))
    large = np.repeat(length > cap, length)
    left = np.repeat(first + length, length) - np.arange(len(key))  # rows from here to the bucket's end
    at = np.flatnonzero(~large & (left > 1))
    n = info >> 32
    out_a, out_b = [], []
    d = 1
    while len(at):
        to = at + d
        near = np.bitwise_count((sketch[at] ^ sketch[to]).view(np.uint64)) <= radius(n[at] + n[to], t)
        if near.any():
            a, b = ident[at[near]], ident[to[near]]
            out_a.append(np.minimum(a, b)), out_b.append(np.maximum(a, b))
        d += 1
        at = at[left[at] > d]
    none = np.empty(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none]), large


def compare(keys: DataFrame, cap: int, t: Fraction) -> DataFrame:
    """(a, b) of each pair of a bucket that may be alike; for large buckets (a, null, key, sketch, info) of each row instead."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        running = None  # the key of a bucket already known to be large
        names = ["key", "id", "sketch", "info"]

        def out(a, b, key=None, sketch=None, info=None):
            n = len(a)
            null = pa.nulls(n, pa.int64())
            cols = [pa.array(a), null if b is None else pa.array(b), *(null if x is None else pa.array(x) for x in (key, sketch, info))]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "sketch", "info"])

        def flush(rows: list[np.ndarray]):
            a, b, large = _pairs(*rows, cap, t)
            if len(a):
                pair = np.unique(np.stack([a, b], axis=1), axis=0)
                yield out(pair[:, 0], pair[:, 1])
            if large.any():
                yield out(rows[1][large], None, rows[0][large], rows[2][large], rows[3][large])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            nothing = (cols[3] & EMPTY) != 0
            if nothing.any():
                yield out(cols[1][nothing], None, cols[0][nothing], cols[2][nothing], cols[3][nothing])
                cols = [c[~nothing] for c in cols]
                if not len(cols[0]):
                    continue
            if running is not None:
                stop = int(np.searchsorted(cols[0], running, "right"))
                if stop:
                    yield out(cols[1][:stop], None, cols[0][:stop], cols[2][:stop], cols[3][:stop])
                cols = [c[stop:] for c in cols]
                if not len(cols[0]):
                    continue
                running = None
            held.append(cols)
            size += len(cols[0])
            if size < 100_000:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            start = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last bucket may go on
            if start:
                yield from flush([c[:start] for c in rows])
            rest = [c[start:] for c in rows]
            if len(rest[0]) > cap:
                running = rest[0][0]
                yield out(rest[1], None, rest[0], rest[2], rest[3])
                rest = [c[:0] for c in rest]
            held, size = [rest], len(rest[0])
        rows = [np.concatenate(c) for c in zip(*held)] if held else []
        if rows and len(rows[0]):
            yield from flush(rows)

    place = F.when(F.col("info").bitwiseAND(EMPTY) != 0, F.xxhash64("id")).otherwise(F.col("key"))
    spread = keys.repartition(place).sortWithinPartitions("key")
    return spread.mapInArrow(scan, "a bigint, b bigint, key bigint, sketch bigint, info bigint")


def shared_words(n: int, t: Fraction) -> int:
    """How many words two sets, the larger of n words, are asked to share."""
    return min(3 if n <= TRIPLES_UP_TO else 2, -(-n * t.numerator // t.denominator))


def by_rare_words(texts: DataFrame, t: Fraction, min_words: int = 1) -> DataFrame:
    """(key, id, sketch, info): each record of min_words or more under every triple (pair, for longer sets) of its first words in the order of rising frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, n = _Hashes(), Counter(), 0
        for b in batches:
            flat, sizes = _sets(b.column("text").to_pylist(), hashes)
            seen.update(flat.view(np.int64).tolist())
            n += len(sizes)
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.int64()), pa.array([*seen.values(), n], pa.int64())], names=["word", "n"])

    texts = cut(texts, "neardup-rest-texts")
    counted = cut(texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "neardup-rest-words")
    total = counted.filter("word is null").agg(F.sum("n")).first()[0] or 0
    # words of a share of COMMON_SHARE and more: at most the mean size of a set, divided by it; others are in the order of their hashes
    common = {r["word"]: r["n"] for r in counted.filter(F.col("word").isNotNull() & (F.col("n") > COMMON_SHARE * total)).collect()}
    # a word of one record only is shared with no other
    at = F.col("word").bitwiseAND(SHARED_BITS - 1)
    blocks = counted.filter("word is not null and n > 1").groupBy(F.shiftright(at, 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(word & 63 as int))")).alias("bits")).collect()  # SHARED_BITS / 64 rows at most
    bits = np.zeros(SHARED_BITS >> 6, np.int64)
    for r in blocks:
        bits[r["block"]] = r["bits"]
    shared = texts.sparkSession.sparkContext.broadcast((common, bits))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        common, bits = shared.value
        for b in batches:
            flat, sizes = _sets(b.column("text").to_pylist(), hashes)
            several = (bits[(flat & np.uint64(SHARED_BITS - 1)) >> np.uint64(6)].view(np.uint64) >> (flat & np.uint64(63)) & np.uint64(1)).astype(bool)
            key, own, sketch, info = [], [], [], []
            start = 0
            for i, n in zip(b.column("id").to_pylist(), sizes.tolist()):
                words = flat[start : start + n]
                alone = set(words[~several[start : start + n]].view(np.int64).tolist())
                start += n
                if n < max(1, min_words):
                    continue
                # how many words must be shared is a matter of the larger of the two sets, so one record may need several kinds of keys
                kinds = {shared_words(max(n, m), t) for m in range(-(-n * t.numerator // t.denominator), n * t.denominator // t.numerator + 1)}
                order = sorted(words.view(np.int64).tolist(), key=lambda w: (common.get(w, 0), w))
                s = np.bitwise_xor.reduce(np.uint64(1) << (words & np.uint64(63))).view(np.int64)
                least = -(-n * t.numerator // t.denominator)
                for k in kinds:
                    first = [w for w in order[: n - least + k] if w not in alone]
                    made = {hash((k, *x)) for x in combinations(sorted(first), k)}
                    key += made
                    own += [i] * len(made)
                    sketch += [int(s)] * len(made)
                    info += [n << 32] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own, pa.int64()), pa.array(sketch, pa.int64()), pa.array(info, pa.int64())], names=["key", "id", "sketch", "info"])

    return texts.mapInArrow(keys, "key bigint, id bigint, sketch bigint, info bigint")


def candidates(texts: DataFrame, min_words: int, largest: int, t: Fraction, cap: int = BUCKET_CAP) -> DataFrame:
    """Different pairs (a, b), a < b, of representatives: all that are alike, and few others."""
    one = cut(compare(keys_of(texts, min_words, largest, t), cap, t), "neardup-buckets")
    large = one.filter("b is null")
    low = F.col("info").bitwiseAND(0xFFFFFFFF)
    per_record = large.groupBy("a").agg(
        F.collect_set(F.struct("key", (low.bitwiseAND(0xFFFFFF)).alias("g"), F.shiftright(low.bitwiseAND(0x7F000000), 24).alias("k"), (low.bitwiseAND(EMPTY) != 0).alias("e"))).alias("ks"),  # at most three for each group
        F.first("sketch").alias("sketch"), F.first(F.col("info").bitwiseAND(~0xFFFFFFFF)).alias("info"),
    )
    per_record = cut(per_record, "neardup-large")
    both = "flatten(transform(ks, x -> transform(filter(ks, y -> y.g > x.g and y.k = x.k and not (x.e and y.e)), y -> xxhash64(x.key, y.key))))"
    again = per_record.select(F.expr(f"explode({both})").alias("key"), F.col("a").alias("id"), "sketch", "info")
    two = cut(compare(again, cap, t), "neardup-buckets2")
    bare = per_record.filter("exists(ks, x -> x.e and exists(ks, y -> y.e and y.k = x.k and y.g > x.g))").select("a")
    rest = cut(two.filter("b is null").select("a").union(bare).distinct().withColumnRenamed("a", "id"), "neardup-rest")
    three = cut(compare(by_rare_words(only(texts, rest), t, min_words), cap, t), "neardup-buckets3")
    left = three.filter("b is null").select("key", "a", "sketch", "info")
    x, y = left.alias("x"), left.alias("y")
    limit = ((F.shiftright(F.col("x.info"), 32) + F.shiftright(F.col("y.info"), 32)) * (t.denominator - t.numerator) / (t.denominator + t.numerator)).cast("double")
    full = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.a") < F.col("y.a")) & (F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= limit))
    pairs = one.filter("b is not null").select("a", "b").union(two.filter("b is not null").select("a", "b")).union(three.filter("b is not null").select("a", "b")).union(full.select("x.a", "y.a"))
    return pairs.filter("a < b").distinct()  # a repeated row isn't a pair


def verified(pairs: DataFrame, texts: DataFrame, min_words: int, t: Fraction) -> DataFrame:
    """The pairs (a stored table) whose word sets have min_words or more and are alike by at least t."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            flat, sizes = _sets(b.column("text").to_pylist(), hashes)
            low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
            ends = np.cumsum(sizes) * 4
            words = [low[e - 4 * s : e] for e, s in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(words, pa.binary())], names=["id", "words"]).filter(pa.array(sizes >= min_words))

    sets = only(texts, pairs.select(F.explode(F.array("a", "b")).alias("id"))).mapInArrow(scan, "id bigint, words binary")
    with_a = pairs.join(sets.withColumnsRenamed({"id": "a", "words": "wa"}), "a")
    with_b = with_a.join(sets.withColumnsRenamed({"id": "b", "words": "wb"}), "b").select("a", "b", "wa", "wb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist()):
                n = (len(x) + len(y)) // 4
                common = len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), assume_unique=True))
                keep.append(common * t.denominator >= (n - common) * t.numerator)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_b.mapInArrow(check, "a bigint, b bigint").distinct()


def links(df: DataFrame, id_col: str, text_cols: list[str], t: Fraction, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of each record with copies, and the pairs (a, b) of representatives that are alike."""
    texts = texts_of(df, id_col, text_cols)
    prints = cut(fingerprints(texts, min_words), "neardup-prints")
    classes = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"))
    members = cut(prints.join(classes.filter("c > 1"), ["h1", "h2"]).select("id", "rep").distinct(), "neardup-members")
    largest = prints.agg(F.max("n")).first()[0] or 0
    copies = members.filter("id <> rep").select("id")
    n_copies = copies.limit(NON_REPS_BROADCAST + 1).count()
    if n_copies:
        texts = texts.join(F.broadcast(copies) if n_copies <= NON_REPS_BROADCAST else copies, "id", "left_anti")
    pairs = cut(candidates(texts, min_words, largest, t), "neardup-pairs")
    return members, cut(verified(pairs, texts, min_words, t), "neardup-links")


def found(df: DataFrame, id_col: str, text_cols: list[str], t: Fraction = Fraction(3, 4), min_words: int = 8) -> DataFrame:
    """(id_a, id_b) of p2_found: all pairs of records alike by at least t, copies expanded."""
    members, pairs = links(df, id_col, text_cols, t, min_words)
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    between = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    within = a.join(b, F.col("a") == F.col("b")).filter("ia < ib").select(F.col("ia").alias("x"), F.col("ib").alias("y"))
    both = between.union(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def classes(df: DataFrame, id_col: str, text_cols: list[str], t: Fraction = Fraction(3, 4), min_words: int = 8) -> DataFrame:
    """One row per record: the class of its exact copies (smallest id) and how many other classes are alike."""
    members, pairs = links(df, id_col, text_cols, t, min_words)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    ids = df.select(F.col(id_col).cast("long").alias("id")).distinct().join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    return ids.join(degree, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
