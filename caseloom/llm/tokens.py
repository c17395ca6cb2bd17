"""Problem 8: every text as token ids of a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern. The words a partition hasn't met yet are encoded together: a pair occurrence
index maps each adjacent pair that has a merge to all its positions in all these words; the active ranks are applied in
ascending order, each at all its positions, and the lists of the neighbouring pairs are updated. Known words are looked up.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; a text's length isn't limited; rows
stay as they are (repeated ids are repeated rows); other columns are ignored; an empty table gives an empty table.
The vocabulary file is a parameter and is read where the driver runs; workers get its merges by broadcast (its size is fixed: 50,000 merges).
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"
KNOWN_WORDS = 250_000  # words a worker remembers before it starts anew
BLOCK_CHARS = 1_500_000


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern[str]:
    """The words of byte-level BPE. Classes are written out, as re has no properties and its white space differs."""

    def ranges(test) -> str:
        out, start = [], None
        for c in range(sys.maxunicode + 2):
            inside = c <= sys.maxunicode and test(chr(c))
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    letter, number = ranges(lambda c: unicodedata.category(c)[0] == "L"), ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = r"\t-\r\x20\x85\xa0  -     　"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_signs() -> dict[str, int]:
    """The sign by which the vocabulary files write each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


#: The same words where no character is a number but not a decimal digit, or a separator that only re calls white space; three times as fast.
PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def _unusual() -> np.ndarray:
    """By code point: may PLAIN cut wrongly here?"""
    odd = np.zeros(sys.maxunicode + 1, bool)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        kind = unicodedata.category(c)
        odd[k] = kind in ("Nl", "No") or (c.isalnum() and kind[0] not in "LN") or 0x1C <= k <= 0x1F
    return odd


def words_of(texts: list[str], unusual: np.ndarray) -> Iterator[list[str]]:
    """The words of each text; joined they are the text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    hits = np.flatnonzero(unusual[codes])
    ends = np.cumsum([len(t) for t in texts])
    exact = set(np.searchsorted(ends, hits, "right").tolist())
    for i, t in enumerate(texts):
        yield (_pattern() if i in exact else PLAIN).findall(t)


class Merges:
    """The merges of a vocabulary: (left id, right id) to rank and new id; and the id of each byte."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, signs = model["vocab"], byte_signs()
        self.unusual = _unusual()
        self.byte_ids = [0] * 256
        for sign, b in signs.items():
            self.byte_ids[b] = vocab[sign]
        self.table: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.table.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])


def encode_words(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each word, by one pair occurrence index over all of them."""
    ids = merges.byte_ids
    symbol: list[int] = []
    ends: list[int] = []
    for w in words:
        symbol += [ids[b] for b in w]
        symbol.append(-1)  # no pair goes over it
        ends.append(len(symbol) - 1)
    n = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    table = merges.table
    index: dict[int, list[int]] = {}
    for i in range(n - 1):
        a, b = symbol[i], symbol[i + 1]
        if a >= 0 and b >= 0 and (m := table.get(a << 20 | b)) is not None:
            if m in index:
                index[m].append(i)
            else:
                index[m] = [i]
    active = list(index)
    heapq.heapify(active)  # by rank, as it is the high part
    while active:
        m = heapq.heappop(active)
        places = index.pop(m, None)
        if places is None:
            continue
        if len(places) > 1:
            places.sort()
        new = m & 0xFFFFF
        for i in places:
            j = after[i]
            a = symbol[i]
            if a < 0 or j >= n or (b := symbol[j]) < 0 or table.get(a << 20 | b) != m:
                continue  # an earlier merge took one of the two
            symbol[i] = new
            symbol[j] = -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (c := symbol[k]) >= 0 and (x := table.get(new << 20 | c)) is not None:
                    if x in index:
                        index[x].append(i)
                    else:
                        index[x] = [i]
                        heapq.heappush(active, x)
            h = before[i]
            if h >= 0 and (c := symbol[h]) >= 0 and (x := table.get(c << 20 | new)) is not None:
                if x in index:
                    index[x].append(h)
                else:
                    index[x] = [h]
                    heapq.heappush(active, x)
    out, start = [], 0
    for end in ends:
        out.append([s for s in symbol[start:end] if s >= 0])
        start = end + 1
    return out


class Encoder:
    """Texts to ids, remembering words."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.count = np.empty(1 << 16, np.int32), np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        ids = encode_words([w.encode("utf-8", "replace") for w in words], self.merges)
        first = len(self.known)
        sizes = np.array([len(x) for x in ids], np.int64)
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(words) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        self.start[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.count[first : first + len(words)] = sizes
        self.used += total
        self.known.update(zip(words, range(first, first + len(words))))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of all texts in turn, and how many words each text has."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        words: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, found in enumerate(words_of([t or "" for t in texts], self.merges.unusual)):
            per_text[i] = len(found)
            words += found
        if new := list(set(words).difference(self.known)):
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), per_text

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        numbers, per_text = self.numbers(texts)
        total = np.concatenate(([0], np.cumsum(self.count[numbers])))
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and how many each text has."""
        numbers, per_text = self.numbers(texts)
        count = self.count[numbers]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[numbers] - (ends - count), count)
        sums = np.concatenate(([0], ends))
        stops = np.cumsum(per_text)
        return self.flat[at], sums[stops] - sums[stops - per_text]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS together, so that a batch's words needn't be held at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shared_merges(spark: SparkSession, path: str = VOCABULARY) -> Broadcast[Merges]:
    return spark.sparkContext.broadcast(Merges(path))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each row."""
    merges = shared_merges(df.sparkSession, path)
    source = spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in blocks(texts):
                ids, sizes = encoder.encode(texts[lo:hi])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "ids"])

    return source.mapInArrow(scan, "doc_id bigint, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    merges = shared_merges(df.sparkSession, path)
    source = spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = [encoder.lengths(texts[lo:hi]) for lo, hi in blocks(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(sizes) if sizes else np.empty(0, np.int64))], names=["doc_id", "n_tokens"])

    return source.mapInArrow(scan, "doc_id bigint, n_tokens bigint")
