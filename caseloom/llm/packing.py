"""Problem 9: documents put into containers of a fixed capacity, by sum-of-squares packing.

Each document goes where the sum, over all gaps, of the squared number of open containers with that gap becomes smallest: into an open
container or a new one. Documents above the capacity are divided into full containers and a rest, which is placed like a document;
no other document is divided. Partitions pack on their own; of each, the containers that aren't well filled are opened again and
their documents are packed once more with those of many other partitions, so what a partition can't fill isn't lost.

Defined results: documents of no tokens (null and empty texts) take no space and get a container of their partition; every row gets its
pieces, repeated ids too; a capacity under 1 is a ValueError; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

WELL_FILLED = 0.995
ROWS_PER_PACK = 50_000  # documents of one packing; the table's partitions are joined or split to about this
SCHEMA = "doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint, fill bigint"


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each size (1 to capacity), largest sizes first, and the fill of each container."""
    gaps = np.zeros(capacity + 1, np.int64)  # open containers per gap
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        # opening one adds 2 N[C - s] + 1, moving one from gap g to g - s adds 2 (N[g - s] - N[g] + 1), one less 2 N[g] - 1 if it gets full
        best, choice = (2 * int(gaps[capacity - s]) + 1 if s < capacity else 0), -1
        old = gaps[s:]
        if len(old):
            cost = 2 * (gaps[: len(old)] - old + 1)
            cost[0] = 1 - 2 * old[0]
            cost[old == 0] = np.iinfo(np.int64).max
            k = int(cost.argmin())
            if cost[k] <= best:
                choice = s + k
        if choice < 0:
            where[i] = len(fill)
            fill.append(s)
            rest = capacity - s
        else:
            c = members[choice].pop()
            gaps[choice] -= 1
            where[i] = c
            fill[c] += s
            rest = choice - s
        if rest:
            gaps[rest] += 1
            members[rest].append(int(where[i]))
    return where, np.array(fill, np.int64)


def _packed(b: pa.Table, capacity: int, base: int) -> pa.RecordBatch:
    sizes = b.column("n_tokens").to_numpy()
    where, fill = np.zeros(len(sizes), np.int64), np.zeros(1, np.int64)
    some = sizes > 0
    if some.any():
        where[some], fill = pack(sizes[some], capacity)
    cols = [b.column(c).combine_chunks() for c in ("doc_id", "piece_no", "start_token", "n_tokens")]
    return pa.RecordBatch.from_arrays([*cols, pa.array(base + where), pa.array(fill[where])], names=["doc_id", "piece_no", "start_token", "n_tokens", "container_id", "fill"])


def containers(sized: DataFrame, capacity: int, rows_per_pack: int = ROWS_PER_PACK) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id) of sized (doc_id, n_tokens)."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    table = cut(sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size")), "packing-sizes")
    starts = F.when(F.col("size") <= capacity, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(capacity).cast("long")))
    pieces = table.select("doc_id", "size", F.posexplode(starts).alias("piece_no", "start_token")).select(
        "doc_id", F.col("piece_no").cast("long").alias("piece_no"), "start_token", F.least(F.col("size") - F.col("start_token"), F.lit(capacity)).cast("long").alias("n_tokens")
    )

    def packs(turn: int):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = (turn << 60) + ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36)
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size >= rows_per_pack:
                    yield _packed(pa.Table.from_batches(held), capacity, base)
                    base, held, size = base + size, [], 0
            if size:
                yield _packed(pa.Table.from_batches(held), capacity, base)

        return scan

    first = cut(pieces.mapInArrow(packs(0), SCHEMA), "packing-first")
    well = F.col("fill") >= WELL_FILLED * capacity
    # what is opened again is a small part; the order makes a repeated task pack alike
    again = first.filter(~well).drop("container_id", "fill")
    n = again.count()
    again = again.repartition(max(1, -(-n // rows_per_pack)), "doc_id").sortWithinPartitions("doc_id", "piece_no", "n_tokens")
    second = again.mapInArrow(packs(1), SCHEMA)
    return first.filter(well).unionByName(second).drop("fill")
