"""Packing pieces of documents into sequences of a fixed length.

Documents become token ids and are cut where they are longer than a sequence. What to put together
is decided on the number of pieces of each length, a table no longer than a sequence, by
exact-complement hashing: sums of one, two and three available lengths are indexed, and the gap that the largest
remaining length leaves is filled by a combination that closes it exactly, for as many sequences as
all its lengths are available. Gaps that no combination closes take the longest length that fits. Pieces
are then numbered within their length and find their sequence from that number.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm import shared, token_ids

_PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Pieces of one length that are numbered together, and groups of a length at most.
GROUP, MOST_GROUPS = 1_000, 100_000


def cut(
    docs: DataFrame, tokenizer: str, capacity: int, doc_id: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids with ``end_id`` behind them, in pieces of
    ``capacity`` where there are more; ``ids`` are little-endian unsigned 32-bit numbers.

    A null text is empty and gives a piece of ``end_id`` alone. A null id stays null. Repeated rows are pieces of
    their own. Further columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = token_ids.encoder(tokenizer), struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            held, size = [], 0
            texts = (cell.as_py() for cell in batch["text"])
            for one, found in zip(batch["doc_id"].to_pylist(), encode.batch(texts)):
                ids = found.tobytes() + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    held.append((one, at // step, at // 4, len(part) // 4, part))
                size += len(ids)
                if size > 8_000_000:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return rows.mapInArrow(pieces, _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class Complements:
    """Index of the sums of one, two and three available lengths.

    Availability only falls, so a pair that has run out is skipped for good.
    """

    def __init__(self, available: dict[int, int], capacity: int):
        self.left = available
        lengths = np.array(sorted(available, reverse=True), np.int64)
        a, b = np.triu_indices(len(lengths))
        total = lengths[a] + lengths[b]
        fit = total <= capacity
        a, b, total = lengths[a[fit]], lengths[b[fit]], total[fit]
        order = np.argsort(total, kind="stable")
        self._larger, self._smaller = a[order], b[order]
        self._next = np.searchsorted(total[order], np.arange(capacity + 2))
        self._end = self._next[1:].copy()

    def _has(self, *lengths: int) -> bool:
        return all(self.left.get(x, 0) >= lengths.count(x) for x in lengths)

    def pair(self, gap: int) -> tuple[int, int] | None:
        at, end = int(self._next[gap]), int(self._end[gap])
        while at < end:
            found = int(self._larger[at]), int(self._smaller[at])
            if self._has(*found):
                break
            at += 1
        self._next[gap] = at
        return found if at < end else None

    def triple(self, gap: int, descending: list[int]) -> tuple[int, int, int] | None:
        for first in descending:
            if first <= gap - 2 and self._next[gap - first] < self._end[gap - first]:
                rest = self.pair(gap - first)
                if rest and self._has(first, *rest):
                    return (first, *rest)
        return None

    def fill(self, gap: int, descending: list[int]) -> tuple[int, ...] | None:
        """Lengths that close the gap exactly: one, else two, else three."""
        if self._has(gap):
            return (gap,)
        return self.pair(gap) or self.triple(gap, descending)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, number of such sequences), all pieces of ``counts`` placed."""
    left = {n: c for n, c in counts.items() if c > 0}
    index, result = Complements(left, capacity), []
    while left:
        descending = sorted(left, reverse=True)
        took = Counter([descending[0]])
        _take(left, descending[0], 1)
        gap = capacity - descending[0]
        while gap and left:
            best = index.fill(gap, [n for n in descending if n in left])
            if best is None:
                fitting = next((n for n in descending if n <= gap and n in left), None)
                if fitting is None:
                    break
                best = (fitting,)
            for n in best:
                _take(left, n, 1)
                took[n] += 1
                gap -= n
        times = min((left.get(n, 0) // m for n, m in took.items()), default=0)
        for n, m in took.items():
            _take(left, n, m * times)
        result.append((sorted(took.elements(), reverse=True), times + 1))
    return result


def _take(left: dict[int, int], length: int, n: int) -> None:
    if n:
        left[length] -= n
        if not left[length]:
            del left[length]


def intervals(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, last number, pieces per sequence, first sequence, offset of the first piece)."""
    used: Counter[int] = Counter()
    sequence, rows = 0, []
    for lengths, times in patterns:
        offset = 0
        for n, m in Counter(lengths).items():
            rows.append((n, used[n], used[n] + m * times - 1, m, sequence, offset))
            used[n] += m * times
            offset += n * m
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``; sequences are filled without gaps from 0.

    Columns already named like the two new ones are replaced; all others stay. Lengths are whole numbers from 1 to
    ``capacity``; others, and null, are an error. Rows that are equal in all columns are pieces of their own, told
    apart by a mark, so that equal rows spread like others. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    marked = pieces.select(
        F.struct(*own).alias("row"), F.col(length).cast("int").alias("size"), F.monotonically_increasing_id().alias("mark")
    )
    marked = shared.stored(marked, "pieces")
    counts = {r["size"]: r["count"] for r in marked.groupBy("size").count().limit(capacity + 2).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    # One row per length and group of pieces: their numbers begin where those of the groups before end.
    groups = F.least(F.lit(MOST_GROUPS), F.ceil(F.col("total") / GROUP)).cast("int")
    totals = spark.createDataFrame(list(counts.items()), "size int, total long")
    dealt = marked.join(F.broadcast(totals), "size").withColumn("shard", F.pmod(F.xxhash64("mark"), groups)).drop("total")
    sizes = dealt.groupBy("size", "shard").agg(F.count("*").alias("pieces"))
    before = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("size", "shard", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("size", "shard").orderBy("mark")
    numbered = dealt.withColumn("turn", F.row_number().over(inside) - 1).join(first, ["size", "shard"])
    numbered = numbered.withColumn("turn", F.col("turn") + F.col("first"))
    # At most a few rows per length, whatever the number of pieces.
    listed = spark.createDataFrame(
        intervals(plan(counts, capacity)), "of int, from_turn long, to_turn long, per long, sequence long, place long"
    )
    placed = numbered.join(F.broadcast(listed), F.expr("size = of AND turn BETWEEN from_turn AND to_turn"))
    return placed.select(
        "row.*",
        F.expr("sequence + (turn - from_turn) div per").alias("sequence_id"),
        F.expr("place + (turn - from_turn) % per * size").alias("offset"),
    )
