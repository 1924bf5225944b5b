"""Exact top-k search by integer inner product over a bit-sliced index.

Each block of rows is stored as bitmaps, one per attribute and bit. A query adds the slices that its
own bits select with carry-save adders, which yields the score of every row of the block as slices.
Top rows are then taken from the most significant slice downward; rows tied at the boundary are
resolved by id.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm import shared

#: Rows and queries with quantised components from this magnitude on are multiplied out instead of sliced.
LIMIT = 2**24
_SCHEMA = "query_mark long, query_id long, vec_id long, score long"


def quantise(matrix: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * matrix).astype(np.int64)


class BitSlicedIndex:
    """Bitmaps of a block of integer rows; bit r of a bitmap belongs to row r."""

    def __init__(self, values: np.ndarray):
        self.rows, self.dims = values.shape
        self.values = values
        self.low = values.min(axis=0)
        raised = values - self.low
        self.bits = max(1, int(raised.max()).bit_length())
        words = -(-self.rows // 64)
        planes = np.zeros((self.bits, self.dims, words * 8), np.uint8)
        for b in range(self.bits):
            packed = np.packbits((raised >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
            planes[b, :, : packed.shape[1]] = packed
        self.slices = planes.view(np.uint64)
        inside = np.zeros(words * 8, np.uint8)
        full = np.packbits(np.ones(self.rows, np.uint8), bitorder="little")
        inside[: len(full)] = full
        self.inside = inside.view(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the inner product plus a constant of the query.

        A negative factor takes the complement of its attribute, so that only sums remain.
        """
        size = np.abs(query)
        # One row of bitmaps per attribute and bit, complemented where the factor is negative.
        flip = np.where(query < 0, ~np.uint64(0), np.uint64(0))[:, None]
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            chosen = np.flatnonzero(size >> j & 1)
            if len(chosen):
                for b in range(self.bits):
                    columns.setdefault(b + j, []).append(self.slices[b, chosen] ^ flip[chosen])
        result, weight = [], 0
        while weight <= max(columns, default=-1):
            result.append(self._add(columns, weight))
            weight += 1
        return result

    def _add(self, columns: dict[int, list[np.ndarray]], weight: int) -> np.ndarray:
        """Sum the bitmaps of one weight to a single one; carries join the next weight."""
        stack = np.concatenate(columns.get(weight) or [np.zeros((1, len(self.inside)), np.uint64)])
        carries = columns.setdefault(weight + 1, []) if len(stack) > 1 else []
        while len(stack) > 2:
            t = len(stack) // 3
            a, b, c, rest = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t], stack[3 * t :]
            either = a ^ b
            carries.append((a & b) | (either & c))
            total = either ^ c
            stack = np.concatenate([total, rest]) if len(rest) else total
        if len(stack) == 2:
            carries.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        return stack[0]

    def top(self, query: np.ndarray, k: int, skip: int | None = None) -> np.ndarray:
        """Row numbers of the k best rows, earlier rows first among equal scores at the boundary."""
        sure, tied = np.zeros_like(self.inside), self.inside.copy()
        if skip is not None:
            tied[skip >> 6] &= ~(np.uint64(1) << np.uint64(skip & 63))
        for plane in reversed(self.scores(query)):
            upper = tied & plane
            with_upper = sure | upper
            n = int(np.bitwise_count(with_upper).sum())
            if n >= k:
                tied = upper
            else:
                sure, tied = with_upper, tied & ~plane
            if n == k:
                sure, tied = with_upper, np.zeros_like(tied)
                break
        rows = _rows(sure)
        return np.concatenate([rows, _rows(tied)[: max(0, k - len(rows))]])


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _sliced(values: np.ndarray) -> np.ndarray:
    """Whether each row is one for the index, where no score of two such rows leaves a long."""
    limit = min(LIMIT, int((2**62 // values.shape[1]) ** 0.5))
    return (values.max(axis=1) < limit) & (values.min(axis=1) > -limit)


def multiplied(values: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose inner product with the query fits in a long, and the products."""
    fits, size, factors = np.ones(len(values), bool), np.abs(query.astype(np.float64)), query.tolist()
    for at in range(0, len(values), 1024):
        unsure = np.flatnonzero(np.abs(values[at : at + 1024].astype(np.float64)) @ size > 2.0**62) + at
        for row in unsure:
            fits[row] = -(2**63) <= sum(map(operator.mul, values[row].tolist(), factors)) < 2**63
    rows = np.flatnonzero(fits)
    # Products and sums are taken modulo 2**64, so a result that fits is exact.
    return rows, (values @ query)[rows]


def search(
    df: DataFrame,
    is_query: str,
    k: int = 20,
    scale: int = 64,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    rows_per_block: int = 32768,
    queries_per_block: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of ``floor(scale * x)`` per query.

    ``is_query`` is a condition on ``id``. Candidates of a query are all rows but its own; ties go to the smaller id. Rows with a null id, a null or empty vector, or a null, non-finite
    or unrepresentable component (from 2**63 on after scaling) take no part, and pairs whose score does not fit in a long are left out. Vectors of different
    lengths are not compared. Rows that share an id are candidates each, of each other too, and queries each. Further columns are ignored.
    Fewer than k candidates are all returned; without queries the result is empty.
    """
    vectors = shared.usable_vectors(df, vec_id, vector).filter(F.expr(f"forall(vec, x -> abs(x) < {2**63}D / {scale})"))
    grid = shared.tiles(vectors, is_query, rows_per_block, queries_per_block)
    if grid is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def tile(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        asked, out = shared.by_dimension(queries, "query_id", "query", "query_mark"), []
        for n, (ids, matrix, marks) in shared.by_dimension(candidates, "id", "vec", "mark").items():
            if n not in asked:
                continue
            values, wanted = quantise(matrix, scale), quantise(asked[n][1], scale)
            small = _sliced(values)
            groups = [(ids, marks, values, True)] if small.all() else [(ids[g], marks[g], values[g], g is small) for g in (small, ~small)]
            query_ids, _, query_marks = asked[n]
            for own_ids, own_marks, rows_of, sliced in groups:
                index = BitSlicedIndex(rows_of) if sliced and len(own_ids) else None
                places = shared.places(own_marks, query_marks).tolist()
                for query_id, mark, place, factors, fine in zip(query_ids, query_marks, places, wanted, _sliced(wanted)):
                    own = place if place >= 0 else None
                    if index and fine:
                        rows = index.top(factors, k, own)
                        scores = rows_of[rows] @ factors
                    else:
                        rows, scores = multiplied(rows_of, factors)
                        rows, scores = (x[rows != own] for x in (rows, scores)) if own is not None else (rows, scores)
                        best = np.lexsort((rows, ~scores))[:k]
                        rows, scores = rows[best], scores[best]
                    out.append((np.full(len(rows), mark), np.full(len(rows), query_id), own_ids[rows], scores))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("query_mark", "query_id", "vec_id", "score"), parts)))

    best = Window.partitionBy("query_mark").orderBy(F.desc("score"), "vec_id")
    ranked = grid.applyInArrow(tile, _SCHEMA).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
