"""Nearest neighbours by cosine through a blocked matrix product of int8 tiles.

Unit vectors are rounded to int8. A tile's product gives every cosine within a bound that follows
from the two rounding errors; only pairs whose upper bound reaches the k-th largest lower bound are
computed again from the original vectors in double precision, and heaps merge them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm import shared

#: Covers the rounding of the float32 arithmetic on tiles and of the double-precision measure.
SLACK = 1e-5
_SCHEMA = "query_mark long, query_id long, vec_id long, score double"


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Int8Block:
    """Unit vectors as int8 with a scale per row and the length of the rounding error."""

    def __init__(self, matrix: np.ndarray, lengths: np.ndarray):
        unit = matrix / lengths[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / scale[:, None]).astype(np.int8)
        rounded = self.codes * scale[:, None]
        self.scale = scale.astype(np.float32)
        self.error = np.linalg.norm(unit - rounded, axis=1)
        self.length = np.linalg.norm(rounded, axis=1)

    def product(self, other: Int8Block) -> np.ndarray:
        """Integer products of the codes; float32 holds them exactly for up to 1,000 components, and
        longer vectors are added up in pieces of that length in double precision."""
        step, total = 1000, None
        for d in range(0, self.codes.shape[1], step):
            part = self.codes[:, d : d + step].astype(np.float32) @ other.codes[:, d : d + step].astype(np.float32).T
            total = part if total is None else total.astype(np.float64) + part
        return total


def _survivors(queries: Int8Block, rows: Int8Block, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the k nearest of this tile."""
    near = queries.product(rows) * queries.scale[:, None] * rows.scale[None, :]
    bound = (queries.error[:, None] + queries.length[:, None] * rows.error[None, :] + SLACK).astype(np.float32)
    at = np.flatnonzero(own >= 0)
    near[at, own[at]] = -np.inf
    low = near - bound
    if low.shape[1] > k:
        least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        least = np.full(len(low), -np.inf, np.float32)
    q, r = np.nonzero(near + bound >= least[:, None])
    keep = own[q] != r
    return q[keep], r[keep]


def _measurable(matrix: np.ndarray) -> np.ndarray:
    """Squared lengths; zero or infinite where a cosine can't be measured."""
    with np.errstate(over="ignore", under="ignore"):
        return dot(matrix, matrix)


def search(
    df: DataFrame,
    is_query: str,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    rows_per_block: int = 32768,
    queries_per_block: int = 512,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest cosine per query, nearest first.

    ``is_query`` is a condition on ``id``. Candidates of a query are all rows but its own; ties go to the smaller id. The result is exact. Rows with a null id, a null, empty or zero
    vector, a null or non-finite component, or a squared length outside the range of doubles take
    no part. Vectors of different lengths are not compared. Rows that share an id are candidates each, of each
    other too, and queries each. Further columns are ignored. Fewer than k candidates are all
    returned; without queries the result is empty.
    """
    vectors = shared.usable_vectors(df, vec_id, vector)
    grid = shared.tiles(vectors, is_query, rows_per_block, queries_per_block)
    if grid is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def tile(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        asked, out = shared.by_dimension(queries, "query_id", "query", "query_mark"), []
        for n, (ids, matrix, marks) in shared.by_dimension(candidates, "id", "vec", "mark").items():
            if n not in asked:
                continue
            query_ids, wanted, query_marks = asked[n]
            square, query_square = _measurable(matrix), _measurable(wanted)
            fit, query_fit = (np.isfinite(s) & (s > 0) for s in (square, query_square))
            ids, matrix, length, marks = ids[fit], matrix[fit], np.sqrt(square[fit]), marks[fit]
            query_ids, wanted, query_marks = query_ids[query_fit], wanted[query_fit], query_marks[query_fit]
            query_length = np.sqrt(query_square[query_fit])
            if not len(ids) or not len(query_ids):
                continue
            own = shared.places(marks, query_marks)
            rows = Int8Block(matrix, length)
            for start in range(0, len(query_ids), 128):
                part = slice(start, start + 128)
                q, r = _survivors(Int8Block(wanted[part], query_length[part]), rows, k, own[part])
                q += start
                score = dot(wanted[q], matrix[r]) / (query_length[q] * length[r])
                first = np.searchsorted(q, np.arange(start, min(start + 128, len(query_ids)) + 1))
                for i, (a, b) in enumerate(zip(first, first[1:])):
                    best = heapq.nsmallest(k, zip(-score[a:b], ids[r[a:b]]))
                    out += [(query_marks[start + i], query_ids[start + i], vec, -lower) for lower, vec in best]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = zip(*out) if out else [()] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, types)], ["query_mark", "query_id", "vec_id", "score"])

    def merge(part: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip(-part["score"].to_numpy(), part["vec_id"].to_numpy()))
        return pa.table(
            {
                "query_id": pa.array([part["query_id"][0].as_py()] * len(best), pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([int(v) for _, v in best], pa.int64()),
                "score": pa.array([-float(s) for s, _ in best], pa.float64()),
            }
        )

    merged = grid.applyInArrow(tile, _SCHEMA).groupBy("query_mark")
    return merged.applyInArrow(merge, "query_id long, rank int, vec_id long, score double").select(
        "query_id", F.col("rank"), "vec_id", "score"
    )
