"""Top-k and nearest neighbours against brute force, with the edge cases of their docstrings."""

import math

import numpy as np
import pytest

from riffle.llm import neighbours, topk

SCHEMA = "vec_id long, embedding array<float>, score string, id int"
EDGES = [
    (None, [1.0, 2.0, 3.0], "x", 1),
    (1000, None, "x", 1),
    (1001, [], "x", 1),
    (1002, [1.0, None, 2.0], "x", 1),
    (1003, [float("nan"), 0.0, 0.0], "x", None),
    (1004, [float("inf"), 0.0, 0.0], "x", 1),
    (1010, [1.0, 2.0], "x", 1),
]


def usable(rows):
    return [
        (i, v)
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]


def vectors(n, dims=3, seed=1, step=0.25):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(rng.normal(0, 0.5, dims) / step) * step], "s", 1) for i in range(n)]


def brute(rows, is_query, k, score, alike=lambda a, b: len(a) == len(b)):
    found = []
    known = usable(rows)
    for own, (q, a) in enumerate(known):
        if is_query(q):
            best = sorted((-score(a, b), i) for row, (i, b) in enumerate(known) if row != own and alike(a, b))[:k]
            found += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(found)


def inner(a, b):
    return sum(math.floor(64 * float(np.float32(x))) * math.floor(64 * float(np.float32(y))) for x, y in zip(a, b))


def cosine(a, b):
    a, b = ([float(np.float32(x)) for x in v] for v in (a, b))
    return neighbours.dot(np.array([a]), np.array([b]))[0] / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


@pytest.mark.parametrize("blocks", [(32768, 1024), (40, 5)])
def test_topk_matches_brute_force_with_many_ties(spark, blocks):
    rows = vectors(300) + EDGES
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.search(df, "id % 20 = 0", k=7, rows_per_block=blocks[0], queries_per_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 20 == 0, 7, inner)


@pytest.mark.parametrize("blocks", [(32768, 1024), (20, 2)])
def test_topk_keeps_large_components(spark, blocks):
    large = [(100, [262144.0, 0.5, -1.0]), (110, [-3e5, 3e5, 7.0]), (120, [1e8, -1e8, 1e8]), (121, [2.0**40, 1.0, -(2.0**40)]), (140, [-(2.0**56), 2.0**50, 1.0])]
    rows = vectors(60) + [(i, v, "s", 1) for i, v in large] + EDGES
    got = topk.search(spark.createDataFrame(rows, SCHEMA), "id % 20 = 0", k=9, rows_per_block=blocks[0], queries_per_block=blocks[1])
    fits = lambda a, b: len(a) == len(b) and -(2**63) <= inner(a, b) < 2**63
    want = brute(rows, lambda i: i % 20 == 0, 9, inner, fits)
    assert sorted(map(tuple, got.collect())) == want and {100, 110, 120, 121, 140} <= {r[2] for r in want}


def test_topk_returns_all_of_few_candidates(spark):
    rows = vectors(4)
    got = topk.search(spark.createDataFrame(rows, SCHEMA), "id = 2", k=20).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i == 2, 20, inner)


@pytest.mark.parametrize("blocks", [(32768, 1024), (25, 4)])
def test_rows_that_share_an_id_are_candidates_and_queries_each(spark, blocks):
    rows = vectors(40) + vectors(40)[::2] + [(20, v, *x) for _, v, *x in vectors(30, seed=8)]
    df, size = spark.createDataFrame(rows, SCHEMA).repartition(3), {"rows_per_block": blocks[0], "queries_per_block": blocks[1]}
    got = topk.search(df, "id % 10 = 0", k=5, **size).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 10 == 0, 5, inner)
    rows = vectors(40, dims=6, step=1e-4) + [(20, v, *x) for _, v, *x in vectors(30, dims=6, seed=8, step=1e-4)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3), "id % 10 = 0", k=5, **size).collect()
    want = brute(rows, lambda i: i % 10 == 0, 5, cosine)
    assert [g[:3] for g in sorted(map(tuple, got))] == [w[:3] for w in want]


@pytest.mark.parametrize("search", [topk.search, neighbours.search])
def test_no_queries_and_empty_tables(spark, search):
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty, "id % 20 = 0").columns == ["query_id", "rank", "vec_id", "score"]
    assert search(empty, "id % 20 = 0").count() == 0
    assert search(spark.createDataFrame(vectors(5), SCHEMA), "id = 99").count() == 0


def test_index_adds_slices_exactly():
    rng = np.random.default_rng(2)
    values = rng.integers(-40, 40, (130, 9))
    index = topk.BitSlicedIndex(values)
    for query in rng.integers(-40, 40, (20, 9)):
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) for s in index.scores(query)]
        total = sum(b << i for i, b in enumerate(bits))
        exact = values @ query
        assert (total - total[0] == exact - exact[0]).all()
        assert set(index.top(query, 10)) == set(sorted(range(130), key=lambda r: (-exact[r], r))[:10])


@pytest.mark.parametrize("blocks", [(32768, 512), (50, 7)])
def test_neighbours_match_brute_force(spark, blocks):
    rows = vectors(300, dims=8, step=1e-3) + [(2000, [0.0] * 8, "zero", 1), (2001, [1e-3] * 8, "s", 1), (2002, [1e-3] * 8, "s", 1), *EDGES]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.search(df, "id % 50 = 0", k=5, rows_per_block=blocks[0], queries_per_block=blocks[1])
    got = sorted(map(tuple, got.collect()))
    want = brute([r for r in rows if not r[1] or any(r[1])], lambda i: i % 50 == 0, 5, cosine)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-14)


def test_neighbours_of_equal_vectors_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0], "s", 1) for i in (0, 9, 3, 7, 5)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), "id = 0", k=3).collect()
    assert [r.vec_id for r in got] == [3, 5, 7]


def test_recall_is_complete(spark):
    rows = vectors(2000, dims=16, seed=4, step=1e-6)
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), "id % 50 = 0", k=5, rows_per_block=300)
    want = {(q, i) for q, _, i, _ in brute(rows, lambda i: i % 50 == 0, 5, cosine)}
    assert {(r.query_id, r.vec_id) for r in got.collect()} == want
