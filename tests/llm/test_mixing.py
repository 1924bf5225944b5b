"""Targets and dependent rounding."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string"
WEIGHTS = [5, 2, 1]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, "x") for i, t, s in rows], SCHEMA).repartition(3)


def plain_targets(sizes):
    """Shares by weight; what goes beyond twice a source's size is shared again, until none does."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(rest.values()) if rest else 0
        over = [s for s, w in rest.items() if level * w > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * w for s, w in rest.items()}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def corpus(seed, n=900):
    rng = random.Random(seed)
    names = [None, "b", "B", "é", "src1", "src10", "src2", ""]
    return [(i, " ".join(["w"] * min(3000, int(rng.paretovariate(1) * 3))), rng.choice(names[: 8 - i % 4])) for i in range(n)]


@pytest.mark.parametrize("block_rows", [20_000, 10])
def test_sources_come_near_their_targets(spark, block_rows):
    rows = corpus(1)
    got = mixing.mix(documents(spark, rows), WEIGHTS, 1.5, 2, block_rows=block_rows).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, *_ in rows]
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
        largest[s] = max(largest[s], len(t.split()))
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        assert r["size"] == len(rows[r["doc_id"]][1].split())
        taken[r["source"]] += r["taken"]
    for s in sizes:
        # What a block leaves over is small only if the block is large.
        most = 0.02 * want[s] + 5 if block_rows > len(rows) else largest[s]
        assert abs(taken[s] - want[s]) <= most, s


def test_reruns_agree_however_rows_are_partitioned(spark):
    rows = corpus(2, 300)
    key = lambda df: sorted((r["doc_id"], r["copies"]) for r in df.collect())
    first = key(mixing.mix(documents(spark, rows), WEIGHTS, 1.5, 2, block_rows=20))
    assert first == key(mixing.mix(documents(spark, rows[::-1]).repartition(7), WEIGHTS, 1.5, 2, block_rows=20))
    assert first != key(mixing.mix(documents(spark, rows), WEIGHTS, 1.5, 2, seed=18, block_rows=20))


@pytest.mark.parametrize("pivot", ["pool", "pairs"])
def test_rounding_keeps_expectations_and_sums(pivot):
    sizes = np.array([50, 20, 10, 5, 5, 3, 2, 1, 1], np.int64)
    total, runs = np.zeros(len(sizes)), 4000
    for seed in range(runs):
        rng = np.random.default_rng(seed)
        p = np.full(len(sizes), 0.3)
        got, held = mixing.pivot_pool(sizes, 0.3, rng) if pivot == "pool" else mixing.pivot_pairs(sizes, p, rng)
        assert ((got == 0) | (got == 1) | (np.arange(len(got)) == held)).all()
        assert got @ sizes == pytest.approx(0.3 * sizes.sum())
        total += got
    assert np.abs(total / runs - 0.3).max() < 0.04


def test_whole_and_empty_probabilities():
    rng = np.random.default_rng(1)
    for p in (0.0, 1.0):
        got, held = mixing.pivot_pool(np.array([5, 0, 2]), p, rng)
        assert held == -1 and (got == p).all()
    got, held = mixing.pivot_pool(np.array([0, 0]), 0.5, rng)
    assert held == -1 and set(got) <= {0.0, 1.0}


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 50)
    rows = [(None, None, None)] * 400 + [(9999, "x y z", "a")] * 400 + [(i, "x " * (i % 9), "a") for i in range(200)]
    docs = documents(spark, rows)
    sized = docs.select(F.monotonically_increasing_id().alias("mark"), "doc_id", "source", mixing.words(F.col("text")).alias("size"))
    pieces = mixing._dealt(mixing.shared.stored(sized, "sizes")).groupBy("source", "doc_id", "piece").count().collect()
    crowded = [r["count"] for r in pieces if r["doc_id"] in (None, 9999) and r["source"] != "b"]
    assert sorted(c for c in crowded if c > 1) == [50] * 16
    got = mixing.mix(docs, WEIGHTS, 1.5, 2, block_rows=60).collect()
    assert len(got) == 1000
    again = mixing.mix(documents(spark, rows).repartition(5), WEIGHTS, 1.5, 2, block_rows=60).collect()
    key = lambda found: sorted((r["doc_id"] or -1, r["source"] or "", r["size"], r["copies"]) for r in found)
    assert key(got) == key(again)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "b"), (3, "x y", None), (3, "x y", None), (4, "\u00a0 \x1c", "c")]
    got = mixing.mix(documents(spark, rows), WEIGHTS, 1.5, 2).collect()
    assert len(got) == 6
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2, 2]
    assert all(r["target"] == 0 and r["taken"] == 0 for r in got if r["source"] == "a")
    assert mixing.mix(documents(spark, []), WEIGHTS, 1.5, 2).count() == 0


def test_rows_are_repeated_as_often_as_taken(spark):
    rows = corpus(3, 200) + [(3, "same id", "b"), (3, "same id", "b"), (None, "none", None)]
    docs = documents(spark, rows)
    out = mixing.mixed_rows(docs, WEIGHTS, 1.5, 2)
    assert out.columns == docs.columns
    mixed = mixing.mix(docs, WEIGHTS, 1.5, 2)
    count = lambda df, n: {(r["doc_id"], r["source"], r["w"]): r["n"] for r in df.groupBy("doc_id", "source", "w").agg(n.alias("n")).collect() if r["n"]}
    ours = count(out.withColumn("w", mixing.words(F.col("text"))), F.count("*"))
    assert ours == count(mixed.withColumn("w", F.col("size")), F.sum("copies"))
