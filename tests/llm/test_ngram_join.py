"""The similarity join against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from riffle.llm import ngram_join

SCHEMA = "doc_id long, text string, key string, n int"


def ngrams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(i, ngrams(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, a in sets:
        for y, b in sets:
            if x < y and a and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(x), find(y)))
                parent[high] = low
    return sorted((i, len(s), find(i)) for i, s in sets)


def joined(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(4)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect())


def corpus(seed, n=160):
    """Copies, near copies around the limit, common passages, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, bases = [], [[rng.choice(words) for _ in range(rng.randint(3, 80))] for _ in range(25)]
    for i in range(n):
        own = list(rng.choice(bases))
        kind = rng.random()
        if kind < 0.5:
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
        elif kind < 0.7:
            own = passage + own[: rng.randint(0, 12)]
        elif kind < 0.8:
            own = own[rng.randint(0, 4) :]
        rows.append((i * 2 + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 700)
    monkeypatch.setattr(ngram_join, "RANGE", 900)
    rows = corpus(seed)
    assert joined(spark, rows) == brute(rows)


def test_group_of_near_copies_is_not_expanded(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    sets = [ngrams(t) for _, t in rows]
    linked = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert linked > 10_000  # all pairs would be far more than what is verified
    assert joined(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "One two\tthree\nfour"), (8, "É"), (9, "é"),
        (10, "a b c d e"), (11, "a b c d e f"), (12, long), (13, long + " more"), (14, "a\u00a0b"), (15, "a b"), (16, "one\x1ctwo"), (17, "one two"),
    ]
    assert joined(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text), (5, text), (9, text.upper()), (None, text), (None, "nobody else has this text at all"), (None, None)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    got = ngram_join.join(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == sorted(
        [(5, 8, 5), (5, 8, 5), (9, 8, 5), (-1, 8, 5), (-1, 3, -1), (-1, 0, -1)]
    )
    kept = ngram_join.keep_one(df).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == [(-1, ""), (-1, "nobody else has this text at all"), (5, text)]
    assert ngram_join.keep_one(df).columns == df.columns
    assert ngram_join.join(df.limit(0)).count() == ngram_join.keep_one(df.limit(0)).count() == 0


def test_different_texts_under_one_id_stay_apart(spark):
    a, b = ("the quick brown fox jumps over the lazy dog", "a clean text that has nothing to do with any fox")
    df = spark.createDataFrame([(1, a, "k", 1), (1, b, "k", 1), (2, b, "k", 1), (None, a, "k", 1), (None, a, "k", 1)], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect()) == [(1, b), (1, a)]


def test_a_table_of_copies_is_spread(spark, monkeypatch):
    """Blocks are cut by all rows, and equal rows go to different ones."""
    monkeypatch.setattr(ngram_join, "BLOCK", 1000)
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "k", 1)] * 600 + [(2, text + " more", "k", 1)], SCHEMA).repartition(4)
    rows = ngram_join.marked(df, "doc_id", "text", keep_rows=False)
    blocks = rows.select(ngram_join.shared.bucket("mark", 16, 8).alias("b")).groupBy("b").count().collect()
    assert len(blocks) == 16 and max(r["count"] for r in blocks) < 100
    assert sorted(r["component_id"] for r in ngram_join.join(df).collect()) == [1] * 601


def test_one_edited_word_each(spark):
    """Most pairs meet but are not similar; leaders connect what is, so few of them are verified."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(own)))
    assert joined(spark, rows) == brute(rows)


def test_long_lists_meet_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_LIST", 7)
    monkeypatch.setattr(ngram_join, "_ROUNDS", 0)
    rows = corpus(5)
    assert joined(spark, rows) == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    found = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["comp"] for r in found} == {x: c for x, c in parent.items() if x in linked}


def test_filters_never_drop_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a = set(rng.integers(0, 60, n).tolist())
        b = set(a)
        for x in list(a)[: int(rng.integers(0, 4))]:
            b.discard(x)
        b |= set(rng.integers(100, 130, int(rng.integers(0, 4))).tolist())
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        often = defaultdict(int, {x: int(rng.integers(1, 9)) for x in a | b})
        x, y = (sorted(s, key=lambda t: (often[t], t)) for s in (a, b))
        assert set(x[: ngram_join.prefix(len(x))]) & set(y[: ngram_join.prefix(len(y))])


def test_lists_that_join_nothing_more_are_not_kept(spark, monkeypatch):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join([*words, f"end{i}"]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, stored = [], ngram_join.shared.stored

    def noted(df, name):
        table = stored(df, name)
        if name == "postings":
            kept.append(table.count())
        return table

    monkeypatch.setattr(ngram_join.shared, "stored", noted)
    assert {r.component_id for r in ngram_join.join(docs).collect()} == {0}
    # After the first round all are one component, so no list is left for a second.
    assert kept[0] > 0 and kept[1:] == [0]
