"""Filter interaction audit against a brute-force run of all orders."""

from collections import defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riffle.llm import filter_audit

DOCS = "doc_id long, text string, source string, failed string, n int"
LABELS = "doc_id long, quality int, toxic int, part string"
WORDS = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def failures(doc_id, text, docs):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    smaller = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in docs)
    tests = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": smaller,
    }
    return {f for f, failed in tests.items() if failed}


def brute(docs, labels):
    good, toxic = ({d for d, *x, _ in labels if x[i] == 1 and d is not None} for i in (0, 1))
    found = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for order in permutations("ABCDE"):
        for doc_id, text, source, *_ in docs:
            failed, gone = failures(doc_id, text or "", docs), False
            for step, f in enumerate(order, 1):
                row = found[source or "", "".join(order), step]
                hit = f in failed
                row[0] += not hit and not gone
                row[1] += hit and not gone
                row[2] += hit and gone
                row[3] += failed == {f}
                row[4] += hit and not gone and doc_id in good
                row[5] += hit and not gone and doc_id in toxic
                shapley[source or "", f] += hit and not gone
                gone |= hit
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def audited(spark, docs, labels):
    rows = filter_audit.audit_texts(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    return {tuple(r[:3]): tuple(r[3:]) for r in rows.collect()}


def test_all_orders_equal_brute_force(spark):
    docs = [
        (1, None, None), (2, "", None), (3, "short", "a"), (4, "short", "b"), (None, "short", "a"), (4, "short", "b"),
        (5, WORDS, "a"), (6, WORDS.upper(), "a"), (7, WORDS + " # extra", "b"), (8, WORDS, "b"), (0, WORDS, ""),
        (9, "a b " * 40, "a"), (10, "a B$ " * 40, "a"), (11, "a B$ " * 40, "a"), (None, None, None), (12, "É" * 19 + "A\tx y", "c"),
        (13, "Long " * 30_000, "c"),
    ]
    docs = [(*d, "clash", 1) for d in docs]
    labels = [(1, 1, 0, "x"), (4, 0, 1, "x"), (4, 1, 0, "x"), (8, 1, 1, "x"), (10, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")]
    got = audited(spark, docs, labels)
    assert got == brute(docs, labels)
    assert len(got) == 600 * 4


def test_a_third_of_the_rows_are_copies(spark):
    docs = [(i, "same text" if i % 3 == 0 else f"text {i}", f"s{i % 2}", "x", 1) for i in range(300)]
    assert audited(spark, docs, []) == brute(docs, [])


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1, "x")]) == {}
    assert len(audited(spark, [(1, "x", "a", "x", 1)], [])) == 600


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_weights_are_those_of_the_definition(k):
    """Averages of marginal contributions over all orders, for each unit game."""
    weights = filter_audit.shapley_weights(k)
    for unit in range(1, 2**k):
        want = [0] * k
        for order in permutations(range(k)):
            before = 0
            for f in order:
                want[f] += ((before | 1 << f) == unit) - (before == unit)
                before |= 1 << f
        assert [row[unit] for row in weights] == want
    assert sum(row[-1] for row in weights) == factorial(k)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=3, max_size=3), st.lists(st.integers(-9, 9), min_size=3, max_size=3))
def test_solver_is_exact(matrix, right):
    a = [[Fraction(x) for x in row] for row in matrix]
    det = sum(a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(3))
    if det:
        x = filter_audit.solve(a, [[Fraction(b)] for b in right])
        assert [sum(p * q[0] for p, q in zip(row, x)) for row in a] == right
