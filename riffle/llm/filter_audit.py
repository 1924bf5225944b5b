"""Audit of how text filters interact, over all orders in which they may run.

Every document is reduced to the set of filters that it fails. Documents are tabulated by part and
set, from which follows what each coalition of filters removes; what a filter removes as a step of an order is the
difference of two coalitions. A filter's Shapley value, its share of all removals over all orders, is the
exact solution of a least squares problem: values whose sums come closest to the removals of
all coalitions under the Shapley kernel, and add up to what all filters remove together. The normal
equations are solved in rationals, once for all tables, since they only depend on the number of filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.llm import shared

#: Filters of texts, by letter; bit i of a set of failures stands for the i-th.
TEXT_FILTERS = "ABCDE"
# Limits of the filters.
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Solution of a regular system for several right sides (as columns), by elimination in rationals."""
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(k: int) -> list[list[int]]:
    """For each of ``k`` filters a whole number per coalition (by its bits): k! times the filter's Shapley value is
    the sum of these numbers times what the coalitions remove.

    Minimise the sum over coalitions S, neither empty nor whole, of kernel(S) (removed(S) - sum of the values
    in S)^2 under sum of all values = removed(all). With a multiplier for the condition the normal equations are
    linear in the removals, so solving them for each coalition's removal being one gives the weights.
    """
    whole = 2**k - 1
    kernel = {s: Fraction(k - 1, comb(k, s.bit_count()) * s.bit_count() * (k - s.bit_count())) for s in range(1, whole)}
    inside = [[Fraction(s >> i & 1) for i in range(k)] for s in range(whole + 1)]
    normal = [[sum((w * inside[s][i] * inside[s][j] for s, w in kernel.items()), Fraction(0)) for j in range(k)] for i in range(k)]
    matrix = [[*row, Fraction(1)] for row in normal] + [[*[Fraction(1)] * k, Fraction(0)]]
    right = [[kernel.get(s, Fraction(0)) * inside[s][i] for s in range(whole + 1)] for i in range(k)]
    right.append([Fraction(s == whole) for s in range(whole + 1)])
    scaled = [[factorial(k) * x for x in row] for row in solve(matrix, right)[:k]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("k! times a Shapley weight is a whole number")
    return [[int(x) for x in row] for row in scaled]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, odd symbols."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # The words are a lambda's argument, so that they are found once.
    sized = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]

    def bits(size: Column) -> Column:
        failed = [
            size["n"] < FEWEST_WORDS,
            100 * size["distinct"].cast("long") < DISTINCT_PERCENT * size["n"].cast("long"),
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
            text.rlike(r"[#$%&*|]"),
        ]
        first, *rest = [F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(failed)]
        return sum(rest, first)

    return F.transform(F.array(sized), bits)[0]


def tabulate(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """``part, failed, n, good, toxic``: documents by part and set of failed filters A to E.

    Texts are read once; from then on rows hold a digest. E fails a document whose text some smaller id
    holds.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_failures(body).alias("own"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
    )
    rows = shared.stored(rows, "failures")
    judged = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    judged = rows.filter("id IS NOT NULL").join(judged, "id", "left")
    unknown = rows.filter("id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return _by_failures(judged.unionByName(unknown))


_COUNTS = ("n", "good", "toxic")


def _by_failures(rows: DataFrame) -> DataFrame:
    """Documents by part and set of failed filters, from ``id, part, own, digest, good, toxic``.

    Rows are counted by digest, part and id first, which spreads a group of copies; of its ids a task then sends on the
    least and the sums of all, so what meets by digest is one row per part.
    """
    counted = [F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")]]
    per_id = rows.groupBy("digest", "part", "own", "id").agg(*counted)
    texts = per_id.filter("id IS NOT NULL").groupBy("digest", "part", "own").agg(
        F.min("id").alias("least"),
        *[F.sum(c).alias(c) for c in _COUNTS],
        *[F.min_by(c, "id").alias(f"least_{c}") for c in _COUNTS],
    )
    firsts = texts.groupBy("digest").agg(F.min("least").alias("first_id"))
    early = [f"if(least = first_id, least_{c}, 0L)" for c in _COUNTS]
    late = [f"{c} - if(least = first_id, least_{c}, 0L)" for c in _COUNTS]
    told = f"stack(2, own, {', '.join(early)}, own + {1 << 4}, {', '.join(late)}) AS (failed, {', '.join(_COUNTS)})"
    known = texts.join(firsts, "digest").selectExpr("part", told)
    found = known.unionByName(per_id.filter("id IS NULL").select("part", F.col("own").alias("failed"), *_COUNTS))
    return found.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def coalitions(table: DataFrame, k: int, counts: Sequence[str] = ("n", "good", "toxic")) -> DataFrame:
    """``part`` and, per count, ``total_<count>`` and ``removed_<count>``: an array of what each coalition removes, by its bits.

    A part has at most 2^k rows in ``table``, so gathering them is bounded.
    """
    cells = table.groupBy("part").agg(F.collect_list(F.struct("failed", *counts)).alias("cells"))
    columns = []
    for c in counts:
        total = f"aggregate(cells, 0L, (sum, x) -> sum + x.{c}) AS total_{c}"
        hit = f"aggregate(filter(cells, x -> x.failed & s != 0), 0L, (sum, x) -> sum + x.{c})"
        columns += [total, f"transform(sequence(0, {2**k - 1}), s -> {hit}) AS removed_{c}"]
    return cells.selectExpr("part", *columns)


def steps(names: str) -> Column:
    """One struct per order and step: ``filter_order, step, f`` (the filter's number) and the coalition ``before``."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(f"struct('{''.join(names[i] for i in order)}', {step}, {f}, {before})")
            before |= 1 << f
    return F.expr(f"inline(array({', '.join(rows)})) AS (filter_order, step, f, before)")


def audit(table: DataFrame, names: str = TEXT_FILTERS) -> DataFrame:
    """One row per part, order and step of what ``table`` (``part, failed, n, good, toxic``) says.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; ``shapley`` is
    the filter's removals summed over all orders. ``names`` has a letter per filter, the first one standing for
    bit 0 of ``failed``; their factorial many orders should stay few.
    """
    k = len(names)
    weights = ", ".join(f"array({', '.join(f'{w}L' for w in row)})" for row in shapley_weights(k))
    held = coalitions(table, k).withColumn(
        "shares",
        F.expr(
            f"transform(array({weights}), w -> "
            "aggregate(zip_with(w, removed_n, (a, b) -> a * b), 0L, (sum, x) -> sum + x))"
        ),
    )
    spread = held.select("*", steps(names))
    after = "before | shiftleft(1, f)"
    alone = f"{2**k - 1} & ~shiftleft(1, f)"
    removed = f"removed_n[{after}] - removed_n[before]"
    return spread.selectExpr(
        "part",
        "filter_order",
        "step",
        f"total_n - removed_n[{after}] AS kept",
        f"{removed} AS removed",
        f"removed_n[shiftleft(1, f)] - ({removed}) AS redundant",
        f"removed_n[{2**k - 1}] - removed_n[{alone}] AS unique_fails",
        f"removed_good[{after}] - removed_good[before] AS good_lost",
        f"removed_toxic[{after}] - removed_toxic[before] AS toxic_lost",
        "shares[f] AS shapley",
    )


def audit_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five text filters over whole texts.

    A null text is empty, a null part is the empty string. A row without an id has no smaller id and no label, and no
    other row's copy is judged by it. Repeated rows count each; rows that share an id do not make each other copies. A document is good (toxic) if any of its label
    rows says so. Further columns are ignored, an empty table gives an empty result.
    """
    return audit(tabulate(docs, labels, doc_id, text, part))
