"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies. Its whole part is certain; the
fractions are rounded in pairs: mass in words moves from one partner to the other, in a random
direction that leaves both expectations as they are, until one of the two is a whole number. In a pair
of single documents the smaller one becomes whole first, so pairs alone would leave a block's largest documents
to chance. Therefore in a block each document from the largest down pairs with all smaller ones together. What is left
of each block is combined through a reduction tree in pairs, in which the one that is left over pairs with the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm import shared

#: Residuals that one step of the reduction tree combines.
FAN_IN = 64
#: Rows equal in id, source and size that stay in one block.
ALIKE = 1000
_STATE = "mark long, source string, size long, seed long, block long, p double, extra int"


def words(text: Column) -> Column:
    """Number of runs of characters other than white space of ASCII; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, source_size, documents, target`` per source.

    Weights repeat over the sources by code point, null last. Targets share ``share`` times all sizes
    in proportion to the weights, but stop at ``most`` times the source's size; the rest is shared again. That makes a
    target ``min(most * size, level * weight)`` with one level for all, which is found by ordering
    the sources by the level at which they stop. The windows span the sources, one row each.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    open_weight = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / open_weight
    levelled = capped.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least("cap", F.greatest(F.lit(0.0), F.col("level") * F.col("weight")))
    return levelled.select("source", "source_size", "documents", target.alias("target"))


def pivot_pool(sizes: np.ndarray, p: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounded probabilities of documents with the same probability, largest first, and the index of the one that stays
    fractional (-1: none). Each document pairs with the pool of all after it, whose probabilities move together.
    """
    result = np.zeros(len(sizes))
    after = (sizes.sum() - np.cumsum(sizes)).tolist()
    draws = rng.random(len(sizes)).tolist()
    for i, size in enumerate(sizes.tolist()):
        if not 0 < p < 1 or not size:
            # Whole numbers need no partner, and a document without words has no mass to move.
            result[i] = draws[i] < p
            continue
        pool = float(after[i])
        mass = pool * p
        up, down = min(size * (1 - p), mass), min(size * p, pool - mass)
        if not up + down:
            result[i] = p
            result[i + 1 :] = rng.random(len(sizes) - i - 1) < p
            return result, i
        gain = draws[i] * (up + down) < down
        if gain and up < size * (1 - p) or not gain and down < size * p:
            # The pool is used up first: all of it becomes 0 or 1.
            result[i] = p + up / size if gain else p - down / size
            result[i + 1 :] = float(not gain)
            return result, i
        result[i] = float(gain)
        p = (mass - size * (1 - p) if gain else mass + size * p) / pool
        p = min(1.0, max(0.0, p))
    return result, -1


def pivot_pairs(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounded probabilities, and the index of the one that stays fractional (-1: none)."""
    p, held = p.copy(), -1
    for i in np.flatnonzero((p > 0) & (p < 1)).tolist():
        if not sizes[i]:
            # A document without words has no mass to move.
            p[i] = float(rng.random() < p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = float(sizes[held]), float(sizes[i])
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        gain = rng.random() * (up + down) < down
        moved = up if gain else down
        # The side that reaches its bound is set exactly; rounding must not leave it just short.
        held_done = moved >= a * (1 - p[held] if gain else p[held])
        i_done = moved >= b * (p[i] if gain else 1 - p[i])
        sign = 1 if gain else -1
        p[held] = float(gain) if held_done else p[held] + sign * moved / a
        p[i] = float(not gain) if i_done else p[i] - sign * moved / b
        held = -1 if held_done and i_done else i if held_done else held
    return p, held


def _rounding(seed: int, level: int, last: bool):
    def block(table: pa.Table) -> pa.Table:
        return _round(table, seed, level, last)

    return block


def _round(table: pa.Table, seed: int, level: int, last: bool) -> pa.Table:
    """One block's turn: ``extra`` is set where p became a whole number, null where it is left over."""
    sizes, order_keys = table["size"].to_numpy(), table["seed"].to_numpy()
    # Larger documents first, so that what is left over is small.
    order = np.lexsort((order_keys, -sizes))
    table = table.take(pa.array(order))
    block, first = int(table["block"][0].as_py()), int(order_keys[order[0]])
    rng = np.random.default_rng([seed, level, block & (2**63 - 1), first & (2**63 - 1)])
    ordered, p = table["size"].to_numpy(), table["p"].to_numpy()
    p, held = pivot_pairs(ordered, p, rng) if level else pivot_pool(ordered, float(p[0]), rng)
    if last and held >= 0:
        p[held], held = float(rng.random() < p[held]), -1
    extra = [None if i == held else int(x) for i, x in enumerate(p.tolist())]
    table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))
    return table.set_column(table.schema.get_field_index("extra"), "extra", pa.array(extra, pa.int32()))


def _dealt(sized: DataFrame) -> DataFrame:
    """``sized`` with ``piece``: 0, but for rows that more than ``ALIKE`` others equal. Those are numbered, in groups of
    their own, and cut into pieces of that many; how many there are of each piece follows from their count alone.
    """
    alike = ("source", "doc_id", "size")
    often = sized.groupBy(*alike).agg(F.count("*").alias("n")).filter(F.col("n") > ALIKE)
    often = often.select(*[F.col(c).alias(f"of_{c}") for c in alike], "n")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in alike]
    found = sized.join(often, same[0] & same[1] & same[2], "left").select(*sized.columns, "n")
    groups = F.pmod(F.xxhash64("mark"), F.ceil(F.col("n") / ALIKE).cast("int"))
    crowded = found.filter("n IS NOT NULL").withColumn("group", groups)
    sizes = crowded.groupBy(*alike, "group").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(*alike).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*[F.col(c).alias(f"of_{c}") for c in alike], F.col("group").alias("of_group"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*alike, "group").orderBy("mark")
    numbered = crowded.withColumn("turn", F.row_number().over(inside) - 1)
    numbered = numbered.join(first, same[0] & same[1] & same[2] & (F.col("group") == F.col("of_group")))
    numbered = numbered.select(*sized.columns, F.floor((F.col("turn") + F.col("first")) / ALIKE).cast("long").alias("piece"))
    return found.filter("n IS NULL").select(*sized.columns, F.lit(0).cast("long").alias("piece")).unionByName(numbered)


def _mixed(sized: DataFrame, weights: list[float], share: float, most: float, seed: int, block_rows: int) -> DataFrame:
    """``mark, doc_id, source, size, source_size, target, copies, taken`` from ``mark, doc_id, source, size``."""
    wanted = shared.stored(targets(sized, weights, share, most), "targets")
    rate = wanted.withColumn("rate", F.expr("if(source_size = 0, 0D, target / source_size)"))
    rate = rate.withColumn("sure", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.col("sure"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / block_rows)).cast("int")
    rate = rate.select(F.col("source").alias("of"), "source_size", "target", "sure", "p", blocks.alias("blocks"))
    joined = _dealt(sized).join(rate, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    spread = F.xxhash64("doc_id", "size", "piece", F.lit(seed))
    state = joined.select(
        "mark", "source", "size", spread.alias("seed"), F.pmod(spread, "blocks").cast("long").alias("block"), "p",
        F.lit(None).cast("int").alias("extra"),
    )
    most_blocks = rate.agg(F.max("blocks")).first()[0] or 1
    decided, level = [], 0
    while True:
        last = most_blocks == 1
        step = state.groupBy("source", "block").applyInArrow(_rounding(seed, level, last), _STATE)
        step = shared.stored(step, f"rounded-{level}")
        decided.append(step.filter("extra IS NOT NULL"))
        if last:
            break
        state = step.filter("extra IS NULL").withColumn("block", F.expr(f"block div {FAN_IN}"))
        most_blocks, level = -(-most_blocks // FAN_IN), level + 1
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    result = sized.join(extra.select("mark", "extra"), "mark")
    result = result.join(rate.drop("p", "blocks"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.col("sure") + F.col("extra")
    return result.select(
        "mark", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _sized(doc_id: str, text: str, source: str) -> list[Column]:
    return [F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size")]


def mix(
    docs: DataFrame,
    weights: list[float],
    share: float,
    most: float,
    seed: int = 17,
    block_rows: int = 20_000,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row.

    ``copies`` is 0 up to ``most``, rounded up; ``taken`` is copies times size. A null text has size 0; a null source is a
    source of its own. A source without words has target 0 and no copies. Repeated rows and null ids are documents of
    their own. Further columns are ignored. The same rows and seed give the same result, however the rows are partitioned, but that rows
    equal in id, source and size may change places.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("mark"), *_sized(doc_id, text, source))
    return _mixed(shared.stored(rows, "sizes"), weights, share, most, seed, block_rows).drop("mark")


def mixed_rows(
    docs: DataFrame,
    weights: list[float],
    share: float,
    most: float,
    seed: int = 17,
    block_rows: int = 20_000,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns are those of ``docs``, whatever their names.

    Rows and decisions meet by a mark that is written with the rows, so that equal rows need not be told apart again.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("mark"), *_sized(doc_id, text, source))
    held = shared.stored(held, "rows")
    taken = _mixed(held.select("mark", "doc_id", "source", "size"), weights, share, most, seed, block_rows)
    kept = taken.filter("copies > 0").select(F.col("mark").alias("of"), "copies")
    paired = held.select("mark", "row").join(kept, F.col("mark") == F.col("of"))
    return paired.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
