"""Conversation trie against a brute-force one; queue that spills, rounds, long and repeated conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riffle.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [x[2:] for x in sorted(held)] for c, held in own.items()}
    whole = {}
    for c, held in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = turns.get(leader, [])[:h] + held[h:]
    members, below = defaultdict(list), defaultdict(set)
    for c, held in whole.items():
        for d in range(len(held) + 1):
            members[tuple(held[:d])].append(c)
    for key in members:
        for d in range(len(key) + 1):
            below[key[:d]].add(key)
    result = {}
    for key, convs in members.items():
        inner = below[key]
        parents = {k[:-1] for k in inner if k}
        saved = sum((len(members[k]) - 1) * len(_words(k[-1][1])) for k in inner if k)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(key))
        result[min(convs), len(key)] = (
            min(members[key[:-1]]) if key else None,
            len(convs),
            len({k for k in inner if len(k) == len(key) + 1}),
            len([k for k in inner if k not in parents]),
            saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return result


def _words(text):
    return [w for w in bytes(32 if b in (9, 10, 11, 12, 13) else b for b in text).split(b" ") if w]


def found(spark, rows, parts=3):
    df = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    held = df.collect()
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in held}
    assert len(got) == len(held)
    return got


def random_rows(seed, convs, longest=6):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c - 15, t, rng.choice("ua"), rng.choice(["yes", "no no", "", "a  b\tc"]), "clash", 1))
    return rows


ODD = [
    (0, None, None, None), (0, None, "a", "x"), (0, 1, "u", "hello there"), (0, 1, "u", "hello there"), (1, 5, "u", "hello there"),
    (2, 0, None, ""), (3, 3, "u", None), (None, 1, "u", "lost"), (45, 1, "u", "no leader"), (46, 1, "u", "no leader"),
    (-7, 0, "u", "hello there"), (41, 0, "u", "x" * 100_000 + " y"),
]


def test_trie_equals_brute_force(spark):
    rows = random_rows(1, 70) + [(*r, "clash", 2) for r in ODD]
    assert found(spark, rows) == brute(rows)


def test_many_rounds_and_spills(spark, monkeypatch):
    """Subtrees of at most four rows, and conversations of several blocks."""
    monkeypatch.setattr(prefix_trie, "SMALLEST", 4)
    monkeypatch.setattr(prefix_trie, "SHARDS", 10**6)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "LISTED", 2)
    rows = random_rows(2, 40, 4) + [(200, t, "u", f"long {t}", "x", 1) for t in range(9)]
    assert found(spark, rows) == brute(rows)


def test_one_conversation_and_copies(spark):
    rows = [(1, t, "u", f"turn {t}", "x", 1) for t in range(400)]
    assert found(spark, rows) == brute(rows)
    copies = [(c, t, "u", f"same {t}", "x", 1) for c in range(300) for t in range(4)]
    assert found(spark, copies) == brute(copies)


def test_no_conversations(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, 1, "u", "x", "x", 1)]) == {}


def test_long_conversations_are_spread(spark):
    """Places follow from a range partitioning, also of equal rows."""
    rows = spark.range(30_000).select(
        F.lit(7).cast("long").alias("conv_id"), (F.col("id") % 3).alias("turn"), F.lit("u").alias("role"), F.lit("w " * 200).alias("text")
    )
    ordered = prefix_trie.ordered_turns(rows)
    assert ordered.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first() == (30_000, 30_000, 1, 30_000)


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_queue_gives_messages_in_order(limit):
    rng, queue, waiting = random.Random(limit), prefix_trie.SpillingQueue(limit), []
    for step in range(300):
        message = (rng.randint(step // 3, 120), rng.randint(0, 5), rng.random())
        queue.push(message)
        waiting.append(message)
        if step % 7 == 0:
            upto = (step // 3, 2)
            taken = list(queue.pop_until(upto))
            assert taken == sorted(m for m in waiting if m[:2] <= upto)
            waiting = [m for m in waiting if m[:2] > upto]
    assert list(queue.pop_until((1000, 0))) == sorted(waiting)
    assert queue.spills > 0 or limit == 1000


def test_time_forward_passes_totals_up():
    """A root, two children, and two leaves under the first of them; rows come by reverse level."""
    rows = [(2, 1, 1, 5, 0, 0, 0), (2, 4, 1, 0, 0, 0, 0), (1, 1, 1, 3, 0, 0, 0), (1, 9, 1, 0, 1, 7, 100), (0, 1, None, 0, 0, 0, 0)]
    got = list(prefix_trie.forward(rows, prefix_trie.SpillingQueue(1)))
    assert got == [(2, 1, 0, 1, 5), (2, 4, 0, 1, 0), (1, 1, 2, 2, 8), (1, 9, 1, 7, 100), (0, 1, 2, 9, 108)]
