"""Prefix trie of conversations with subtree totals, by time-forward processing.

Each node of the trie is a distinct sequence of first turns. Its key is known without building the trie: the
digests of the turns at their places, combined over a prefix. Counting rows by key gives the nodes; a node is
named by its depth and the smallest conversation that goes through it.

Totals of subtrees travel from nodes to parents as messages. A node whose subtree may be large is left for later;
below these the trie falls into subtrees of bounded size, which are dealt to shards. In a shard, nodes come in
reverse level order, sorted externally by Spark, and a priority queue, which spills, holds the
messages until their receivers come up. The roots of the shards send theirs to the nodes that were left, on
which the same is done again, until none is left.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm import shared

#: Rows of a conversation whose digests one window combines.
BLOCK = 4096
#: A subtree of fewer rows is never split, and one of more than this part of all rows always is.
SMALLEST, SHARDS = 500, 2000
#: Messages that a task keeps in memory.
IN_MEMORY = 200_000
#: Conversations whose ids are one piece of text on the way to the digest.
LISTED = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Messages by time, smallest first; beyond ``limit`` the queue goes to disk as a sorted run, to be merged on the way out.

    Runs are unnamed files in Spark's local folders, like Spark's own spills: no other task reads them.
    """

    def __init__(self, limit: int = IN_MEMORY):
        self._limit, self._heap, self._runs, self.spills = limit, [], [], 0
        # Heads of the runs, with the run they come from.
        self._heads: list[tuple] = []

    def push(self, message: tuple) -> None:
        heapq.heappush(self._heap, message)
        if len(self._heap) > self._limit:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
        run = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        for message in sorted(self._heap):
            pickle.dump(message, run)
        run.seek(0)
        self._heap = []
        self._runs.append(run)
        self.spills += 1
        self._advance(len(self._runs) - 1)

    def _advance(self, number: int) -> None:
        try:
            heapq.heappush(self._heads, (pickle.load(self._runs[number]), number))
        except EOFError:
            self._runs[number].close()

    def pop_until(self, time: tuple) -> Iterator[tuple]:
        """Takes all messages whose first fields are at most ``time``."""
        n = len(time)
        while True:
            fresh = self._heap and self._heap[0][:n] <= time
            old = self._heads and self._heads[0][0][:n] <= time
            if fresh and (not old or self._heap[0] <= self._heads[0][0]):
                yield heapq.heappop(self._heap)
            elif old:
                message, number = heapq.heappop(self._heads)
                self._advance(number)
                yield message
            else:
                return


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, role, text``: each conversation's turns numbered from 1, by turn (null first), role and text.

    A null role or text is empty. Rows without a conversation belong to none and go. Rows are ranked by a range
    partitioning of all of them, so that a conversation of any length is spread; a row's place in its
    conversation is its place in its partition and the conversation's rows in partitions before.
    """
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("mark"),
    )
    rows = shared.stored(rows, "turns")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "mark"]
    parts = max(1, -(-size // 4_000_000))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = shared.stored(ranged.withColumn("part", F.shiftright("at", 33)), "ranged")
    # A row per conversation and partition that holds a part of it.
    spans = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1 - F.col("first")
    spans = spans.select("conv_id", "part", offset.alias("offset"))
    return ranged.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("offset")).alias("pos"), "role", "text")


def crc_of_id(conv_id: Column) -> Column:
    """Unsigned crc32 of the decimal id."""
    return F.crc32(conv_id.cast("string").cast("binary"))


def rebuilt(ordered: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from a group's leader: ``conv_id, depth, role, text`` of the turns, and ``conv_id, turns``.

    Conversation c takes the first h turns of conversation c - c % group, then its own turns after its first h; h is the
    crc32 of c modulo ``most``. A leader has at most 2 * group followers, so what is copied is bounded.
    """
    h = F.pmod(crc_of_id(F.col("conv_id")), F.lit(most))
    sizes = shared.stored(ordered.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    followers = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("leader"))
    leading = sizes.select(F.col("conv_id").alias("leader"), F.least("n", F.lit(most)).alias("offered"))
    joined = followers.join(leading, "leader", "left")
    taken = F.least("h", F.coalesce("offered", F.lit(0)))
    lengths = joined.select(
        "conv_id", "leader", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")
    )
    lengths = shared.stored(lengths, "lengths")
    own = ordered.join(lengths.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    offered = ordered.filter((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "leader")
    lent = offered.join(lengths.select("conv_id", "leader", "taken"), "leader").filter("pos <= taken")
    return own.unionByName(lent.select("conv_id", F.col("pos").alias("depth"), "role", "text")), lengths.select("conv_id", "turns")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, depth, turns, words, own_a, own_b, a, b``: the key (a, b) of each prefix of each conversation.

    A turn's digest is of its place, role and text, so the digests of a prefix, combined by exclusive or, are those of its sequence. They
    are combined in blocks of turns, and the blocks' totals are carried on, so that a conversation of any length is spread.
    """
    digests = [F.xxhash64(F.lit(seed), "depth", "role", "text").alias(name) for seed, name in ((11, "own_a"), (29, "own_b"))]
    rows = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), words(F.col("text")).alias("words"), *digests)
    blocked = rows.withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.withColumns({"a": F.bit_xor("own_a").over(so_far), "b": F.bit_xor("own_b").over(so_far)})
    # Blocks behind the first are few: one per thousands of rows.
    totals = blocked.groupBy("conv_id", "block").agg(F.bit_xor("own_a").alias("a"), F.bit_xor("own_b").alias("b"), F.max("depth").alias("to"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumns({"before_a": F.bit_xor("a").over(earlier), "before_b": F.bit_xor("b").over(earlier)})
    carried = carried.filter("block > 0").select("conv_id", "block", "before_a", "before_b")
    joined = inside.join(carried, ["conv_id", "block"], "left")
    found = joined.select(
        "conv_id", "depth", "words", "own_a", "own_b",
        *[F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))).alias(c) for c in "ab"],
    )
    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", "words", "own_a", "own_b", "a", "b")]
    return found.unionByName(lengths.select("conv_id", *nothing)).join(lengths, "conv_id")


def nodes_of(steps: DataFrame) -> DataFrame:
    """``depth, node, a, b, parent_a, parent_b, n_convs, words, weight``: the trie's nodes, ``node`` being the smallest conversation.

    ``weight`` counts the rows of all members from here on, of which the subtree cannot have more nodes.
    """
    return steps.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("node"),
        F.count("*").alias("n_convs"),
        F.min("words").alias("words"),
        F.min(F.col("a").bitwiseXOR(F.col("own_a"))).alias("parent_a"),
        F.min(F.col("b").bitwiseXOR(F.col("own_b"))).alias("parent_b"),
        F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
    )


_TOTALS = "depth long, node long, n_children long, n_leaves long, saved_tokens long"
_STATE = ("depth", "node", "parent", "saved", "children_in", "leaves_in", "saved_in")


def forward(rows: Iterable[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Totals of nodes in reverse level order. Each adds up what its children have sent by its time, and sends to its parent.

    A row is (depth, node, parent, own saving, and what came from shards before: children, leaves, savings).
    """
    for depth, node, parent, saved, children, leaves, saved_below in rows:
        saved += saved_below
        for message in queue.pop_until((-depth, node)):
            if message[:2] == (-depth, node):
                children += 1
                leaves += message[3]
                saved += message[4]
        leaves = leaves if children else 1
        # The child's name makes messages of equal content differ in order only.
        if depth:
            queue.push((1 - depth, parent, node, leaves, saved))
        yield depth, node, children, leaves, saved


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    queue, names = SpillingQueue(IN_MEMORY), [c.split()[0] for c in _TOTALS.split(", ")]
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in _STATE)))
    done = forward(rows, queue)
    while held := [row for _, row in zip(range(20_000), done)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names)


def totals(nodes: DataFrame, walk: DataFrame) -> DataFrame:
    """``depth, node, n_children, n_leaves, saved_tokens`` of every node, the last two summed over its subtree.

    ``nodes`` has ``depth, node, parent, saved, weight``; ``walk`` has ``conv_id, depth, node, weight`` of every prefix of
    every conversation. A round takes all subtrees whose weight is at most a two-thousandth of all rows; what is
    left has a conversation per such weight at most, so few rounds follow, and one more for every so many turns of the
    longest conversation.
    """
    nothing = F.lit(0).cast("long")
    state = nodes.select("depth", "node", "parent", "saved", "weight", *[nothing.alias(c) for c in _STATE[4:]])
    done = []
    while True:
        total = state.agg(F.max(F.when(F.col("depth") == 0, F.col("weight")))).first()[0]
        if total is None:
            break
        most = max(SMALLEST, -(-total // SHARDS))
        # Where each conversation's path leaves the nodes that are too heavy: the root of a subtree, which names its shard.
        light = walk.filter(F.col("weight") <= most)
        cuts = light.groupBy(F.col("conv_id").alias("node")).agg(F.min("depth").alias("cut"), F.min_by("node", "depth").alias("top"))
        joined = shared.stored(state.join(cuts, "node", "left"), "round")
        inside = joined.filter("cut IS NOT NULL AND depth >= cut")
        shards = max(1, -(-total // (20 * most)))
        dealt = inside.repartition(shards, F.xxhash64("cut", "top")).sortWithinPartitions(F.desc("depth"), "node")
        found = shared.stored(dealt.select(*_STATE).mapInArrow(_shards, _TOTALS), "totals")
        done.append(found)
        left = joined.filter("cut IS NULL OR depth < cut").drop("cut", "top")
        # Messages of the shards' roots to the nodes that are left.
        roots = inside.filter("depth = cut AND depth > 0").select("depth", "node", "parent").join(found, ["depth", "node"])
        sent = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(
            F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("more")
        )
        arrived = left.join(sent, ["depth", "node"], "left")
        sums = {"children_in": "children", "leaves_in": "leaves", "saved_in": "more"}
        arrived = arrived.withColumns({k: F.col(k) + F.coalesce(v, nothing) for k, v in sums.items()}).drop(*sums.values())
        # One conversation per node below which nothing is left stands for all; weights count those.
        walk = walk.filter(F.col("weight") > most)
        ends = walk.groupBy("conv_id").agg(F.max("depth").alias("end"), F.max_by("node", "depth").alias("last"))
        ends = ends.filter("conv_id = last").select("conv_id", "end")
        kept = walk.drop("weight").join(ends, "conv_id")
        weights = kept.groupBy("depth", "node").agg(F.sum(F.col("end") - F.col("depth") + 1).alias("weight"))
        weights = shared.stored(weights, "weights")
        walk = shared.stored(kept.drop("end").join(weights, ["depth", "node"]), "walk")
        state = shared.stored(arrived.drop("weight").join(weights, ["depth", "node"]), "left")
    if not done:
        return nodes.select("depth", "node", *[nothing.alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of conversations that end at one node, as pieces of text."""
    held: list[int] = []
    of, out = None, []

    def flush() -> None:
        if held:
            out.append((*of, held[0], ",".join(map(str, held))))
            held.clear()

    def batch() -> pa.RecordBatch:
        columns = zip(*out)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["depth", "node", "first", "ids"])
        out.clear()
        return made

    for part in batches:
        for depth, node, conv in zip(*(part[c].to_pylist() for c in ("depth", "node", "conv_id"))):
            if (depth, node) != of or len(held) >= LISTED:
                flush()
                of = depth, node
            held.append(conv)
            if len(out) >= 2000:
                yield batch()
    flush()
    if out:
        yield batch()


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, joined by commas."""
    of, digest, out = None, None, []
    names = ["depth", "node", "ends_sha256"]
    for part in batches:
        for depth, node, ids in zip(*(part[c].to_pylist() for c in ("depth", "node", "ids"))):
            if (depth, node) == of:
                digest.update(b",")
            else:
                if of:
                    out.append((*of, digest.hexdigest()))
                of, digest = (depth, node), hashlib.sha256()
            digest.update(ids.encode())
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
            out = []
    if of:
        out.append((*of, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)


def ends(walk: DataFrame) -> DataFrame:
    """``depth, node, ends_sha256`` of the nodes at which conversations end: the digest of their ids, ascending, comma-joined.

    Ids are joined in ranges of all (node, id) first, so a node at which very many end is a row per thousands of them in the
    one task that its digest, which cannot be split, needs.
    """
    last = walk.filter("depth = turns").select("depth", "node", "conv_id")
    parts = max(1, -(-last.count() // 50_000))
    order = ("depth", "node", "conv_id")
    ranged = last.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = shared.stored(ranged.mapInArrow(_listing, "depth long, node long, first long, ids string"), "ends")
    met = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return met.mapInArrow(_hashing, "depth long, node long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of the conversations in ``turns`` (``conv_id, depth, role, text``, depths 1 to ``turns`` of
    ``lengths``, which has one row per conversation, also of those without turns).

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, each node's words times its members but one), ``ends_sha256``. Without
    conversations there is no node. Prefixes are compared by 128-bit digests.
    """
    steps = shared.stored(paths(turns, lengths), "paths")
    nodes = shared.stored(nodes_of(steps), "nodes")
    keyed = nodes.select("depth", "a", "b", "node", "weight")
    walk = shared.stored(steps.select("conv_id", "depth", "turns", "a", "b").join(keyed, ["depth", "a", "b"]).drop("a", "b"), "walk")
    above = keyed.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("node").alias("parent")
    )
    saved = (F.col("n_convs") - 1) * F.col("words")
    placed = nodes.join(above, ["depth", "parent_a", "parent_b"], "left")
    placed = shared.stored(placed.select("depth", "node", "parent", "n_convs", "weight", saved.alias("saved")), "placed")
    summed = totals(placed, walk.select("conv_id", "depth", "node", "weight"))
    joined = placed.select("depth", "node", "parent", "n_convs").join(summed, ["depth", "node"])
    joined = joined.join(ends(walk), ["depth", "node"], "left")
    return joined.select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt from their group's leader.

    Turns that tie in their number (or have none) go by role and text; a null role or text is empty; rows without a conversation go. Rows
    that are repeated are turns of their own. Further columns are ignored; an empty table has no nodes.
    """
    turns, lengths = rebuilt(shared.stored(ordered_turns(conversations), "ordered"))
    return trie(turns, lengths)
