"""Similarity join of documents on their sets of word n-grams (Jaccard).

Documents with equal sets are one class; one of them stands for it. How many classes hold an n-gram is counted by
blocks: a block of documents sends its distinct n-grams to the ranges of the hash space and gets
their frequencies back. Ordered rarest first, a document can only be similar to another if they share an n-gram of
its prefix, so n-grams that no other document holds cost nothing, and a document with too many
of them is done. Prefix postings meet by n-gram under length, positional and suffix filters.

Groups of similar documents are not expanded into pairs: in rounds, each document is verified against a few leaders of
each of its postings lists, what links becomes one component, and lists whose documents are all connected drop out. What pairs
between different components are left are then verified, each once, so that no link is lost.

Rows are told apart by marks of their own, so ids may be repeated or missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm import shared

WORDS = 5
#: Similar from I / U = 80 / 100 on, kept as whole numbers.
PARTS, WHOLE = 80, 100
#: N-grams of a block of documents, and of a range of the hash space; a task holds one at a time.
BLOCK, RANGE = 600_000, 1_000_000
_SHORT = 40
_CLASSES = 8
_TAIL = [f"c{i}" for i in range(_CLASSES)]
_SETS = "mark long, n int, alone int, grams binary"


_CHUNK = 2**18
_rng = np.random.default_rng(20)
#: A random number per byte, the same for both cases of a letter.
_BYTES = _rng.integers(0, 2**64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_FACTORS = _rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[np.uint64, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2 to the 64."""
    if base not in _powers or len(_powers[base]) < n:
        row = np.full(max(n, _CHUNK), base, np.uint64)
        row[0] = 1
        _powers[base] = np.multiply.accumulate(row)
    return _powers[base][:n]


def _mix(values: np.ndarray) -> np.ndarray:
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word: the polynomial of its bytes, from differences of running sums."""
    inside = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts])


def _hashed(text: bytes) -> np.ndarray:
    """Hashes of a text's words, long texts chunk by chunk; a chunk ends where a word does."""
    data, parts, at = np.frombuffer(text, np.uint8), [], 0
    while len(data) - at > _CHUNK:
        end = at + _CHUNK
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        parts.append(_word_hashes(data[at:end]))
        at = end
    parts.append(_word_hashes(data[at:]))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def grams(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams; of a shorter text that of the whole sequence."""
    words = _hashed(text)
    n = len(words) - WORDS + 1
    if n < 1:
        # A sequence shorter than an n-gram has its own kind of hash.
        return _mix((words * _FACTORS[: len(words)]).sum(keepdims=True) ^ _FACTORS[-len(words)]) if len(words) else words
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        total += words[i : i + n] * factor
    return np.unique(_mix(total))


def prefix(n: int) -> int:
    """Length of the prefix that must meet any similar set's prefix."""
    return n - -(-PARTS * n // WHOLE) + 1


def marked(docs: DataFrame, doc_id: str, text: str, keep_rows: bool) -> DataFrame:
    """``mark, doc_id, body`` of every row, written once, since a mark must mean the same row in all that follows; with
    ``row`` for all columns of ``docs``."""
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("body")]
    if keep_rows:
        columns.append(F.struct(*docs.columns).alias("row"))
    return shared.stored(docs.select(F.monotonically_increasing_id().alias("mark"), *columns), "marked")


def sizes(rows: DataFrame) -> DataFrame:
    """``mark, doc_id, n, key`` per row: number of n-grams and a digest of the set (null if empty)."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = [], []
            for cell in batch["body"]:
                own = grams(cell.as_py())
                counts.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            columns = [batch["mark"], batch["doc_id"], pa.array(counts, pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "doc_id", "n", "key"])

    return rows.select("mark", "doc_id", "body").mapInArrow(sized, "mark long, doc_id long, n int, key binary")


def _block_sets(texts: pa.Table, wanted: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Sets of the rows that stand for a class."""
    chosen = texts.filter(pa.compute.is_in(texts["mark"], pa.array(wanted, pa.int64())))
    return [(mark, grams(body.as_py())) for mark, body in zip(chosen["mark"].to_pylist(), chosen["body"])]


def _short(hashes: np.ndarray) -> np.ndarray:
    """The part of a hash by which frequencies are counted; hashes that share it count together."""
    return hashes >> np.uint64(64 - _SHORT)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Low bytes of 64-bit numbers, as planes, which the shuffle compresses well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").copy()


def _runs(ranges: int):
    def runs(texts: pa.Table, chosen: pa.Table) -> pa.Table:
        rows = {"range": [], "of_block": [], "steps": [], "counts": []}
        sets = _block_sets(texts, chosen["chosen"].to_numpy()) if chosen.num_rows and texts.num_rows else []
        if sets:
            block = chosen["block"][0].as_py()
            values, counts = np.unique(np.concatenate([_short(s) for _, s in sets]), return_counts=True)
            place = (values * np.uint64(ranges)) >> np.uint64(_SHORT)
            bounds = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))
            for r in np.unique(place).tolist():
                a, b = bounds[r], bounds[r + 1]
                rows["range"].append(r)
                rows["of_block"].append(block)
                rows["steps"].append(_pack(np.diff(values[a:b], prepend=np.uint64(0)), 5))
                rows["counts"].append(_pack(counts[a:b], 4))
        return pa.table([pa.array(c, t) for c, t in zip(rows.values(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], list(rows))

    return runs


def _frequencies(part: pa.Table) -> pa.Table:
    """For each block's n-grams of this range a byte: 0 if no other document holds it, else a step of its frequency's logarithm."""
    steps = [np.cumsum(_unpack(x, 5), dtype=np.uint64) for x in part["steps"].to_pylist()]
    counts = np.concatenate([_unpack(x, 4) for x in part["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(steps), return_inverse=True)
    often = np.bincount(inverse, counts)
    code = np.where(often < 2, 0, np.minimum(255, np.floor(8 * np.log2(np.maximum(often, 2))))).astype(np.uint8)[inverse]
    ends = np.cumsum([len(s) for s in steps])
    codes = [code[e - len(s) : e].tobytes() for s, e in zip(steps, ends)]
    return pa.table(
        {"block": part["of_block"], "chosen": pa.nulls(len(codes), pa.int64()), "range": part["range"], "codes": pa.array(codes, pa.binary())}
    )


def _ordered(texts: pa.Table, side: pa.Table) -> pa.Table:
    """Documents that may have a partner, with the n-grams that others share, rarest first."""
    chosen = side["chosen"].drop_null().to_numpy()
    rows, sets = [], []
    if texts.num_rows and len(chosen):
        sets = _block_sets(texts, chosen)
    if sets:
        replies = side.filter(pa.compute.is_valid(side["range"])).sort_by("range")
        codes = np.frombuffer(b"".join(replies["codes"].to_pylist()), np.uint8)
        values, place = np.unique(np.concatenate([_short(own) for _, own in sets]), return_inverse=True)
        if len(values) != len(codes):
            raise ValueError("frequencies do not belong to this block")
        each = np.split(codes[place], np.cumsum([len(own) for _, own in sets])[:-1])
        for (mark, own), code in zip(sets, each):
            held = code > 0
            alone = len(own) - int(np.count_nonzero(held))
            if alone < prefix(len(own)):
                shared_grams = own[held]
                order = np.lexsort((shared_grams, code[held]))
                rows.append((mark, len(own), alone, shared_grams[order].tobytes()))
    columns = zip(*rows) if rows else ((), (), (), ())
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["mark", "n", "alone", "grams"])


def ordered_sets(rows: DataFrame, chosen: DataFrame, total: int, distinct: int) -> DataFrame:
    """``mark, n, alone, grams`` of the ``chosen`` rows that may be similar to another.

    Blocks are cut by ``total``, the number of n-grams of all rows, for the texts of all meet there; ranges of the hash
    space by ``distinct``, that of the chosen rows.
    """
    blocks, ranges = max(1, -(-total // BLOCK)), max(1, -(-distinct // RANGE))
    texts = rows.select("mark", "body", shared.bucket("mark", blocks, 8).alias("text_block"))
    asked = chosen.select(F.col("mark").alias("chosen"), shared.bucket("mark", blocks, 8).alias("block"))
    sent = texts.groupBy("text_block").cogroup(asked.groupBy("block"))
    runs = sent.applyInArrow(_runs(ranges), "range int, of_block int, steps binary, counts binary")
    replies = runs.groupBy("range").applyInArrow(_frequencies, "block int, chosen long, range int, codes binary")
    nothing = F.lit(None)
    side = asked.select("block", "chosen", nothing.cast("int").alias("range"), nothing.cast("binary").alias("codes"))
    return texts.groupBy("text_block").cogroup(replies.unionByName(side).groupBy("block")).applyInArrow(_ordered, _SETS)


def postings(sets: DataFrame) -> DataFrame:
    """``gram, mark, n, pos, c0 ...``: each prefix n-gram with its place in the order and how many n-grams of each
    class of hashes come after it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for mark, n, alone, data in zip(*(batch[c].to_pylist() for c in ("mark", "n", "alone", "grams"))):
                own = np.frombuffer(data, np.uint64)
                k = prefix(n) - alone
                kind = (own & np.uint64(_CLASSES - 1)).astype(np.int64)
                seen = np.cumsum(kind[:, None] == np.arange(_CLASSES), axis=0)
                after = (seen[-1] - seen)[:k].astype(np.int32)
                first = own[:k].astype(np.int64)
                held.append((first, np.full(k, mark), np.full(k, n, np.int32), (alone + np.arange(k)).astype(np.int32), after))
            if held:
                gram, doc, n, pos, after = (np.concatenate(x) for x in zip(*held))
                columns = [gram, doc, n, pos, *after.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["gram", "mark", "n", "pos", *_TAIL])

    tail = ", ".join(f"{c} int" for c in _TAIL)
    return sets.mapInArrow(rows, f"gram long, mark long, n int, pos int, {tail}")


def _may_link(a: str, b: str) -> str:
    """Length, positional and suffix filter of two postings of one n-gram.

    The last two hold at the first n-gram that a pair shares, where every pair is met.
    """
    least = f"{PARTS} * ({a}.n + {b}.n)"
    both = PARTS + WHOLE
    length = f"{WHOLE} * least({a}.n, {b}.n) >= {PARTS} * greatest({a}.n, {b}.n)"
    place = f"{both} * (1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1) >= {least}"
    suffix = f"{both} * (1 + {' + '.join(f'least({a}.{c}, {b}.{c})' for c in _TAIL)}) >= {least}"
    return f"{length} AND {place} AND {suffix}"


#: Members that one task compares with a leader, and rows of a list that are compared with each other.
_TOGETHER, _LIST = 200, 1000
#: Leaders of a list in rounds behind the first, rounds of leaders at most, and pairs left for each posting up to which all
#: are compared. Most of them do not pass the filters, so looking at one is cheap.
_LEADERS, _ROUNDS, _PAIRS = 16, 3, 8


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, y, linked`` of each pair, compared exactly. Pairs meet at y, of which popular ones are split."""
    often = pairs.groupBy("y").agg(F.ceil(F.count("*") / _TOGETHER).cast("int").alias("parts"))
    dealt = pairs.join(often, "y").withColumn("part", shared.bucket("x", 2**30, 3) % F.col("parts"))
    members = dealt.select("y", "part", F.col("x").alias("mark"))
    leaders = often.select("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("y").alias("mark"))
    rows = members.unionByName(leaders).join(sets.select("mark", "n", "grams"), "mark")

    def compare(part: pa.Table) -> pa.Table:
        y, marks = part["y"][0].as_py(), part["mark"].to_pylist()
        held = list(zip(marks, part["n"].to_pylist(), (np.sort(np.frombuffer(g, np.uint64)) for g in part["grams"].to_pylist())))
        m, other = next((n, own) for mark, n, own in held if mark == y)
        linked = {
            mark: (PARTS + WHOLE) * len(np.intersect1d(own, other, assume_unique=True)) >= PARTS * (n + m)
            for mark, n, own in held
            if mark != y
        }
        columns = [pa.array(linked.keys(), pa.int64()), pa.array([y] * len(linked), pa.int64()), pa.array(linked.values(), pa.bool_())]
        return pa.table(columns, ["x", "y", "linked"])

    return rows.groupBy("y", "part").applyInArrow(compare, "x long, y long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node that each node of ``a, b`` is connected with.

    Labels pass along edges and then jump to the label of their label, until none changes.
    """
    both = shared.stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = shared.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        met = labels.join(near, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("next"))
        target = labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        jumped = met.join(target, "next", "left").select(
            "node", F.least("next", F.coalesce("beyond", "next")).alias("comp"), F.col("comp").alias("before")
        )
        jumped = shared.stored(jumped, "labels")
        changed = jumped.filter("comp <> before").limit(1).count()
        labels = jumped.drop("before")
        if not changed:
            return labels


def _merged(crossing: DataFrame) -> DataFrame:
    """``comp, into`` from links of components ``a, b``: each that is connected with a smaller one moves to the smallest."""
    return components(crossing).filter("comp <> node").select(F.col("node").alias("comp"), F.col("comp").alias("into"))


def _mixed(lists: DataFrame) -> DataFrame:
    """``gram, all, same, comps`` of the lists that still join different components. Only these matter."""
    spread = lists.groupBy("gram", "comp").agg(F.count("*").alias("m")).groupBy("gram").agg(
        F.sum("m").alias("all"), F.expr("sum(m * m)").alias("same"), F.count("*").alias("comps")
    )
    return shared.stored(spread.filter("comps > 1"), "mixed")


def _moved(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows with their component after a merge."""
    return rows.join(merged, "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")


def links(sets: DataFrame) -> DataFrame:
    """``a, b``: edges that connect all that is connected by any links. A component goes by its smallest mark, and an edge joins
    two components, so there are few where many rows link."""
    spark = sets.sparkSession
    lists = shared.stored(postings(sets).withColumn("comp", F.col("mark")), "postings")
    found, done = [], None
    mixed = _mixed(lists)
    current = lists.join(mixed.select("gram", "all"), "gram")
    for turn in range(_ROUNDS + 1):
        left = mixed.agg(F.sum(F.expr("(all * all - same) div 2")), F.sum("all")).first()
        if not left[0]:
            break
        final = turn == _ROUNDS or left[0] <= (_PAIRS if turn else 3) * left[1]
        pairs = _all_pairs(current) if final else _star_pairs(current, turn)
        if done is not None:
            pairs = pairs.join(done, ["x", "y"], "left_anti")
        compared = shared.stored(verify(shared.stored(pairs, "pairs"), sets), "compared")
        linked = compared.filter("linked").select("x", "y")
        label = shared.stored(current.select("mark", "comp").distinct(), "members")
        a, b = (label.select(F.col("mark").alias(end), F.col("comp").alias(name)) for end, name in (("x", "a"), ("y", "b")))
        crossing = linked.join(a, "x").join(b, "y").select("a", "b").distinct()
        if final:
            found.append(crossing)
            break
        merged = shared.stored(_merged(crossing), "merged")
        found.append(merged.select(F.col("comp").alias("a"), F.col("into").alias("b")))
        both_ways = compared.select("x", "y").union(compared.select("y", "x"))
        done = both_ways if done is None else done.union(both_ways)
        # What is still mixed shows in the components alone; only its rows are stored and dealt in the next round.
        mixed = _mixed(_moved(lists.select("gram", "comp"), merged))
        lists = current = shared.stored(_moved(lists.drop("all").join(mixed.select("gram", "all"), "gram"), merged), "postings")
    if not found:
        return spark.createDataFrame([], "a long, b long")
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def _star_pairs(current: DataFrame, turn: int) -> DataFrame:
    """Each document with the leaders of each of its lists, where those are of another component and pass the filters.

    A list has one leader per class of sizes in the first round, and up to ``_LEADERS`` in later ones, which see what is hard to
    connect; the borders of the classes move from round to round.
    """
    of_size = F.floor(F.log("n") / F.log(F.lit(WHOLE / PARTS)) + turn / 2).cast("int")
    sized = current.withColumn("size_class", of_size)
    own = ("mark", "comp", "n", "pos", *_TAIL)
    slot = shared.bucket("mark", _LEADERS if turn else 1, 50 + turn)
    turned = F.xxhash64("mark", F.lit(turn))
    leaders = sized.groupBy("gram", "size_class", slot.alias("slot")).agg(*[F.min_by(c, turned).alias(f"lead_{c}") for c in own])
    leaders = leaders.select("gram", "size_class", F.struct(*[F.col(f"lead_{c}").alias(c) for c in own]).alias("lead"))
    met = sized.alias("a").join(leaders, ["gram", "size_class"]).filter(f"a.comp <> lead.comp AND {_may_link('a', 'lead')}")
    return met.select(
        F.expr("greatest(a.mark, lead.mark) AS x"), F.expr("least(a.mark, lead.mark) AS y")
    ).distinct()


def _all_pairs(current: DataFrame) -> DataFrame:
    """Every pair of different components that passes the filters, once. A long list is cut into parts, and parts meet in pairs."""
    parts = F.ceil(F.col("all") / _LIST).cast("int")
    dealt = current.withColumn("parts", parts).withColumn("part", shared.bucket("mark", 2**30, 4) % F.col("parts"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sides = dealt.withColumn("other", others)
    first = sides.withColumns({"i": F.col("part"), "j": F.col("other")}).filter("i <= j")
    second = sides.withColumns({"i": F.col("other"), "j": F.col("part")}).filter("i <= j")
    met = first.alias("a").join(
        second.alias("b"),
        F.expr(
            "a.gram = b.gram AND a.i = b.i AND a.j = b.j AND a.comp <> b.comp AND (a.i < a.j OR a.mark < b.mark) "
            f"AND {_may_link('a', 'b')}"
        ),
    )
    return met.select(F.expr("greatest(a.mark, b.mark) AS x"), F.expr("least(a.mark, b.mark) AS y")).distinct()


def _joined(rows: DataFrame) -> DataFrame:
    """``mark, doc_id, n, component, component_id`` per row of ``marked``; ``component`` is null without n-grams."""
    sized = shared.stored(sizes(rows), "sizes")
    keyed = sized.filter("n > 0")
    classes = keyed.groupBy("key").agg(F.min("mark").alias("chosen"), F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = shared.stored(classes, "classes")
    distinct = classes.agg(F.sum("n")).first()[0] or 0
    total = keyed.agg(F.sum("n")).first()[0] or 0
    sets = shared.stored(ordered_sets(rows, classes.select(F.col("chosen").alias("mark")), total, distinct), "sets")
    labelled = components(links(sets))
    placed = classes.join(labelled, F.col("chosen") == F.col("node"), "left")
    placed = placed.select("key", "rep", F.coalesce("comp", "chosen").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = placed.select("key", "component").join(least, "component")
    joined = sized.join(known, "key", "left")
    return joined.select("mark", "doc_id", "n", "component", F.coalesce("component_id", F.when(F.col("component").isNull(), F.col("doc_id"))).alias("component_id"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row.

    Words are runs of characters other than ASCII white space, A-Z in lower case; n-grams have five words, and a
    shorter text is one n-gram. Two documents link from a Jaccard similarity of 0.8 on; component_id is the smallest id
    that links reach, the own one included. A null or empty text has no n-grams and no links. Repeated rows
    are documents with equal sets; rows that share an id but not the text are different documents. A row without an id gets the
    smallest id of its component, or null if none has one. Further columns are ignored; an empty table gives an empty result.
    Sets are compared by 64-bit hashes of their n-grams.
    """
    joined = _joined(marked(docs, doc_id, text, keep_rows=False))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of similar documents, that of the smallest id (rows without an id come last), and all rows
    without n-grams. Ids may be repeated or missing: rows with different texts under one id are different documents.
    Columns are those of ``docs``."""
    rows = marked(docs, doc_id, text, keep_rows=True)
    joined = shared.stored(_joined(rows), "joined")
    grouped = joined.filter("component IS NOT NULL").groupBy("component")
    chosen = grouped.agg(F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("mark"))
    kept = chosen.select("mark").unionByName(joined.filter("component IS NULL").select("mark"))
    return rows.select("mark", "row").join(kept, "mark", "left_semi").select("row.*")
