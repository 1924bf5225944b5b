"""Exact token counts of every prefix of a text, by dynamic programming, stored for later questions.

The last token of a prefix's encoding decides its count: it is one more than that of the prefix before
this token. Of the tokens that end a prefix exactly one leaves the last token before it as it is, which is tested by undoing merges
on both sides of the seam. So one pass over a piece gives the counts of all its prefixes. A worker does
that once per distinct piece; a text's counts are those of its pieces on top of the counts before them.
Where the end of a prefix changes how the pre-tokenizer splits it (white space before a word,
endings such as 've, strings of special tokens) the pieces are those of the prefix.
The counts are stored as compressed differences in frames, so that truncation and budget questions
are answered from them without encoding anything again.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.llm import token_ids

#: Numbers that a worker remembers for its pieces.
REMEMBERED = 4_000_000
#: Characters of short texts whose units are learned together.
GROUP = 2**21
#: Characters of a piece that is worked on beside others, and pieces at once.
LONGEST, TOGETHER = 48, 20_000
_LETTER, _SPACE, _ENDING = token_ids._LETTER, token_ids._SPACE, token_ids._ENDING
_REST = rf"[^{_SPACE}{_LETTER}0-9]+"
#: What a prefix's end may split differently stays in one unit: a word with all white space before it.
_UNIT = re.compile(
    rf" ?[{_LETTER}]+|{_ENDING}| ?[0-9]+| ?{_REST}|[{_SPACE}]+ (?:[{_LETTER}]+|[0-9]+|{_REST})|[{_SPACE}]+"
)
_IS_ENDING = re.compile(_ENDING)
#: One piece, whatever its prefix.
_SIMPLE = re.compile(rf"(?!{_ENDING}$) ?[!-~{_LETTER}]{{1,{LONGEST}}}")


class Merges:
    """A byte-level vocabulary by its merges: counts of all prefixes of a piece in one pass."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix")):
            raise ValueError("counts of prefixes need a byte-level vocabulary of plain merges")
        byte_of = {c: b for b, c in enumerate(token_ids.byte_alphabet())}
        ids = model["vocab"]
        token_of = {bytes([b]): ids[c] for c, b in byte_of.items()}
        n = max(ids.values()) + 1
        # When a token is made, of which two, and when two tokens that meet are merged.
        self._time, self._left, self._right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        met: dict[int, int] = {}
        for time, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[left + right]
            met[ids[left] << 32 | ids[right]] = time
            if self._time[made] < 0:
                self._time[made], self._left[made], self._right[made] = time, ids[left], ids[right]
                token_of[bytes(byte_of[c] for c in left + right)] = made
        self._pairs = np.array(sorted(met), np.int64)
        self._when = np.array([met[pair] for pair in self._pairs.tolist()], np.int64)
        self._plant(token_of)

    def _plant(self, token_of: dict[bytes, int]) -> None:
        """The tokens as a tree: a branching state and a byte lead to a state (0: none), and some states are tokens."""
        follow: dict[int, int] = {}
        at = [-1]
        for token, found in token_of.items():
            state = 0
            for byte in token:
                state = follow.setdefault(state << 8 | byte, len(at))
                if state == len(at):
                    at.append(-1)
            at[state] = found
        self._at, keys = np.array(at, np.int64), np.array(list(follow), np.int64)
        branching, place = np.unique(keys >> 8, return_inverse=True)
        self._branch = np.full(len(at), -1, np.int32)
        self._branch[branching] = np.arange(len(branching))
        self._next = np.zeros((len(branching), 256), np.int32)
        self._next[place, keys & 255] = list(follow.values())

    def _seams(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair stay side by side: merges are undone latest first, and no tokens that then
        meet at the seam may be merged before the undone one. Of equal merges the one further left comes first.
        """
        holds, open_ones = np.ones(len(left), bool), np.arange(len(left))
        limit = np.full(len(left), len(self._when))
        while len(open_ones):
            pairs = left << 32 | right
            place = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
            merged = (self._pairs[place] == pairs) & (self._when[place] < limit)
            holds[open_ones[merged]] = False
            by_left, by_right = self._time[left], self._time[right]
            undo_left = by_left > by_right
            go = ~merged & (undo_left | (by_right >= 0))
            limit = np.where(undo_left, by_left, by_right + 1)[go]
            left, right, undo_left, open_ones = left[go], right[go], undo_left[go], open_ones[go]
            left, right = np.where(undo_left, self._right[left], left), np.where(undo_left, right, self._left[right])
        return holds

    def table(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each prefix of each piece: a row per length of the prefix from 0, a column per piece, which come
        with the longest first."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths[0])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width).T
        longer = np.searchsorted(-lengths, -np.arange(width + 1), "left")
        last, count = np.full((width + 1, len(pieces)), -1, np.int64), np.zeros((width + 1, len(pieces)), np.int32)
        for start in range(width):
            # All tokens that begin here; what ends before here is decided.
            rows = np.arange(longer[start])
            branch = np.zeros(len(rows), np.int32)
            for end in range(start, width):
                stay = slice(0, np.searchsorted(rows, longer[end]))
                rows = rows[stay]
                state = self._next[branch[stay], data[end, rows]]
                token = self._at[state]
                new = np.flatnonzero((token >= 0) & (last[end + 1, rows] < 0))
                if start and len(new):
                    # Many pieces ask for the same pair.
                    pairs, which = np.unique(last[start, rows[new]] << 32 | token[new], return_inverse=True)
                    new = new[self._seams(pairs >> 32, pairs & 0xFFFFFFFF)[which]]
                last[end + 1, rows[new]] = token[new]
                count[end + 1, rows[new]] = count[start, rows[new]] + 1
                branch = self._branch[state]
                going = np.flatnonzero((state > 0) & (branch >= 0))
                if not len(going):
                    break
                rows, branch = rows[going], branch[going]
        return count

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the prefixes of pieces, character by character, one piece behind the other; and the lengths."""
        pieces = [text.encode() for text in texts]
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        ordered = [pieces[i] for i in order.tolist()]
        count = self.table(ordered)
        # A prefix ends in front of a byte that begins a character, or with the piece.
        joined, ends = np.frombuffer(b"".join(pieces) + b" ", np.uint8), np.cumsum([len(p) for p in pieces])
        sizes = np.diff(ends, prepend=0)
        column = np.empty(len(pieces), np.int64)
        column[order] = np.arange(len(pieces))
        row = np.arange(1, ends[-1] + 1) - np.repeat(ends - sizes, sizes)
        whole = (joined[1:] & 0xC0) != 0x80
        found = count[row[whole], np.repeat(column, sizes)[whole]]
        return found, np.add.reduceat(whole, ends - sizes, dtype=np.int64)

    def prefixes(self, text: str) -> list[int]:
        """Counts of the prefixes of one piece, character by character; a long piece is followed along, not at every start at once."""
        if len(text) <= LONGEST:
            return self.many([text])[0].tolist()
        data, follow, at = text.encode(), self._next, self._at
        last, count = np.full(len(data) + 1, -1, np.int64), np.zeros(len(data) + 1, np.int64)
        for start in range(len(data)):
            branch, ends, tokens = 0, [], []
            for end in range(start, len(data)):
                state = follow[branch, data[end]]
                if at[state] >= 0 and last[end + 1] < 0:
                    ends.append(end + 1)
                    tokens.append(at[state])
                branch = self._branch[state]
                if not state or branch < 0:
                    break
            if ends:
                ends, tokens = np.array(ends), np.array(tokens)
                if start:
                    holds = self._seams(np.full(len(tokens), last[start]), tokens)
                    ends, tokens = ends[holds], tokens[holds]
                last[ends], count[ends] = tokens, count[start] + 1
        whole = (np.frombuffer(data + b" ", np.uint8)[1:] & 0xC0) != 0x80
        return count[1:][whole].tolist()


class Counter:
    """Counts of all prefixes of texts, by units that are learned once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._sections = token_ids.Sections(spec)
        specials = self._sections.strings
        pattern, normal = token_ids._steps(spec)
        if pattern is None or normal or not self._sections.plain or any(a != b and a in b for a in specials for b in specials):
            raise ValueError("counts of prefixes need byte-level pieces of texts as they are")
        self._merges = Merges(spec)
        self._classes = token_ids.Classes(Tokenizer.from_file(path).pre_tokenizer, True)
        self._forget()

    def _forget(self) -> None:
        # A row has the differences of a unit's counts; some units add something else to what goes on behind them.
        self._memo, self._rows, self._corrections = token_ids.Memo(), token_ids.Rows("<i2"), token_ids.Rows("<i2")

    def _plain(self, text: str) -> str:
        return text.translate(self._classes) if token_ids._OTHER.search(text) else text

    def _numbers(self, text: str) -> Iterator[np.ndarray]:
        number, plain = self._memo.__getitem__, self._plain(text)
        if plain is text and len(text) <= token_ids.LONG:
            units = _UNIT.findall(text)
            yield np.fromiter(map(number, units), np.int32, len(units))
            return
        found = (text[slice(*m.span())] for m in _UNIT.finditer(plain))
        while len(part := np.fromiter(map(number, islice(found, token_ids.LONG)), np.int32)):
            yield part

    def _unit(self, unit: str) -> tuple[list[int], int]:
        """Counts of the unit's prefixes, and what the unit adds to prefixes that go on behind it."""
        of, plain = self._merges.prefixes, self._plain(unit)
        spaces = len(plain) - len(plain.lstrip(" \t\n\r"))
        if spaces < 2 and (len(unit) > spaces or not spaces):
            counts = of(unit)
            if len(unit) == 3 and _IS_ENDING.fullmatch(plain):
                # Two of the three characters are a sign and a letter, not yet an ending.
                counts[1] = counts[0] + of(unit[1])[0]
            return counts, counts[-1]
        run = of(unit[:spaces])
        before = run[-2] if spaces > 1 else 0
        if len(unit) == spaces:
            # Behind it goes what takes no space with it: the last one is a piece of its own.
            return run, before + of(unit[-1])[0]
        word = of(unit[spaces - 1 :])
        counts = run + [before + c for c in word[1:]]
        return counts, counts[-1]

    def _learn(self) -> None:
        """Units that are one piece, as most are, are learned together, all others one by one; numbers are kept in order."""
        new = self._memo.taken()
        for at in range(0, len(new), TOGETHER):
            units = new[at : at + TOGETHER]
            simple = [_SIMPLE.fullmatch(unit) is not None for unit in units]
            lengths = np.fromiter(map(len, units), np.int64, len(units))
            ends = np.cumsum(lengths)
            flat, corrections = np.zeros(int(ends[-1]), np.int32), np.zeros(len(units), np.int16)
            if one := [unit for unit, alone in zip(units, simple) if alone]:
                flat[np.repeat(np.array(simple), lengths)] = self._merges.many(one)[0]
            for i in [i for i, alone in enumerate(simple) if not alone]:
                counts, step = self._unit(units[i])
                flat[ends[i] - lengths[i] : ends[i]] = counts
                corrections[i] = step - counts[-1]
            differences = np.diff(flat, prepend=0)
            starts = ends - lengths
            differences[starts] = flat[starts]
            if np.abs(differences).max() > 2**15 - 1:
                raise OverflowError("a character changes a count by more than a row holds")
            self._rows.extend_flat(differences, lengths)
            self._corrections.extend_flat(corrections, np.ones(len(units), np.int64))

    def _frames(self, sections: Iterable[tuple[str, str, Iterable[np.ndarray]]]) -> Iterator[np.ndarray]:
        """Differences of the counts of a text's prefixes, part by part; a section is ordinary text, the string of the
        special token behind it and the numbers of the units of both as ordinary text."""
        before = 0
        for part, special, units in sections:
            # The count before the next unit, less that of the last prefix; counts so far and where the part ends.
            owed, count, at_end, ends_at, seen = 0, before, before, len(part), 0
            for numbers in units:
                if not len(numbers):
                    continue
                self._learn()
                steps, lengths = self._rows.take(numbers)
                steps = steps.astype(np.int32)
                behind = self._corrections.take(numbers)[0]
                if owed or behind.any():
                    starts = np.cumsum(lengths) - lengths
                    steps[starts[1:]] += behind[:-1]
                    steps[0] += owed
                owed = int(behind[-1])
                if special:
                    if seen < ends_at <= seen + len(steps):
                        at_end = count + int(steps[: ends_at - seen].sum())
                    if seen + len(steps) == ends_at + len(special):
                        # Complete, the string is one token behind the text before it.
                        steps[-1] += at_end + 1 - count - int(steps.sum())
                seen, count = seen + len(steps), count + int(steps.sum())
                yield steps
            before = count

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The index of each text, see ``PrefixCounts``. Short texts are learned together, long ones part by part."""
        held, size = [], 0
        for text in texts:
            sections = ((part, special, self._numbers(part + special)) for part, special, _ in self._sections(text))
            if len(text) <= token_ids.LONG:
                sections = [(part, special, list(units)) for part, special, units in sections]
            held.append(sections)
            size += len(text)
            if size > GROUP:
                yield from self._given(held)
                held, size = [], 0
        yield from self._given(held)

    def _given(self, held: list) -> Iterator[bytes]:
        for sections in held:
            yield pack(self._frames(sections))
        if self._rows.size > REMEMBERED:
            self._forget()

    def __call__(self, text: str) -> bytes:
        return next(self.batch([text]))


_FRAME = struct.Struct("<4QB")


def pack(frames: Iterable[np.ndarray]) -> bytes:
    """Frames of differences of counts, each behind its number of characters, its last and lowest count, its size in bytes
    and the bytes of a difference (1 or 4)."""
    press, out, before = zstandard.ZstdCompressor(level=1), [], 0
    for steps in frames:
        if len(steps):
            width = 1 if -128 <= steps.min() and steps.max() < 128 else 4
            data = press.compress(steps.astype(f"<i{width}").tobytes())
            counts = np.cumsum(steps)
            out += [_FRAME.pack(len(steps), before + int(counts[-1]), before + int(counts.min()), len(data), width), data]
            before += int(counts[-1])
    return b"".join(out)


class PrefixCounts:
    """The stored counts of a text's prefixes; only the frames that a question touches are decoded."""

    def __init__(self, data: bytes):
        self._data, self._frames, at, chars, before = data, [], 0, 0, 0
        while at < len(data):
            n, last, lowest, size, width = _FRAME.unpack_from(data, at)
            at += _FRAME.size
            self._frames.append((chars, n, before, lowest, at, size, width))
            at, chars, before = at + size, chars + n, last
        self.chars, self.total = chars, before

    def _counts(self, frame: tuple) -> np.ndarray:
        _, _, before, _, at, size, width = frame
        steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._data[at : at + size]), f"<i{width}")
        return before + np.cumsum(steps, dtype=np.int64)

    def __iter__(self) -> Iterator[int]:
        """Counts of the prefixes of 1, 2, ... characters."""
        for frame in self._frames:
            yield from self._counts(frame).tolist()

    def at(self, chars: int) -> int:
        """Tokens of the prefix of so many characters; of the whole text if it has fewer."""
        if chars <= 0:
            return 0
        for frame in self._frames:
            if chars <= frame[0] + frame[1]:
                return int(self._counts(frame)[chars - frame[0] - 1])
        return self.total

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens. Counts may fall as a prefix grows, so it is looked
        for from the end."""
        for frame in reversed(self._frames):
            if frame[3] <= budget:
                return frame[0] + int(np.flatnonzero(self._counts(frame) <= budget)[-1]) + 1
        return 0


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker and file."""
    return Counter(path)


_INDEX = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_counts binary"
#: Bytes of stored counts that leave a worker at once.
_BATCH = 8_000_000


def index(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_chars, n_tokens, prefix_counts`` of every row; ``n_tokens`` is the count of the longest prefix.

    A null text is empty and has no tokens, a null id stays null. Rows that are equal or share an id are counted each.
    Texts are counted whole, however long, part by part. Strings of special tokens count one where they are complete, as the library
    has it. Further columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            held, size = [], 0
            texts = (cell.as_py() for cell in batch["text"])
            lengths = zip(pc.binary_length(batch["text"]).to_pylist(), pc.utf8_length(batch["text"]).to_pylist())
            for one, (n_bytes, n_chars), data in zip(batch["doc_id"].to_pylist(), lengths, count.batch(texts)):
                held.append((one, n_bytes, n_chars, PrefixCounts(data).total, data))
                size += len(data)
                if size > _BATCH:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return rows.mapInArrow(counted, _INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def prefix_tokens(counts: Column, chars: Column) -> Column:
    """Tokens of the prefix of ``chars`` characters, from stored counts; null if one of them is."""

    @F.pandas_udf("long")
    def ask(stored, lengths):
        import pandas as pd

        pairs = zip(stored, lengths)
        return pd.Series([None if s is None or pd.isna(n) else PrefixCounts(s).at(int(n)) for s, n in pairs], dtype="Int64")

    return ask(counts, chars.cast("long"))


def longest_prefix(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from stored counts; null if one of them is."""

    @F.pandas_udf("long")
    def ask(stored, budgets):
        import pandas as pd

        pairs = zip(stored, budgets)
        return pd.Series([None if s is None or pd.isna(n) else PrefixCounts(s).longest(int(n)) for s, n in pairs], dtype="Int64")

    return ask(counts, budget.cast("long"))


def truncated(docs: DataFrame, indexed: DataFrame, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens.

    ``indexed`` has one row per id, as ``index`` gives for a table with unique ids. A row whose id is null or not in it keeps its text.
    """
    limits = indexed.select(F.col("doc_id").alias("_id"), longest_prefix(F.col("prefix_counts"), F.lit(budget)).alias("_chars"))
    joined = docs.join(limits, F.col(doc_id) == F.col("_id"), "left")
    cut = F.when(F.col("_chars").isNull(), F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.col("_chars").cast("int")))
    return joined.withColumn(text, cut).select(*docs.columns)
