"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library.

A text is cut at the strings of special tokens, which are ids of their own as the library has it, and what lies
between is split into the pieces of the library's pre-tokenizer. The library's model encodes each distinct
piece once per worker; the ids of a text are those of its pieces in order. Which class (letter, digit, white
space, other) an unusual character has for the library is asked of its own pre-tokenizer, once for each such character.
Texts of a vocabulary whose steps are not known here go to the library as a whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np

#: Characters whose classes, case and normal form all engines agree on.
_OTHER = re.compile(r"[^\x20-\x7e\t\n\r\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_LETTER, _SPACE = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r" \t\n\r"
# Words come first for speed; no other alternative begins like one.
_ENDING = "'(?:[stmd]|re|ve|ll)"
_BYTE_LEVEL_PIECE = (
    rf" ?[{_LETTER}]+|{_ENDING}| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD_PIECE = rf"[{_LETTER}]+|{_ENDING}|[0-9]|[^{_SPACE}{_LETTER}0-9]+"
# Fixed value: the split pattern of the word vocabularies.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = np.zeros(0, np.int32)
#: Distinct pieces that a worker remembers.
REMEMBERED = 400_000
#: Characters of a text from which its pieces are found part by part.
LONG = 2**18


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, all others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Classes(dict):
    """Translation of unusual characters to plain ones of the same class, as the library's pre-tokenizer has it."""

    def __init__(self, pre_tokenizer, keeps_spaces: bool):
        super().__init__()
        self._split, self._keeps_spaces = pre_tokenizer.pre_tokenize_str, keeps_spaces

    def _class(self, c: str) -> str:
        def one(text: str) -> bool:
            return len(self._split(text)) == 1

        if self._keeps_spaces:
            # A character that continues a run of its class makes no second piece.
            return next((plain for plain in "a0\n" if one(plain + c)), "!")
        if not self._split(c):
            return "\n"
        # Digits are pieces of one character each here.
        return "a" if one("a" + c) else "!" if one(c + c) else "0"

    def __missing__(self, point: int) -> str:
        c = chr(point)
        found = self._class(c) if _OTHER.match(c) else c
        if len(self) < 2**16:
            self[point] = found
        return found


class Sections:
    """Cuts texts at the strings of special tokens, the longest first."""

    def __init__(self, spec: dict):
        added = spec.get("added_tokens") or []
        self.plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self._ids = {t["content"]: t["id"] for t in added}
        self.strings = ordered = sorted(self._ids, key=len, reverse=True)
        self._find = re.compile("|".join(map(re.escape, ordered))).finditer if ordered else None

    def __call__(self, text: str) -> Iterator[tuple[str, str, int]]:
        """(ordinary text, string of the special token behind it, its id); the last has no token (-1)."""
        at = 0
        if self._find:
            for found in self._find(text):
                yield text[at : found.start()], found[0], self._ids[found[0]]
                at = found.end()
        yield text[at:] if at else text, "", -1


class Memo(dict):
    """Numbers distinct pieces as they come; what belongs to the new ones is learned later."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, piece) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


class Rows:
    """Rows of numbers of different lengths in one array that grows."""

    def __init__(self, kind: str):
        self._data, self._starts, self._lengths = np.zeros(1024, kind), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.count = self.size = 0

    def extend(self, rows: Sequence[Sequence[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.extend_flat(np.fromiter((x for row in rows for x in row), self._data.dtype, int(lengths.sum())), lengths)

    def extend_flat(self, numbers: np.ndarray, lengths: np.ndarray) -> None:
        """Rows of these lengths, one behind the other in ``numbers``."""
        count, size = self.count + len(lengths), self.size + len(numbers)
        self._data, self._starts, self._lengths = _fitting(self._data, size), _fitting(self._starts, count), _fitting(self._lengths, count)
        self._data[self.size : size] = numbers
        self._starts[self.count : count] = self.size + np.cumsum(lengths) - lengths
        self._lengths[self.count : count] = lengths
        self.count, self.size = count, size

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of these numbers, one behind the other, and their lengths."""
        if not len(which):
            return self._data[:0], self._lengths[:0]
        lengths = self._lengths[which]
        ends = np.cumsum(lengths, dtype=np.int32)
        return self._data[np.repeat(self._starts[which] - ends + lengths, lengths) + np.arange(ends[-1], dtype=np.int32)], lengths


def _fitting(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    larger = np.zeros(max(n, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


def _steps(spec: dict) -> tuple[re.Pattern | None, bool]:
    """Pattern of the pieces, and whether texts pass the normalizer of the word vocabularies first."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    steps = [s["type"] for s in (normal or {}).get("normalizers", [normal] if normal else [])]
    if spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("dropout") or spec.get("truncation") or spec.get("padding"):
        return None, False
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not steps:
        return re.compile(_BYTE_LEVEL_PIECE), False
    parts = pre.get("pretokenizers", [])
    if [p["type"] for p in parts] == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"]:
        cut = parts[0]
        plain = not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
        if plain and cut["invert"] and cut["behavior"] == "Removed" and cut["pattern"] == {"Regex": _WORD_SPLIT}:
            return re.compile(_WORD_PIECE), True
    return None, False


class Encoder:
    """Texts to ids, as the library gives them without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._sections = Sections(spec)
        self._pattern, self._normal = _steps(spec) if self._sections.plain else (None, False)
        self._letters = dict(enumerate(byte_alphabet()))
        self._classes = Classes(self._tokenizer.pre_tokenizer, not self._normal)
        self._forget()

    def _forget(self) -> None:
        self._memo, self._rows = Memo(), Rows("<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _pieces(self, text: str) -> Iterable[str]:
        if _OTHER.search(text):
            if self._normal:
                text = self._tokenizer.normalizer.normalize_str(text)
            # The pattern is matched on plain characters of the same classes, place by place.
            plain = text.translate(self._classes)
            return (text[slice(*m.span())] for m in self._pattern.finditer(plain))
        if self._normal:
            text = text.lower()
        return self._pattern.findall(text) if len(text) <= LONG else (m[0] for m in self._pattern.finditer(text))

    def _numbers(self, text: str) -> Iterator[np.ndarray]:
        """Numbers of the pieces, special tokens as pieces of their own."""
        number = self._memo.__getitem__
        for part, _, special in self._sections(text):
            pieces = self._pieces(part)
            if isinstance(pieces, list):
                yield np.fromiter(map(number, pieces), np.int32, len(pieces))
            else:
                pieces = iter(pieces)
                while len(found := np.fromiter(map(number, islice(pieces, LONG)), np.int32)):
                    yield found
            if special >= 0:
                yield np.array([number((special,))], np.int32)

    def _learn(self) -> None:
        tokens, rows = self._tokenizer.model.tokenize, []
        for piece in self._memo.taken():
            if isinstance(piece, tuple):
                rows.append(piece)
            else:
                mapped = piece.encode().decode("latin-1").translate(self._letters)
                rows.append([t.id for t in tokens(mapped)])
        self._rows.extend(rows)

    def batch(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers. New pieces are learned together."""
        if self._pattern is None:
            yield from map(self.whole, texts)
            return
        held, size = [], 0
        for text in texts:
            held.append(list(self._numbers(text)))
            size += len(text)
            if size >= LONG:
                yield from self._given(held)
                held, size = [], 0
        yield from self._given(held)

    def _given(self, held: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
        self._learn()
        for numbers in held:
            yield self._rows.take(numbers[0] if len(numbers) == 1 else np.concatenate([_NONE, *numbers]))[0]
        if len(self._memo) > REMEMBERED:
            self._forget()

    def __call__(self, text: str) -> np.ndarray:
        return next(self.batch([text]))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)
