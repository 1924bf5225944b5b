"""Secrets in texts: known shapes, and random strings found by their token efficiency.

A vocabulary learned from ordinary text covers words with few tokens, but needs about one token per two characters
for random strings. Long runs of key characters whose characters per token stay low are taken as
secrets, unless they are shaped like a digest or an identifier that is known to be public. Names made of words
need no exception: their tokens are long.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of known secrets, in the order in which kinds are listed.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
RANDOM = "random"
KINDS = (*BASE_KINDS, RANDOM)
_LEAST_ASSIGNED, _LEAST_ACCESS = 8, 16
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Public strings that look random: digests by length, UUIDs and numbers.
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+)"
)
_SPANS = "array<struct<kind: string, start: long, end: long>>"


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str):
    """A tiktoken encoding from a rank file, one per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the known shapes; of each kind the leftmost matches that do not overlap."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST_ACCESS]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def random_spans(text: str, encode, most_per_token: float, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of low characters per token that no known shape overlaps."""
    found = []
    for m in _CANDIDATE.finditer(text):
        if _KNOWN.fullmatch(m[0]) or any(a < m.end() and m.start() < b for _, a, b in known):
            continue
        if len(m[0]) <= most_per_token * len(encode(m[0])):
            found.append((RANDOM, *m.span()))
    return found


def scan(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text: str = "text",
    most_per_token: float = 1.9,
    into: str = "secrets",
) -> DataFrame:
    """The rows with their secrets, an array of kind, start and end in code points (end exclusive), ordered
    by start and then kind.

    A null or empty text has an empty array. A column already named as ``into`` is replaced; all others
    stay as they are. Rows are independent of each other, so repeated rows give equal results.
    """

    @F.pandas_udf(_SPANS)
    def spans(texts):
        encode = vocabulary(ranks, pattern).encode_ordinary

        def one(words: str | None) -> list[dict]:
            known = base_spans(words or "")
            found = known + random_spans(words or "", encode, most_per_token, known)
            found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            return [{"kind": k, "start": a, "end": b} for k, a, b in found]

        return texts.map(one)

    return docs.withColumn(into, spans(F.col(text)))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", most_per_token: float = 1.9, mark: str = "[SECRET]"
) -> DataFrame:
    """The rows with each secret replaced by ``mark`` (overlapping spans by one); null texts stay null."""
    names, schema = docs.columns, docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(ranks, pattern).encode_ordinary
        for batch in batches:
            clean = [w and _redacted(w, encode, most_per_token, mark) for w in batch[text].to_pylist()]
            column = pa.array(clean, batch.schema.field(text).type)
            yield batch.set_column(names.index(text), batch.schema.field(text), column)

    return docs.mapInArrow(rows, schema)


def _redacted(words: str, encode, most_per_token: float, mark: str) -> str:
    known = base_spans(words)
    parts, at = [], 0
    for _, start, end in sorted(known + random_spans(words, encode, most_per_token, known), key=lambda s: s[1:]):
        if start >= at:
            parts += [words[at:start], mark]
        at = max(at, end)
    return "".join([*parts, words[at:]])
